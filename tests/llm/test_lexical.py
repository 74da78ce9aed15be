"""Lexical search against a plain version that scores every document."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, prose, table, words

from splitwarden.llm import lexical
from splitwarden.llm.lexical import Best, Block, Queries, build_index, lexical_search, query_blocks, search, search_block

ITEMS = "item_id bigint, text string, doc_id int, item int, term int, score int, rank string"


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], ITEMS)


def plain(docs, items, top=20):
    counts = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(1 for n in sizes if n), sum(sizes)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        found = []
        for (doc, c), n in zip(counts, sizes):
            if not n:
                continue
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w in words(text) if c[w]
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort()
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(found[:top])]
    return sorted(out, key=str)


def rows_of(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def skewed(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"w{int(rnd.paretovariate(0.5)) % 500}" for _ in range(n))


def big_corpus():
    rnd = random.Random(3)
    rows = corpus() + [(200 + i, skewed(i, 1 + rnd.randrange(150))) for i in range(300)]
    rows += [(600 + i, "tie tie break") for i in range(30)] + [(None, "tie tie break")] * 2 + [(700, "w1 " * 4000)]
    return rows


def some_items():
    return [(i, skewed(900 + i, 25)) for i in range(12)] + [
        (20, None), (21, ""), (22, "tie BREAK"), (22, "tie"), (None, "one two w1 w1 w1"), (23, "absent words"), (24, prose(3, 90)),
    ]


def test_results_equal_scoring_everything(spark):
    docs, items = big_corpus(), some_items()
    assert rows_of(lexical_search(table(spark, docs).repartition(6), items_of(spark, items))) == plain(docs, items)


@pytest.mark.parametrize("top", [1, 3])
def test_query_blocks_and_rounds(spark, monkeypatch, top):
    docs, items = big_corpus(), some_items()
    monkeypatch.setattr(lexical, "QUERY_TERMS", 40)
    monkeypatch.setattr(lexical, "ROUND", 2)
    index = build_index(table(spark, docs).repartition(8))
    assert index.filter("block % 2 = 0").count() and index.count() > 4
    assert rows_of(search(index, items_of(spark, items), top=top)) == plain(docs, items, top)


def test_blocks_of_queries_are_bounded(spark):
    terms = spark.createDataFrame([(i, f"t{j}") for i in range(30) for j in range(i % 9)] + [(50, f"t{j}") for j in range(99)], "item bigint, term string")
    ranges = list(query_blocks(terms, 20))
    for low, high in ranges:
        assert low == high or terms.filter(f"item BETWEEN {low} AND {high}").count() <= 20
    assert sum(terms.filter(f"item BETWEEN {a} AND {b}").count() for a, b in ranges) == terms.count()


def opened(docs):
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    return [Block(r) for b in lexical._index([batch]) for r in b.to_pylist()]


def queries_for(items, docs):
    found = Queries([{"item": i, "term": w, "n": n} for i, (_, t) in enumerate(items) for w, n in Counter(words(t)).items()])
    sizes = [len(words(t)) for _, t in docs]
    found.documents, found.total = sum(1 for n in sizes if n), sum(sizes)
    found.weight = np.arange(len(found.keys)) * 7 % 900 + 1
    return found


def test_bounds_are_never_too_low_and_exclude_documents():
    docs, items = big_corpus(), [(i, skewed(900 + i, 25)) for i in range(12)]
    queries = queries_for(items, docs)
    blocks = opened(docs)
    assert sum(len(b.ids) for b in blocks) == sum(1 for _, t in docs if words(t))
    scored = 0
    best = [Best(5, 0) for _ in queries.items]
    for block in blocks:
        bounds = block.bounds(queries, 0, len(queries.items))
        for q in range(len(queries.items)):
            assert (bounds[q] >= block.scores(queries, q, np.arange(len(block.ids)))).all()
        scored += search_block(block, queries, best, 0, len(queries.items))
    assert scored < 0.5 * len(docs) * len(items)


def test_bitmaps_hold_every_document_of_a_term():
    docs = big_corpus()
    for block in opened(docs):
        bitmaps = block.bitmaps(block.keys)
        document, term = np.divmod(block.codes, len(block.keys))
        for level, bits in enumerate(bitmaps):
            seen = np.unpackbits(bits, axis=1, count=len(block.ids), bitorder="little")
            often = block.counts >= 1 << level
            assert seen[term[often], document[often]].all()


def test_empty_tables(spark):
    assert lexical_search(table(spark, []), items_of(spark, some_items())).count() == 0
    assert lexical_search(table(spark, corpus()), items_of(spark, [])).count() == 0
    assert lexical_search(table(spark, [(1, None)]), items_of(spark, some_items())).count() == 0
