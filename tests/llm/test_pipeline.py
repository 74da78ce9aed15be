"""The whole pipeline against plain versions of its stages, one after the other."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from helpers import prose
from test_dedup import plain_classes, plain_removed
from test_outputs import whole

import corpus_pipeline
from splitwarden.llm.queries import SQL


def documents():
    rnd = random.Random(12)
    texts = [(i, "\n".join(prose(100 * i + k, 25) for k in range(2 + i % 3))) for i in range(20)]
    shared = prose(77, 12)
    texts += [(40 + i, f"{prose(5000 + i, 60)}\n{shared}\n{prose(6000 + i, 30)}") for i in range(6)]
    for i in range(46, 60):  # near copies of whole documents, with other line ends
        words = texts[i - 46][1].split(" ")
        words[rnd.randrange(len(words))] = f"edit{i}"
        texts.append((i, " ".join(words).replace("\n", " ")))
    texts += [(60, "too short"), (61, None), (62, ""), (63, "x " * 200), (64, "# $ % & | < > " * 60)]
    texts += [(65, f"{prose(8000, 40)} {prose(999, 20)} {prose(8001, 40)}"), (66, texts[3][1]), (67, "\n".join(prose(8100 + k, 40) for k in range(60)))]
    return texts


def kept_by(sql, column, wanted, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        key = "doc_id" if name == "documents" else "item_id"
        con.register(f"{name}_table", pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_table")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return {r[names.index("doc_id")] for r in result.fetchall() if r[names.index(column)] == wanted}


def plain_pipeline(rows, items):
    kept = kept_by(SQL["op4_quality_rules"], "kept", True, documents=rows)
    rows = [r for r in rows if r[0] in kept]
    removed = plain_removed(rows)
    lines = []
    for doc, text in rows:
        left = [x for n, x in enumerate((text or "").split("\n")) if (False, doc, n) not in removed]
        if len(left) == len((text or "").split("\n")) or any(x.strip(" \t\n\x0b\x0c\r") for x in left):
            lines.append((doc, "\n".join(left)))
    rows = [(d, t) for d, t in lines if (d, d) in set(plain_classes(lines))]
    clean = kept_by(SQL["op5_decontamination"], "contaminated", False, documents=rows, benchmark=items)
    pieces = []
    for doc, text in rows:
        if doc in clean:
            ids = whole(text)
            pieces += [
                (doc, at, min(1024, len(ids) - at), zlib.crc32(np.array(ids[at : at + 1024], "<u4").tobytes()), len(ids))
                for at in range(0, len(ids), 1024)
            ]
    return pieces


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows, items = documents(), [(1, prose(999, 20)), (2, None), (3, prose(4242, 5))]
    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, items)
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found]
    assert sorted(got) == sorted(want)
    left = {w[0] for w in want}
    assert 67 in left and 65 not in left and not left & {60, 63, 64} and 15 < len(left) < 45
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = Counter()
        for offset, length in sorted(places):
            assert offset == ends["end"]
            ends["end"] = offset + length
        assert ends["end"] <= 1024
