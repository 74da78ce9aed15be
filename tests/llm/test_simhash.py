"""SimHash classes against a plain version that compares all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from helpers import corpus, prose, table
from pyspark.sql import functions as F

from splitwarden.llm.queries import op12_simhash
from splitwarden.llm.simhash import (
    as_hex,
    embedding,
    fingerprint,
    forest,
    grid_masks,
    near_links,
    simhash_classes,
)

_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance=4):
    """values: [(doc_id, fingerprint)] -> the least doc_id reachable, per row."""
    label = list(range(len(values)))
    for i, (_, a) in enumerate(values):
        for j in range(i):
            if (a ^ values[j][1]).bit_count() <= distance and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(values, label):
        least[x] = min((d for d in (doc, least.get(x)) if d is not None), default=None)
    return [least[x] for x in label]


def odd_rows():
    rnd = random.Random(8)
    rows = corpus() + [(100, "Ünï x y z\x0bw"), (101, "a b c"), (102, "A\tb\nC"), (103, " \t\n"), (104, "same " * 300)]
    base = prose(70, 300).split()
    for i in range(110, 150):  # edits at the ends change few shingles
        rows.append((i, " ".join(base[: 300 - rnd.randrange(4)])))
    return rows


def test_fingerprint_is_the_plain_one():
    for _, text in odd_rows():
        assert fingerprint(text) == plain_fingerprint(text)


def test_long_texts_are_read_in_portions(monkeypatch):
    text = prose(5, 900) + "  " + "x" * 500 + "\n" + prose(6, 700)
    for chunk in (1, 7, 100, 4096):
        monkeypatch.setattr("splitwarden.llm.simhash.CHUNK", chunk)
        assert fingerprint(text) == plain_fingerprint(text)


def test_manhattan_distance_never_exceeds_hamming():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = a.copy()
    for _ in range(6):
        b ^= np.uint64(1) << rnd.integers(0, 64, 4000).astype(np.uint64)
    counts = [[bin(int(x) >> k & 3).count("1") for k in range(0, 64, 2)] for x in (a[0], b[0])]
    assert np.bitwise_count(embedding(a[:1]) ^ embedding(b[:1]))[0] == sum(abs(x - y) for x, y in zip(*counts))
    assert (np.bitwise_count(embedding(a) ^ embedding(b)) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("parts", [5, 6, 7])
def test_every_pair_within_the_distance_shares_a_cell(parts):
    rnd = random.Random(parts)
    masks = np.array(grid_masks(parts), np.int64).view(np.uint64)
    for _ in range(300):
        a = b = rnd.getrandbits(64)
        for _ in range(4):
            b ^= 1 << rnd.randrange(64)
        pair = embedding(np.array([a, b], np.uint64))
        assert ((pair[0] & masks) == (pair[1] & masks)).any()


def test_forest_joins_what_all_links_join():
    rnd = random.Random(4)
    values = [rnd.getrandbits(64) for _ in range(20)]
    values += [v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in values for _ in range(6)]
    fp = np.array(sorted(set(values)), np.uint64)
    src, dst = forest(fp)
    assert len(src) == len(fp) - len(set(plain_components([(int(x), int(x)) for x in fp])))
    assert (np.bitwise_count(src ^ dst) <= 4).all()


@pytest.mark.parametrize("options", [{}, {"parts": 5, "cell": 3}])
def test_classes_equal_all_pairs(spark, options):
    rows = odd_rows()
    found = simhash_classes(table(spark, rows).repartition(5), **options)
    values = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = [(d, f"{v:016x}", c) for (d, v), c in zip(values, plain_components(values))]
    got = found.select("doc_id", as_hex(F.col("fp")).alias("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert len(got) == len(rows)


def test_a_full_cell_becomes_many_tasks(spark):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    # Chains of fingerprints that all share one half; some steps are too wide.
    values, at = set(), base
    for _ in range(400):
        at ^= 1 << rnd.randrange(24)
        if rnd.random() < 0.1:
            at ^= 0x3F << rnd.randrange(18)
        values.add(at)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    points = spark.createDataFrame(signed, "fp bigint")
    links = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in near_links(points, parts=5, cell=20).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    names = dict(zip(values, plain_components([(v, v) for v in values])))
    assert all(names[a] == names[b] for a, b in links)
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    assert len({root(v) for v in values}) == len(set(names.values()))


def test_no_rows(spark):
    assert simhash_classes(table(spark, [])).count() == 0


def test_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    values = [(d, plain_fingerprint(t)) for d, t in docs]
    expected = [(d, f"{v:016x}", c) for (d, v), c in zip(values, plain_components(values))]
    assert sorted(map(tuple, op12_simhash(spark, "/root/testdata/sf0.001").collect())) == sorted(expected)
