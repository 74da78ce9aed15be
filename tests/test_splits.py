import random
import time

import pytest
from pyspark.sql import functions as F

from splitwarden.operators import folds as FO
from splitwarden.operators import quotas as Q
from splitwarden.operators import scale
from splitwarden.operators import splits as SP
from splitwarden.sources import tables as TB


def reachable_error(sizes, test, val):
    """Best (absolute, maximum, joint) error over all assignments, by plain search."""
    states, margin = {(0, 0)}, max(sizes)
    for s in sizes:
        states |= {
            new
            for t, v in states
            for new in ((t + s, v), (t, v + s))
            if new[0] <= test + margin and new[1] <= val + margin
        }
    total = sum(sizes)
    return min(
        (abs(t - test) + abs(v - val), max(abs(t - test), abs(v - val)), abs(t + v - test - val))
        for t, v in states
        if t > 0 and v > 0 and total - t - v > 0
    )


def test_quotas_are_as_good_as_search():
    rng = random.Random(4)
    checked = 0
    for _ in range(150):
        pool = rng.choice([[1, 2, 3, 5, 8, 13], [7, 14, 21], [2, 4, 40], [1, 30]])
        sizes = [rng.choice(pool) for _ in range(rng.randint(5, 18))]
        test, val = round(sum(sizes) * 0.2), round(sum(sizes) * 0.1)
        if not test or not val:
            continue
        histogram = {s: sizes.count(s) for s in set(sizes)}
        try:
            want = reachable_error(sizes, test, val)
        except ValueError:
            continue
        quota, _ = Q.solve_quotas(histogram, test, val)
        t = sum(s * a for s, (a, _) in quota.items())
        v = sum(s * b for s, (_, b) in quota.items())
        assert all(a + b <= histogram[s] for s, (a, b) in quota.items())
        assert (abs(t - test) + abs(v - val), max(abs(t - test), abs(v - val)), abs(t + v - test - val)) == want
        checked += 1
    assert checked > 80


def test_quotas_of_a_huge_class_are_exact():
    histogram = {1: 900_000_000, 2: 3_000_000, 7: 100_000, 300_000_000: 1}
    total = sum(s * n for s, n in histogram.items())
    test, val = round(total * 0.2), round(total * 0.1)
    quota, _ = Q.solve_quotas(histogram, test, val)
    assert sum(s * a for s, (a, _) in quota.items()) == test
    assert sum(s * b for s, (_, b) in quota.items()) == val


def test_quotas_of_large_skewed_classes():
    # A third of the rows in one group, exact with the rest; then one that must overshoot.
    for histogram, want in (
        ({200_000: 1, 50_000: 1, 1: 50_000}, 0),
        ({5: 100_000, 1_000_000: 3}, 300_000),
    ):
        total = sum(s * n for s, n in histogram.items())
        test, val = round(total * 0.2), round(total * 0.1)
        quota, _ = Q.solve_quotas(histogram, test, val)
        assert all(a + b <= histogram[s] for s, (a, b) in quota.items())
        t = sum(s * a for s, (a, _) in quota.items())
        v = sum(s * b for s, (_, b) in quota.items())
        assert abs(t - test) + abs(v - val) == want


def test_fold_quotas_equal_one_by_one_dealing():
    rng = random.Random(6)
    for _ in range(100):
        histogram = {rng.randint(1, 30): rng.randint(1, 30) for _ in range(rng.randint(1, 7))}
        k = rng.randint(1, 6)
        loads = [0] * k
        for s in sorted(histogram, reverse=True):
            for _ in range(histogram[s]):
                loads[loads.index(min(loads))] += s
        quota = Q.fold_quotas(histogram, k)
        assert all(sum(quota[s]) == n for s, n in histogram.items())
        assert sorted(sum(s * quota[s][f] for s in histogram) for f in range(k)) == sorted(loads)


def grouped_rows(spark, seed=1):
    """Two classes; one group holds a third of all rows."""
    rng = random.Random(seed)
    rows, row = [], 0
    for g in range(120):
        size = 200 if g == 0 else rng.randint(1, 6)
        for _ in range(size):
            rows.append((row, f"g{g}", g % 2, f"class{g % 2}", f"sha{g}"))
            row += 1
    return spark.createDataFrame(
        rows, "row_id int, group_id string, class_index int, class_name string, sha256 string"
    )


@pytest.mark.parametrize("floor", [100_000, 5])
def test_split_keeps_groups_and_meets_targets(spark, monkeypatch, floor):
    monkeypatch.setattr(scale, "TARGET_ROWS", floor)
    df = grouped_rows(spark)
    done = SP.group_split(df, seed=7).cache()
    assert done.count() == df.count()
    assert SP.leakage_report(done).isEmpty()
    summary = SP.split_summary(done).collect()
    assert len(summary) == 6 and all(r["difference_from_target"] == 0 for r in summary)
    again = {r["group_id"]: r["split"] for r in SP.group_split(df, seed=7).collect()}
    assert again == {r["group_id"]: r["split"] for r in done.collect()}


def test_kfold_never_splits_a_group(spark):
    df = grouped_rows(spark)
    done = FO.group_kfold(df, 5, seed=3)
    assert done.count() == df.count()
    per_group = done.groupBy("group_id").agg(F.count_distinct("fold").alias("n"))
    assert per_group.filter("n > 1").isEmpty()
    audit = FO.fold_integrity(FO.fold_roles(done)).collect()
    assert len(audit) == 5 and all(r["overlap_group_count"] == 0 for r in audit)
    assert FO.fold_preconditions(df, 5).isEmpty()
    assert FO.fold_preconditions(df, 61).count() == 2


def test_half_targets_round_to_even(spark):
    df = spark.range(225).selectExpr("id", "0 AS class_index", "'c' AS class_name")
    row = SP.split_targets(df).first()
    assert (row["train"], row["validation"], row["test"]) == (158, 22, 45)
    with pytest.raises(ValueError):
        SP.split_targets(df, (0.5, 0.1, 0.2))


def test_manifest_contracts(spark):
    names = TB.class_dictionary(spark, ["a", "b"])
    rows = [
        ("train", "a", 0, "g1", "p1"),
        ("train", "a", 1, "g1", "p2"),
        ("train", "x", 0, "g2", "p3"),
        ("train", "a", 0, "", "p3"),
    ]
    df = spark.createDataFrame(
        rows, "split string, class_name string, class_index int, group_id string, relative_path string"
    )
    found = sorted(tuple(r) for r in TB.manifest_violations(df, names).collect())
    assert found == [
        ("class_without_rows", "b"),
        ("incomplete_row", "p3"),
        ("repeated_path", "p3"),
        ("unknown_class", "p3"),
        ("wrong_index", "p2"),
    ]
    with pytest.raises(ValueError, match="missing required columns"):
        TB.read_manifest(df.drop("split"), "train", names)


def brute_score(histogram, test, val):
    total = sum(size * n for size, n in histogram.items())
    states = {(0, 0)}
    for size, n in histogram.items():
        states = {
            (t + a * size, v + b * size) for t, v in states for a in range(n + 1) for b in range(n - a + 1)
        }
    return min(
        (abs(t - test) + abs(v - val), max(abs(t - test), abs(v - val)), abs(t + v - test - val))
        for t, v in states
        if t > 0 and v > 0 and t + v < total
    )


def score_of(quota, test, val):
    t = sum(size * a for size, (a, _) in quota.items())
    v = sum(size * b for size, (_, b) in quota.items())
    return abs(t - test) + abs(v - val), max(abs(t - test), abs(v - val)), abs(t + v - test - val)


def test_quotas_of_large_groups_are_the_closest():
    rnd = random.Random(11)
    for _ in range(60):
        histogram = {}
        for _ in range(rnd.randrange(3, 8)):
            size = rnd.randrange(1, rnd.choice([10, 1000, 10**6]))
            histogram[size] = histogram.get(size, 0) + rnd.randrange(1, 3)
        total = sum(size * n for size, n in histogram.items())
        test, val = round(total * 0.2), round(total * 0.1)
        if test < 1 or val < 1 or sum(histogram.values()) < 3:
            continue
        quota, proven = Q.solve_quotas(histogram, test, val)
        assert proven and score_of(quota, test, val) == brute_score(histogram, test, val)


@pytest.mark.parametrize("s, error", [(100, 60), (300, 180), (1000, 600), (100_000, 60_000)])
def test_quotas_do_not_depend_on_the_size_of_the_class(s, error):
    histogram = {5 * s + 1: 5, 4 * s + 1: 5, 3 * s + 1: 5, 7 * s + 1: 2}
    total = sum(size * n for size, n in histogram.items())
    start = time.perf_counter()
    quota, proven = Q.solve_quotas(histogram, round(total * 0.2), round(total * 0.1))
    assert proven and score_of(quota, round(total * 0.2), round(total * 0.1))[0] == error
    assert time.perf_counter() - start < 1


def test_quotas_of_many_sizes_are_exact():
    histogram = {size: max(1, 10**6 // size**2) for size in range(1, 800)}
    total = sum(size * n for size, n in histogram.items())
    quota, proven = Q.solve_quotas(histogram, round(total * 0.2), round(total * 0.1))
    assert proven and score_of(quota, round(total * 0.2), round(total * 0.1))[0] == 0


def test_quotas_of_two_large_sizes_are_proven():
    histogram = {1000: 50, 999: 43}
    test, val = round(92_957 * 0.2), round(92_957 * 0.1)
    quota, proven = Q.solve_quotas(histogram, test, val)
    want = min(
        abs(1000 * a + 999 * c - test) + abs(1000 * b + 999 * d - val)
        for a in range(51) for b in range(51 - a) for c in range(44) for d in range(44 - c) if a + c and b + d
    )
    assert proven and want == 686 == score_of(quota, test, val)[0]


@pytest.mark.parametrize("seed", range(5))
def test_remainders_are_settled_from_the_middle(seed):
    rnd = random.Random(seed)
    for histogram in (
        {rnd.randrange(1, 10**5): rnd.randrange(300, 1000) for _ in range(12)},
        {s: 3 for s in range(100 + seed, 160)},
    ):
        total = sum(size * n for size, n in histogram.items())
        test, val = round(total * 0.2), round(total * 0.1)
        start = time.perf_counter()
        quota, proven = Q.solve_quotas(histogram, test, val)
        assert proven and score_of(quota, test, val)[0] == 0
        assert all(0 <= a and 0 <= b and a + b <= histogram[s] for s, (a, b) in quota.items())
        assert time.perf_counter() - start < 5


def test_hot_keys_are_split_by_target_size(spark, monkeypatch):
    monkeypatch.setattr(scale, "TARGET_ROWS", 200)
    # One key with 30 % of the rows, a thousand just below 0.1 %.
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 6_000, F.lit(-1)).otherwise(F.col("id") % 1000).alias("k"), "id"
    )
    facts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = scale._hot_keys(facts, ["k"], "n")
    assert [(r["k"], r["_salts"]) for r in hot.collect()] == [(-1, 30)]
    dealt = scale._salted(rows, hot, ["k"]).filter("k = -1").groupBy("_salt").count()
    assert dealt.agg(F.max("count")).first()[0] < 2 * 200
    joined = scale.attach(rows, facts, "k", "n")
    assert joined.count() == 20_000
    assert joined.groupBy("k").agg(F.max("n").alias("n")).exceptAll(facts).isEmpty()


def test_expand_splits_by_the_pairs_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(scale, "TARGET_ROWS", 500)
    left = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    members = spark.range(600).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    found = scale.expand(left, members, "k")
    assert found.exceptAll(left.join(members, "k")).isEmpty()
    assert found.count() == left.join(members, "k").count()
