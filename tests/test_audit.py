import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwarden.operators import components as CC
from splitwarden.operators import exact as EX
from splitwarden.operators import fingerprint as FP
from splitwarden.operators import near as NE
from splitwarden.operators import scale
from splitwarden.plans.audit_job import run_audit
from splitwarden.sources.tables import class_dictionary, read_review


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def make_records(spark, rows):
    """rows: (class_index, path, sha, hash)."""
    df = spark.createDataFrame(
        [(c, f"c{c}", f"c{c}/{p}", f"/d/c{c}/{p}", s, signed(h)) for c, p, s, h in rows],
        "class_index int, class_name string, relative_path string, path string, sha256 string, dhash bigint",
    ).selectExpr("*", "true AS readable", "1 AS width", "1 AS height", "'L' AS mode")
    return EX.number_records(df)


def clustered_hashes(rng, n, bits=64):
    centers = [rng.getrandbits(bits) for _ in range(6)]
    out = []
    for _ in range(n):
        h = rng.choice(centers)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(bits)
        out.append(h)
    return out


@pytest.mark.parametrize("threshold, limit", [(0, 2), (1, 2), (4, 2), (4, 2000), (9, 2)])
def test_hash_pairs_equal_brute_force(spark, threshold, limit):
    rng = random.Random(threshold * 10 + limit)
    hashes = sorted({signed(h) for h in clustered_hashes(rng, 120)})
    df = spark.createDataFrame([(h,) for h in hashes], "dhash bigint")
    got = [tuple(r) for r in NE.near_hash_pairs(df, threshold, bucket_limit=limit).collect()]
    mask = (1 << 64) - 1
    want = {
        (a, b, ((a ^ b) & mask).bit_count())
        for i, a in enumerate(hashes)
        for b in hashes[i + 1 :]
        if ((a ^ b) & mask).bit_count() <= threshold
    }
    assert len(got) == len(set(got)) and set(got) == want


def random_rows(seed, n=60):
    rng = random.Random(seed)
    hashes = clustered_hashes(rng, n // 2)
    contents = [(f"s{i}", h) for i, h in enumerate(hashes)]
    rows = []
    for i in range(n):
        sha, h = rng.choice(contents)
        rows.append((rng.randrange(3), f"{rng.randrange(10**6):07d}_{i}", sha, h))
    return rows


def closure(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def reference_pairs(recs, threshold):
    mask = (1 << 64) - 1
    pairs = []
    for i, a in enumerate(recs):
        for b in recs[i + 1 :]:
            d = ((a["dhash"] ^ b["dhash"]) & mask).bit_count()
            if a["sha256"] != b["sha256"] and d <= threshold:
                pairs.append((a["row_no"], b["row_no"], d, a["class_index"] != b["class_index"]))
    return pairs


def exact_links(recs):
    groups = {}
    for r in recs:
        groups.setdefault(r["sha256"], []).append(r)
    return [
        (g[0]["row_no"], r["row_no"])
        for g in groups.values()
        if len({x["class_index"] for x in g}) == 1
        for r in g[1:]
    ]


@pytest.mark.parametrize("seed, floor", [(1, 100_000), (2, 3), (3, 3)])
def test_pairs_totals_and_groups_equal_brute_force(spark, monkeypatch, seed, floor):
    # The low floor sends the small table through the salted joins.
    monkeypatch.setattr(scale, "TARGET_ROWS", floor)
    df = make_records(spark, random_rows(seed)).cache()
    recs = sorted((r.asDict() for r in df.collect()), key=lambda r: r["row_no"])
    want = reference_pairs(recs, 4)
    listed = NE.near_duplicates(df, 4).cache()
    cells = {}
    for r in recs:
        cells.setdefault((r["sha256"], r["class_name"]), []).append(r["row_no"])
    got = []
    for r in listed.collect():
        one, two = cells[r["sha256_1"], r["class_1"]], cells[r["sha256_2"], r["class_2"]]
        assert (r["row_1"], r["row_2"]) == (one[0], two[0]) and r["n_pairs"] == len(one) * len(two)
        pairs = [(min(x, y), max(x, y)) for x in one for y in two]
        got += [(*p, r["dhash_distance"], r["cross_class_candidate"]) for p in pairs]
    assert sorted(got) == sorted(want)
    links = {}
    for x, y, *_ in want:
        links[x], links[y] = links.get(x, 0) + 1, links.get(y, 0) + 1
    assert {r["row_no"]: r["n_links"] for r in NE.near_members(df, listed).collect()} == links
    totals = {r[0]: (r[1], r[2]) for r in NE.near_pair_totals(df, 4).collect()}
    for d in range(5):
        here = [p for p in want if p[2] == d]
        assert totals.get(d, (0, 0)) == (len(here), sum(p[3] for p in here))
    edges = exact_links(recs) + [(a, b) for a, b, _, cross in want if not cross]
    label = closure([r["row_no"] for r in recs], edges)
    links = EX.exact_edges(df).union(NE.auto_edges(df, 4))
    found = CC.duplicate_components(df.select("row_no"), links).collect()
    assert {r["row_no"]: r["component"] for r in found} == label


@pytest.mark.parametrize("limit,levels", [(8000, 4), (40, 1), (15, 2)])
def test_links_of_near_hashes_grow_with_the_hashes(spark, limit, levels):
    """All hashes are near one another: links are a forest of each bucket, sums count every pair."""
    rnd = random.Random(limit)
    rows = []
    for i in range(150):
        h = rnd.getrandbits(64) & 3 << 60 | (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
        rows += [(rnd.randrange(3), f"{i}_{k}", f"s{i}", h) for k in range(rnd.randint(1, 3))]
    df = make_records(spark, rows)
    df = df.withColumn("class_index", F.when(F.col("class_index") < 2, F.col("class_index")))  # class 2 is missing
    recs = df.collect()
    near = [
        (a, b, d) for i, a in enumerate(recs) for b in recs[i + 1 :]
        if 0 < (d := ((a["dhash"] ^ b["dhash"]) & (1 << 64) - 1).bit_count()) <= 4
    ]
    known = [(a, b, d) for a, b, d in near if a["class_index"] is not None and a["class_index"] == b["class_index"]]
    links = NE.near_hash_links(df, 4, bucket_limit=limit, max_levels=levels)
    nodes = {(r["class_index"], r["dhash"]) for r in recs}
    if limit == 8000:
        assert links.filter("src IS NOT NULL").count() <= 5 * len(nodes) < len(known)
        assert NE.auto_edges(df, 4).filter("src <> dst").count() <= 5 * len(nodes) + len(recs)
    totals = {r[0]: (int(r[1]), int(r[2])) for r in NE.near_pair_totals(df, 4, links).filter("dhash_distance > 0").collect()}
    want = {}
    for pairs, k in ((near, 0), (known, 1)):
        for _, _, d in pairs:
            want.setdefault(d, [0, 0])[k] += 1
    assert totals == {d: (n, n - same) for d, (n, same) in want.items()}
    first = {}
    for r in sorted(recs, key=lambda r: r["row_no"]):
        first.setdefault((r["class_index"], r["dhash"]), r["row_no"])
    ids = list(first.values())
    hub = lambda r: first[r["class_index"], r["dhash"]]
    label = closure(ids, [(hub(a), hub(b)) for a, b, _ in known])
    made = [(r["src"], r["dst"]) for r in links.filter("src IS NOT NULL").collect()]
    assert closure(ids, made) == label and {x for e in made for x in e} == {hub(r) for a, b, _ in known for r in (a, b)}


def test_products_of_counts_are_summed_exactly():
    a, b = np.array([4_000_000_000, 7]), np.array([4_000_000_000, 6])
    assert NE._total(a, b) == 16 * 10**18 + 42 and NE._total(a[1:], b[1:]) == 42 and NE._total(a[:0], b[:0]) == 0


def test_one_full_bucket_is_many_tasks(spark, monkeypatch):
    """All hashes agree on the first blocks, so every level keeps them together."""
    rnd = random.Random(6)
    values = sorted({rnd.getrandbits(12) << 20 for _ in range(600)})
    hashes = spark.createDataFrame([(v,) for v in values], "dhash bigint")
    want = sorted(
        (a, b, (a ^ b).bit_count()) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2
    )
    for limit, levels in ((50, 1), (7, 2), (10**6, 1)):
        found = NE.near_hash_pairs(hashes, 2, bucket_limit=limit, max_levels=levels)
        assert sorted(map(tuple, found.collect())) == want
    keyed = hashes.selectExpr("dhash", "0 AS t")
    parts = NE._bucket_pairs(keyed, ["t"], 50)
    assert parts.count() == len(values) ** 2


def test_decisions_hold_for_all_copies(spark):
    # Contents 0 and 1 are near; each has copies, one decision names two of the copies.
    df = make_records(spark, [(0, "a", "s", 1), (0, "b", "s", 1), (0, "c", "t", 3), (0, "d", "t", 3), (0, "e", "u", (1 << 40) - 1)])
    schema = "relative_path_1 string, relative_path_2 string, decision string, notes string"
    pairs = NE.near_duplicates(df, 4)
    for rows, expected in (
        ([("c0/d", "c0/b", "yes", "seen")], ("yes", "seen")),
        ([("c0/d", "c0/b", "no", ""), ("c0/a", "c0/c", "Y", "again")], ("yes", "again")),
        ([("c0/d", "c0/b", "n", "x"), ("c0/a", "c0/zz", "yes", "")], ("no", "x")),
        ([], ("", "")),
    ):
        review = spark.createDataFrame(rows, schema)
        found = NE.apply_review(pairs, review, df)
        assert [(r["decision"], r["notes"]) for r in found.collect()] == [expected]
        label = CC.duplicate_components(df.select("row_no"), NE.confirmed_edges(found, df)).collect()
        groups = {r["component"] for r in label if r["row_no"] != 5}
        assert len(groups) == (1 if expected[0] == "yes" else 4)


def test_pairs_carry_only_what_is_read_of_them(spark):
    df = make_records(spark, [(0, "a", "s", 1), (0, "b", "s", 1), (0, "c", "t", 3)])
    listed = NE.near_duplicates(df, 4)
    plan = listed.select("row_1", "row_2", "n_1", "n_2")._jdf.queryExecution().optimizedPlan().toString()
    # Contents go by numbers; no struct keeps their paths and digests in the joins.
    assert "struct(" not in plan and "sha256_a" not in plan and "path_a" not in plan
    narrow = listed.drop("path_1", "path_2", "sha256_1", "sha256_2")
    members = NE.near_members(df, narrow).select("row_no", "representative", "copies", "n_links")
    assert sorted(map(tuple, members.collect())) == [(1, "c0/a", 2, 1), (2, "c0/a", 2, 1), (3, "c0/c", 1, 2)]


def test_links_and_decisions_need_no_paths_or_digests_in_the_list(spark):
    far = 0x1F << 40
    # Content s stands under two hashes, each with a near content of its own.
    rows = [(0, "a", "s", 1), (0, "b", "s", 1), (0, "c", "t", 3), (0, "d", "s", far), (0, "e", "u", far | 1)]
    df = make_records(spark, rows)
    wide = NE.near_duplicates(df, 4)
    narrow = wide.drop("path_1", "path_2", "sha256_1", "sha256_2")
    # The decision names s by its other hash; it holds for the whole content.
    schema = "relative_path_1 string, relative_path_2 string, decision string, notes string"
    review = spark.createDataFrame([("c0/d", "c0/c", "yes", "seen")], schema)
    found = NE.apply_review(narrow, review, df)
    decided = {(r["row_1"], r["row_2"]): (r["decision"], r["notes"]) for r in found.collect()}
    assert decided == {(1, 3): ("yes", "seen"), (4, 5): ("", "")}
    assert sorted(map(tuple, NE.confirmed_edges(found, df).collect())) == [(2, 1), (3, 1), (4, 1)]


def test_the_list_grows_with_contents_not_with_copies(spark):
    rows = [(0, f"{i:04d}", f"s{i % 3}", [1, 3, 7][i % 3]) for i in range(900)]
    df = make_records(spark, rows)
    listed = NE.near_duplicates(df, 4).collect()
    assert len(listed) == 3 and sum(r["n_pairs"] for r in listed) == 3 * 300 * 300


def test_records_without_a_hash_resemble_nothing(spark):
    df = make_records(spark, [(0, "a", "s", 1), (0, "b", "t", 1)]).withColumn("dhash", F.lit(None).cast("bigint"))
    assert NE.near_duplicates(df, 4).count() == 0 and NE.near_pair_totals(df, 4).count() == 0
    assert NE.auto_edges(df, 4).count() == 0


def test_counts_of_pairs_may_pass_64_bits(spark):
    counted = spark.sql("SELECT 4000000000 AS a, 4000000000 AS b")
    assert counted.select(NE._product(F.col("a"), F.col("b")).alias("n")).first()["n"] == 16 * 10**18


def test_long_chain_settles(spark):
    n = 200
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, n)], "src bigint, dst bigint")
    labels = CC.edge_stars(edges).collect()
    assert len(labels) == n - 1 and {r["dst"] for r in labels} == {1}


def test_cross_class_copies_stay_apart(spark):
    df = make_records(
        spark, [(0, "a", "s", 7), (0, "b", "s", 7), (1, "c", "s", 7), (1, "d", "t", (1 << 64) - 1)]
    )
    done = run_audit(df, class_dictionary(spark, ["c0", "c1"]), 4)
    assert done.manifest.select("group_id").distinct().count() == 4
    blockers = {r["counter"] for r in done.blockers.collect()}
    assert "cross_class_exact_duplicate_groups" in blockers


def test_both_audit_paths_agree(spark):
    df = make_records(spark, random_rows(8))
    names = class_dictionary(spark, ["c0", "c1", "c2"])
    empty = spark.createDataFrame(
        [], "relative_path_1 string, relative_path_2 string, decision string, notes string"
    )
    compact = run_audit(df, names, 4)
    listed = run_audit(df, names, 4, review=empty)
    key = ["relative_path", "group_id", "group_size", "grouping_basis"]
    rows = lambda a: sorted(tuple(r) for r in a.manifest.select(*key).collect())
    assert rows(compact) == rows(listed)
    counters = lambda a: sorted(tuple(r) for r in a.summary.collect())
    assert counters(compact) == counters(listed)


def test_review_last_row_wins_and_bad_values_fail(spark):
    rows = [
        (" a", "b ", "Y", "first", 1),
        ("b", "a", "different", " second ", 2),
        ("", "c", "yes", "", 3),
    ]
    schema = "relative_path_1 string, relative_path_2 string, decision string, notes string, line_no long"
    review = read_review(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in review] == [("a", "b", "no", "second")]
    bad = spark.createDataFrame([("a", "b", "maybe", "", 1)], schema)
    with pytest.raises(Exception, match="invalid review decision"):
        read_review(bad).collect()


def test_exact_duplicate_report(spark):
    df = make_records(
        spark, [(0, "b", "s", 1), (0, "a", "s", 1), (1, "z", "t", 2), (0, "c", "t", 2), (1, "q", "u", 3)]
    )
    rows = EX.exact_duplicates(df).orderBy("relative_path").collect()
    assert [(r["exact_group_id"], r["relative_path"], r["cross_class_duplicate"]) for r in rows] == [
        ("EXACT_0001", "c0/a", False),
        ("EXACT_0001", "c0/b", False),
        ("EXACT_0002", "c0/c", True),
        ("EXACT_0002", "c1/z", True),
    ]


def test_number_rows_and_prefix_sums(spark):
    df = spark.range(1000).select(
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("g"),
        F.sha2(F.col("id").cast("string"), 256).alias("k"),
        (F.col("id") % 7).alias("v"),
    )
    numbered = scale.number_rows(df, ["g", "k"], {"all": [], "within": ["g"]}).collect()
    ordered = sorted(numbered, key=lambda r: (r["g"], r["k"]))
    assert [r["all"] for r in ordered] == list(range(1, 1001))
    seen = {}
    for r in ordered:
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        assert r["within"] == seen[r["g"]]
    sums = scale.prefix_sums(df, ["g"], ["k"], {"run": "v"}, {"whole": "v"}).collect()
    running, whole = {}, {}
    for r in sums:
        whole[r["g"]] = whole.get(r["g"], 0) + r["v"]
    for r in sorted(sums, key=lambda r: (r["g"], r["k"])):
        running[r["g"]] = running.get(r["g"], 0) + r["v"]
        assert r["run"] == running[r["g"]] and r["whole"] == whole[r["g"]]


def joined(df):
    """Whether the plan of a query has a join."""
    return "Join" in df._jdf.queryExecution().optimizedPlan().toString()


def test_hash_pairs_of_a_wide_threshold_are_compared_in_blocks(spark):
    """12 of 56 bits: masks of four bits part nothing, so candidates must not become rows."""
    rnd = random.Random(12)
    centres = [rnd.getrandbits(56) for _ in range(40)]
    values = sorted({rnd.choice(centres) ^ sum(1 << rnd.randrange(56) for _ in range(rnd.randrange(9))) for _ in range(1500)})
    values = [v & (1 << 56) - 1 for v in values]
    hashes = spark.createDataFrame([(v,) for v in values], "dhash bigint")
    want = sorted({
        (min(a, b), max(a, b), (a ^ b).bit_count()) for i, a in enumerate(values) for b in values[i + 1 :] if 0 < (a ^ b).bit_count() <= 12
    })
    for limit in (100, 8000):
        found = NE.near_hash_pairs(hashes, 12, bucket_limit=limit, bits=56)
        assert sorted(map(tuple, found.collect())) == want
    assert not joined(found)  # all hashes are one portion here


def test_fingerprints_count_tokens_where_they_are_read(spark):
    """The same hashes as from the counts of ``text_cells``, without a row per token."""
    rnd = random.Random(9)
    words = ["Straße", "l’été", "x-y", "A1", "ß", "çà", "wort", "Ελλάς", "日本", "42"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "?! --"), (203, "a b c"), (203, "c d e f"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = FP.text_fingerprint(docs)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    cells = {}
    for r in FP.text_cells(docs).collect():
        cells.setdefault(r["doc_id"], [0] * 72)[r["cell"]] = r["n"]
    def dhash(g):
        return signed(int("".join(str(int(g[r * 9 + c + 1] > g[r * 9 + c])) for r in range(8) for c in range(8)), 2))
    want = [(i, dhash(cells[i]) if i in cells and i is not None else None) for i, _ in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


@pytest.fixture
def near_texts(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    base = [rnd.choices(words, k=50) for _ in range(4)]
    texts = [" ".join(b[:-1] + [f"w{i}"]) for b in base for i in range(6)]
    rows = [(i, t, ["de", "en"][i % 2], "s", len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_review_files_are_of_bounded_size(spark, near_texts, tmp_path, monkeypatch):
    from splitwarden.plans import catalog_audit as CA

    monkeypatch.setattr(CA, "REVIEW_FILE_ROWS", 5)
    monkeypatch.setattr(CA, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = CA.QUERIES["review_csv_files"](spark, near_texts).count()
    assert found == CA.X.near_pairs(spark, near_texts).count() > 10
    for part in (1, 2):
        files = list((tmp_path / "review-files" / f"round={part}").glob("*.csv"))
        assert len(files) > 3
        assert max(len(f.read_text().split("twice" if part == 2 else "first round")) for f in files) <= 20


def test_the_review_is_applied_once_for_links_and_counters(spark, near_texts):
    from splitwarden.plans import fixtures as X

    first = X.reviewed_pairs(spark, near_texts)
    assert X.reviewed_pairs(spark, near_texts) is first
    assert first.scratch_path and first.filter("decision <> ''").count() > 0


def test_review_files_go_when_they_are_read(spark, near_texts, tmp_path, monkeypatch):
    from splitwarden.plans import catalog_audit as CA

    whole = sorted(map(tuple, CA.QUERIES["review_csv_files"](spark, near_texts).collect()))
    monkeypatch.setattr(CA, "REVIEW_ROWS", 10, raising=False)
    monkeypatch.setattr(CA, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = CA.QUERIES["review_csv_files"](spark, near_texts)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) > 10
    assert not list(tmp_path.rglob("round=*"))
    # The numbers of the documents come with the list.
    assert not joined(CA.X.review_rows(spark, near_texts))


@pytest.mark.parametrize("seed, floor", [(4, 100_000), (5, 3)])
def test_the_whole_list_names_every_pair_of_records(spark, monkeypatch, seed, floor):
    monkeypatch.setattr(scale, "TARGET_ROWS", floor)
    df = make_records(spark, random_rows(seed)).cache()
    recs = sorted((r.asDict() for r in df.collect()), key=lambda r: r["row_no"])
    path = {r["row_no"]: r["relative_path"] for r in recs}
    want = reference_pairs(recs, 4)
    cells = NE.near_duplicates(df, 4, carried=["width"]).cache()
    found = NE.record_pairs(cells, df, carried=["width"]).collect()
    assert cells.count() < len(want) and {r["width_1"] for r in found} == {1}
    got = [(r["row_1"], r["row_2"], r["dhash_distance"], r["cross_class_candidate"]) for r in found]
    assert sorted(got) == sorted(want)
    for r in found:
        assert (r["relative_path_1"], r["relative_path_2"]) == (path[r["row_1"]], path[r["row_2"]])
        assert (r["class_1"], r["class_2"]) == tuple(path[r[c]].split("/")[0] for c in ("row_1", "row_2"))


def test_a_decision_holds_for_the_two_records_it_names(spark):
    df = make_records(spark, [(0, "a", "s", 1), (0, "b", "s", 1), (0, "c", "t", 3), (0, "d", "t", 3)])
    schema = "relative_path_1 string, relative_path_2 string, decision string, notes string"
    review = spark.createDataFrame([("c0/d", "c0/b", "yes", "seen"), ("c0/a", "c0/c", "n", None)], schema)
    found = NE.apply_review(NE.record_pairs(NE.near_duplicates(df, 4).cache(), df), review).cache()
    decided = {(r["row_1"], r["row_2"]): (r["decision"], r["notes"]) for r in found.collect()}
    assert decided == {(1, 3): ("no", ""), (2, 4): ("yes", "seen"), (1, 4): ("", ""), (2, 3): ("", "")}
    assert [tuple(r) for r in NE.confirmed_edges(found).collect()] == [(4, 2)]
    done = run_audit(df, class_dictionary(spark, ["c0"]), 4, review=review, auto=False)
    counts = {r["counter"]: int(r["value"]) for r in done.summary.collect()}
    assert [counts[f"{k}_near_duplicate_pairs"] for k in ("confirmed", "rejected", "unresolved")] == [1, 1, 2]


def test_audit_queries_work_on_every_pair_of_records(spark, near_texts, tmp_path):
    from splitwarden.plans import catalog_audit as CA

    docs = spark.read.parquet(f"{near_texts}/documents.parquet")
    copies = docs.withColumn("doc_id", F.col("doc_id") * 7 + 101).filter("doc_id % 2 = 0")
    sf = str(tmp_path / "copies")
    docs.union(copies).write.parquet(f"{sf}/documents.parquet")
    recs = sorted((r.asDict() for r in CA.X.records(spark, sf).collect()), key=lambda r: r["row_no"])
    by_row = {r["row_no"]: r for r in recs}
    want, links = {}, exact_links(recs)
    for x, y, d, cross in reference_pairs(recs, 4):
        a, b = by_row[x], by_row[y]
        decision = ("yes", "no", "")[(a["doc_id"] + b["doc_id"]) % 3]
        want[a["relative_path"], b["relative_path"]] = (d, cross, decision)
        if decision == "yes" and not cross:
            links.append((x, y))
    rows = lambda name: CA.QUERIES[name](spark, sf).collect()
    ends = lambda r: (r["relative_path_1"], r["relative_path_2"])
    assert len(want) > CA.X.near_pairs(spark, sf).count()
    listed = rows("near_duplicates")
    assert len(listed) == len(want) and {ends(r): (r["dhash_distance"], r["cross_class_candidate"]) for r in listed} == {k: v[:2] for k, v in want.items()}
    assert {ends(r): r["decision"] for r in rows("apply_review")} == {k: v[2] for k, v in want.items()}
    assert {ends(r): r["decision"] for r in rows("auto_group")} == {k: v[2] or ("" if v[1] else "yes") for k, v in want.items()}
    low = {tuple(sorted(k)): v for k, v in want.items()}
    assert {ends(r): r["decision"] for r in rows("review_read")} == {k: v[2] for k, v in low.items()}
    assert {ends(r): r["cross_class_candidate"] for r in rows("confirmed_edges")} == {k: v[1] for k, v in low.items() if v[2] == "yes"}
    label = closure(list(by_row), links)
    assert {r["row_no"]: r["component"] for r in rows("duplicate_components")} == label
    groups = {}
    for r in rows("group_manifest"):
        groups.setdefault(r["group_id"], set()).add(r["relative_path"])
    parts = {}
    for row, part in label.items():
        parts.setdefault(part, set()).add(by_row[row]["relative_path"])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, parts.values()))
    counts = {r["counter"]: int(r["value"]) for r in rows("audit_summary")}
    for name, decision in (("confirmed", "yes"), ("rejected", "no"), ("unresolved", "")):
        assert counts[f"{name}_near_duplicate_pairs"] == sum(v[2] == decision for v in want.values())
    open_ = {r["counter"]: int(r["value"]) for r in rows("audit_gate")}
    assert open_["unresolved_near_duplicate_pairs"] == counts["unresolved_near_duplicate_pairs"]
