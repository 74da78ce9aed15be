import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitwarden.functions import dates as D
from splitwarden.functions import grids as G
from splitwarden.functions import keys as K
from splitwarden.functions import probs as P
from splitwarden.functions import text as TX
from splitwarden.operators import advice as AD
from splitwarden.operators import images as IM
from splitwarden.sources import files as FI
from splitwarden.sources import knowledge as KN
from splitwarden.sources import sinks as SK
from splitwarden.sources import tables as TB


def write_png(path, pixels):
    height, width, _ = pixels.shape

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


@pytest.fixture()
def image_root(tmp_path):
    rng = np.random.default_rng(1)
    for name in ("leaf", "rust"):
        (tmp_path / name / "in").mkdir(parents=True)
    write_png(tmp_path / "leaf" / "a.PNG", rng.integers(0, 256, (10, 12, 3), dtype=np.uint8))
    write_png(tmp_path / "rust" / "in" / "b.png", np.full((5, 7, 3), 10, np.uint8))
    (tmp_path / "rust" / "broken.jpg").write_bytes(b"not an image")
    (tmp_path / "rust" / "notes.txt").write_text("skip")
    return tmp_path


def test_scan_probe_inventory(spark, image_root):
    names = TB.class_dictionary(spark, ["leaf", "rust"])
    files = FI.scan_labeled_files(spark, str(image_root), names)
    assert sorted(r[0] for r in files.select("relative_path").collect()) == [
        "leaf/a.PNG", "rust/broken.jpg", "rust/in/b.png",
    ]
    rows = {r["relative_path"]: r for r in FI.build_inventory(FI.probe_images(spark, str(image_root), files)).collect()}
    assert rows["leaf/a.PNG"]["width"] == 12 and rows["leaf/a.PNG"]["mode"] == "RGB"
    assert rows["rust/broken.jpg"]["readable"] is False and rows["rust/broken.jpg"]["sha256"] is None
    assert rows["rust/broken.jpg"]["error"]
    with pytest.raises(ValueError, match="fern"):
        FI.scan_labeled_files(spark, str(image_root), TB.class_dictionary(spark, ["leaf", "fern"]))


def test_scan_of_a_root_with_a_scheme(spark, image_root):
    names = TB.class_dictionary(spark, ["leaf", "rust"])
    for root in (f"file://{image_root}", f"file:{image_root}/"):
        files = FI.scan_labeled_files(spark, root, names)
        assert sorted(r[0] for r in files.select("relative_path").collect()) == [
            "leaf/a.PNG", "rust/broken.jpg", "rust/in/b.png",
        ]


def test_labeled_files_in_parts(spark, tmp_path):
    """A label's file is written by several tasks when it is large, holds all rows and counts once."""
    rows = spark.range(0, 20_000, 1, 8).select(
        F.when(F.col("id") % 100 == 0, "fr").otherwise("en").alias("lang"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    try:
        SK.write_labeled_files(rows, str(tmp_path / "out"), "lang")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)
    names = TB.class_dictionary(spark, ["lang=en", "lang=fr"])
    parts = FI.scan_labeled_files(spark, str(tmp_path / "out"), names, (".parquet",))
    counted = parts.groupBy("class_name").agg(
        F.count("*").alias("parts"), F.count_distinct(FI.file_of_part(F.col("relative_path"), (".parquet",))).alias("files")
    )
    got = {r["class_name"]: r for r in counted.collect()}
    assert {k: r["files"] for k, r in got.items()} == {"lang=en": 1, "lang=fr": 1}
    assert got["lang=en"]["parts"] >= 5
    back = spark.read.parquet(str(tmp_path / "out")).select("lang", "text")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_file_of_part(spark):
    paths = ["leaf/a.PNG", "leaf/in/b.png", "x.png/in/c.jpg", "leaf/set.png/p/1.png", "leaf/.png/d.png", "leaf/a.png.d/e.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(FI.file_of_part(F.col("p"))).collect()] == [
        "leaf/a.PNG", "leaf/in/b.png", "x.png/in/c.jpg", "leaf/set.png", "leaf/.png/d.png", "leaf/a.png.d/e.jpg",
    ]


def test_scan_query_reads_no_language_in_one_task(spark, tmp_path, monkeypatch):
    """No part of a language that has most of the documents is larger than the session advises."""
    from splitwarden.plans import catalog_audit

    rows = spark.range(0, 20_000, 1, 8).select(
        F.when(F.col("id") % 100 == 0, "fr").otherwise("en").alias("lang"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    advised = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    monkeypatch.setattr(catalog_audit, "scratch_path", lambda _, label: str(tmp_path / "kept" / label))
    try:
        got = catalog_audit.QUERIES["scan_labeled_files"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advised)
    assert sorted(map(tuple, got)) == [("lang=en", 1, True), ("lang=fr", 1, True)]
    parts = list((tmp_path / "kept").glob("labeled-files/lang=en/**/*.parquet"))
    assert len([p for p in parts if p.is_file()]) >= 5


def test_pixel_jobs(spark, image_root):
    images = (
        spark.read.format("image").option("dropInvalid", True)
        .option("recursiveFileLookup", True).load(str(image_root))
    )
    prepared = {r["origin"].rsplit("/", 1)[1]: r for r in IM.prepare_images(images, 16, "zero_one").collect()}
    assert len(prepared) == 2
    assert len(prepared["a.PNG"]["tensor"]) == 16 * 16 * 3
    assert np.allclose(prepared["b.png"]["tensor"], 10 / 255)
    quality = {r["origin"].rsplit("/", 1)[1]: r for r in IM.image_quality(images).collect()}
    assert quality["b.png"]["warnings"] == ["tooDark", "tooBlurry"]
    assert quality["a.PNG"]["warnings"] == []
    assert IM.image_dhash(images).count() == 2


def test_bilinear_midpoints():
    image = np.array([[0.0, 10.0], [20.0, 30.0]], np.float32)[:, :, None]
    assert np.allclose(IM.bilinear(image, 1, 1), 15.0)
    assert np.allclose(IM.bilinear(image, 2, 4)[0, :, 0], [0, 2.5, 7.5, 10])


def test_admission(spark):
    rows = [(b"\xff\xd8\xff\xe0x",), (b"\x89PNG\r\n\x1a\n",), (b"RIFF0000WEBPx",), (b"GIF8",), (b"",), (None,), (b"\xff\xd8\xff" + b"0" * 50,)]
    df = spark.createDataFrame(rows, "content binary")
    got = [(r["rejection"], r["status"]) for r in IM.admit_images(df, max_bytes=40).collect()]
    assert got == [
        (None, 200), (None, 200), ("no_decoder", 415), ("unsupported_format", 415),
        ("empty", 415), ("missing", 400), ("too_large", 413),
    ]


def test_grid_hash_and_quality(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 255, (8, 9))
    want = 0
    for bit in (grid[:, 1:] > grid[:, :-1]).ravel():
        want = want << 1 | int(bit)
    df = spark.createDataFrame([([float(x) for x in grid.ravel()],)], "g array<double>")
    row = df.select(K.hash_hex(G.dhash("g", 8, 9)).alias("h"), G.sharpness("g", 9, 8).alias("s")).first()
    g = grid.astype(float)
    inner = 4 * g[1:-1, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:] - g[:-2, 1:-1] - g[2:, 1:-1]
    assert row["h"] == f"{want:016x}" and abs(row["s"] - inner.var()) < 1e-6


def test_text_rules(spark):
    texts = [
        "Check the water and look for signs",
        "Use disease-free seed; do not plant snake_case",
        "nothing here",
        "   ",
        "",
        "Straße’s RE-USE don't ﬁne ΣΑΣ",
    ]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "i int, text string, lang string")
    got = {r["i"]: r["analysis"] for r in AD.analyze_texts(df).collect()}
    assert 4 not in got and got[3]["token_count"] == 0
    assert got[0]["category"] == "monitoring"
    assert got[0]["matched_terms"] == ["check", "look for", "signs"]
    assert got[0]["keywords"] == ["check", "look for", "signs", "water", "the"][:4] + ["look"]
    assert got[0]["formatted_text"] == "Monitoring: " + texts[0]
    # A hyphenated term is one token of weight 1, a phrase weighs 3.
    assert got[1]["category"] == "prevention"
    assert got[2]["category"] == "field_management" and got[2]["matched_terms"] == []
    tokens = df.filter("i = 5").select(TX.tokenize("text").alias("k")).first()["k"]
    assert tokens == ["strasse’s", "re-use", "don't", "fine", "σασ"]
    with pytest.raises(Exception, match="unsupported language"):
        AD.analyze_texts(df.withColumn("lang", F.lit("xx"))).collect()


def test_scalars(spark):
    df = spark.createDataFrame(
        [(" 'a b' ", "2024-6-1", 120.0), ('"x', "2024-02-30", float("nan")), ("y", "2024-12-01", None)],
        "p string, d string, c double",
    )
    rows = df.select(
        K.clean_path(F.col("p")), D.season(F.col("d")), D.display_date(F.col("d")), P.gauge_degrees(F.col("c"))
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("a b", "wet", "6/1/2024", 180.0), ('"x', None, "02/30/2024", 0.0), ("y", "dry", "12/01/2024", 0.0),
    ]
    with pytest.raises(Exception, match="YYYY-MM-DD"):
        df.select(D.season(F.col("d"), strict=True)).collect()


KNOWLEDGE = {
    "red_spot": {
        "en": {"name": "Red", "description": ["one", " ", "two"], "general": ["Spray now", "Drain water"],
               "season_notes": {"wet": "w", "dry": "d"}},
        "fil": {"name": "Pula", "description": "isa", "general": [], "season_notes": {}},
    },
    "fine": {"en": {"general": ["Check"]}},
}


def test_knowledge_and_bundle(spark, tmp_path):
    path, links = tmp_path / "k.json", tmp_path / "s.json"
    path.write_text(json.dumps(KNOWLEDGE))
    links.write_text(json.dumps({"red_spot": [{"title": "t", "url": "http://x.org"}]}))
    k = KN.load_knowledge(spark, str(path))
    bundles = AD.advice_bundles(k.meta, k.items, k.notes, KN.load_sources(spark, str(links)))
    preds = spark.createDataFrame([(1, "red_spot", "wet"), (2, "fine", "dry")], "id int, class_name string, season string")
    rows = {(r["id"], r["lang"]): r for r in AD.result_bundle(preds, bundles).collect()}
    assert set(rows) == {(1, "en"), (1, "fil"), (2, "en")}
    assert rows[1, "en"]["description"] == ["one", "two"] and rows[1, "en"]["season_note"] == "w"
    assert [a["category"] for a in rows[1, "en"]["recommendation_analysis"]] == ["treatment", "field_management"]
    assert rows[1, "fil"]["description"] == ["isa"] and rows[1, "fil"]["season_note"] == ""
    assert rows[2, "en"]["name"] == "fine" and rows[2, "en"]["sources"] == []
    lost = spark.createDataFrame([(3, "blue", "wet")], "id int, class_name string, season string")
    with pytest.raises(Exception, match="no advice for class blue"):
        AD.result_bundle(lost, bundles).collect()
    path.write_text("[1]")
    with pytest.raises(Exception, match="JSON object"):
        KN.load_knowledge(spark, str(path)).meta.collect()


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "labels.json").write_text('["a", "b"]')
    names = TB.load_class_names(spark, str(tmp_path / "labels.json"))
    assert names.count() == 2
    with pytest.raises(ValueError):
        TB.class_dictionary(spark, ["a", ""])
    assert TB.read_temperature(spark, str(tmp_path / "none.json")) == (1.0, False)
    (tmp_path / "t.json").write_text('{\n "temperature": 1.5}')
    assert TB.read_temperature(spark, str(tmp_path / "t.json")) == (1.5, True)
    (tmp_path / "t0.json").write_text('{"temperature": -1}')
    with pytest.raises(ValueError):
        TB.read_temperature(spark, str(tmp_path / "t0.json"))
    (tmp_path / "review.csv").write_bytes(
        "﻿relative_path_1,relative_path_2,decision,notes\nb,a,YES,n1\na,b,no,\n".encode()
    )
    review = TB.read_review(TB.read_review_csv(spark, str(tmp_path / "review.csv")))
    assert [tuple(r) for r in review.collect()] == [("a", "b", "no", "")]
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, v int")
    assert TB.read_runs(runs, ["r1", "r9"], strict=False).count() == 1
    with pytest.raises(FileNotFoundError, match="r9"):
        TB.read_runs(runs, ["r1", "r9"])
    rows = spark.createDataFrame(
        [("train", "c", "c/x/a.JPG"), ("train", "c", "c/x__a.JPG"), ("test", "c", "c/x/a.JPG")],
        "split string, class_name string, relative_path string",
    )
    got = {r["relative_path"]: r["destination_relative_path"] for r in SK.split_destinations(rows).filter("split = 'train'").collect()}
    assert got == {"c/x/a.JPG": "train/c/x__a.JPG", "c/x__a.JPG": "train/c/x__a_1.jpg"}
    SK.materialize_split(rows, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).filter("split = 'test'").count() == 1


def test_split_files_are_few_and_reads_are_pruned(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'test' ELSE 'validation' END AS split",
        "concat('c', cast(id % 4 AS string)) AS class_name", "concat('c', cast(id % 4 AS string), '/', cast(id AS string), '.png') AS relative_path",
    ).repartition(64)
    path = str(tmp_path / "sized")
    SK.materialize_split(rows, path)
    files = [f for f in (tmp_path / "sized").rglob("*.parquet")]
    assert 10 <= len(files) <= 20
    read = spark.read.parquet(path).filter("split = 'test'")
    assert read.count() == 600 and "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().toString()


def test_run_folders_strict_and_lenient(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "run string, file string, v int")
    rows.write.partitionBy("run", "file").option("header", True).csv(str(tmp_path / "runs"))
    root, required = str(tmp_path / "runs"), ["x", "y"]
    found = {r["run"]: (r["missing"], r["complete"]) for r in TB.discover_runs(spark, root, required).collect()}
    assert found == {"a": ([], True), "b": (["y"], False)}
    assert [r["v"] for r in TB.read_run_table(spark, root, "x", "v int", required, strict=False).collect()] == [1]
    with pytest.raises(Exception, match="incomplete run b: y"):
        TB.read_run_table(spark, root, "x", "v int", required).collect()
    absent = spark.createDataFrame([("a",), ("z",)], "run string")
    with pytest.raises(Exception, match="incomplete run z: x, y"):
        TB.read_run_table(spark, root, "x", "v int", required, absent).collect()


def test_the_last_review_row_wins_across_files_and_splits(spark, tmp_path):
    (tmp_path / "review").mkdir()
    header = "relative_path_1,relative_path_2,decision,notes\n"
    first = "".join(f"a{i},b{i},no,old\n" for i in range(400)) + "".join(f"a{i},b{i},yes,mid\n" for i in range(400))
    (tmp_path / "review" / "1.csv").write_text(header + first)
    (tmp_path / "review" / "2.csv").write_text(header + 'b7,a7,n,"said ""no"",\ntwice"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, multi in (("134217728", True), ("1000", True), ("1000", False)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            table = TB.read_review_csv(spark, str(tmp_path / "review"), multi_line=multi)
            rows = {r["relative_path_1"]: (r["decision"], r["notes"]) for r in TB.read_review(table, strict=multi).collect()}
            assert rows["a3"] == ("yes", "mid") and len([k for k in rows if k.startswith("a")]) == 400
            if multi:
                assert rows["a7"] == ("no", 'said "no",\ntwice')
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
