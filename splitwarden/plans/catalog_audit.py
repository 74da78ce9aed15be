"""Duplicate audit, split and fold queries."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import functions as F

from splitwarden.functions import keys as KEYS
from splitwarden.functions import png as PNG
from splitwarden.operators import audit as A
from splitwarden.operators import components as CC
from splitwarden.operators import exact as EX
from splitwarden.operators import folds as FO
from splitwarden.operators import images as IM
from splitwarden.operators import near as NE
from splitwarden.operators import splits as SP
from splitwarden.operators.fingerprint import text_cells, text_fingerprint
from splitwarden.plans import fixtures as X
from splitwarden.plans.audit_job import run_audit
from splitwarden.plans.fixtures import round_cols
from splitwarden.sources import files as FI
from splitwarden.sources import sinks as SK
from splitwarden.sources import tables as TB
from splitwarden.operators.scale import materialise, release, scratch_path, spread

QUERIES: dict = {}
SQL: dict[str, str] = {}
T = X.THRESHOLD
HEX = "lpad(lower(hex(h)), 16, '0')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# --- sources -------------------------------------------------------------------------------


@query(
    "scan_labeled_files",
    "SELECT 'lang=' || lang AS class_name, count(DISTINCT lang) AS files, true AS filled "
    "FROM documents GROUP BY lang",
)
def scan(spark, sf):
    """Documents written to one folder per language, found again by the scan."""
    documents = X.table(spark, sf, "documents")
    root = scratch_path(spark, "labeled-files")
    SK.write_labeled_files(documents.select("lang", "text"), root, "lang")
    listed = documents.select("lang").distinct().orderBy("lang").collect()
    classes = TB.class_dictionary(spark, [f"lang={r['lang']}" for r in listed])
    parts = FI.scan_labeled_files(spark, root, classes, (".parquet",))
    # The number of files is part of the result; a file counts once, however many parts it has.
    files = parts.withColumn("file", FI.file_of_part(F.col("relative_path"), (".parquet",)))
    return files.groupBy("class_name").agg(
        F.count_distinct("file").alias("files"), F.bool_and(F.col("length") > 0).alias("filled")
    )


@query(
    "inventory",
    f"""WITH {X.RECORDS_SQL} SELECT class_name, relative_path, '/data/' || relative_path AS path,
  readable, CASE WHEN readable THEN '' ELSE 'empty text' END AS error,
  CASE WHEN readable THEN sha256 END AS sha256, CASE WHEN readable THEN {HEX} END AS dhash_hex,
  CASE WHEN readable THEN width END AS width, CASE WHEN readable THEN 1 END AS height,
  CASE WHEN readable THEN 'T' END AS mode FROM rec""",
)
def inventory(spark, sf):
    rows = X.records(spark, sf).withColumn("error", F.lit("empty text"))
    return FI.build_inventory(rows)


IMAGES_SQL = """
im AS (
  SELECT vec_id, 'class_' || CAST(label AS VARCHAR) AS class_name,
    printf('class_%d/%d/%06d.%s', label, vec_id % 10, vec_id,
      CASE WHEN vec_id % 13 = 0 THEN 'txt' WHEN vec_id % 2 = 0 THEN 'png' ELSE 'PNG' END) AS relative_path,
    vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS readable, 4 + vec_id % 5 AS w, 3 + vec_id % 4 AS h,
    CASE vec_id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' ELSE 'RGBA' END AS mode
  FROM embeddings WHERE vec_id % 13 <> 0)"""


def _image_rows(batches):
    """PNG files made of embeddings; some are cut off, some are no images."""
    for batch in batches:
        paths, contents = [], []
        for vec_id, label, values in zip(*[c.to_pylist() for c in batch.columns]):
            suffix = "txt" if vec_id % 13 == 0 else "png" if vec_id % 2 == 0 else "PNG"
            width, height, channels = 4 + vec_id % 5, 3 + vec_id % 4, (1, 3, 4)[vec_id % 3]
            levels = bytes(max(0, min(255, round((v + 1) * 127.5))) for v in values)
            size = width * height * channels
            content = PNG.encode((levels * (size // len(levels) + 1))[:size], width, height, channels)
            if vec_id % 7 == 0:
                content = content[:20]
            elif vec_id % 11 == 0:
                content = b"not an image"
            paths.append(f"class_{label}/{vec_id % 10}/{vec_id:06d}.{suffix}")
            contents.append(content)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["relative_path", "content"])


@query(
    "probe_image_files",
    f"""WITH {IMAGES_SQL} SELECT class_name, relative_path, readable,
  CASE WHEN NOT readable THEN 'cannot identify image file' END AS error,
  CASE WHEN readable THEN CAST(w AS INTEGER) END AS width, CASE WHEN readable THEN CAST(h AS INTEGER) END AS height,
  CASE WHEN readable THEN mode END AS mode, true AS digest_matches FROM im""",
)
def probe_image_files(spark, sf):
    """Image files written by tasks, found by their class folders, decoded and described."""
    rows = X.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    images = materialise(rows.mapInArrow(_image_rows, "relative_path string, content binary"), "images")
    root = scratch_path(spark, "image-files")
    SK.write_binary_files(images, root)
    labels = [r["label"] for r in rows.select("label").distinct().orderBy("label").collect()]
    classes = TB.class_dictionary(spark, [f"class_{n}" for n in labels])
    files = FI.scan_labeled_files(spark, root, classes)
    probed = FI.probe_images(spark, FI.class_folders(spark, root, classes), files)
    written = images.select("relative_path", F.sha2("content", 256).alias("written"))
    same = F.coalesce(F.col("sha256") == F.col("written"), ~F.col("readable"))
    return probed.join(written, "relative_path").select(
        "class_name", "relative_path", "readable", "error", "width", "height", "mode", same.alias("digest_matches")
    )


@query(
    "content_digest",
    "SELECT doc_id, sha256(text) AS sha256 FROM documents",
)
def digest(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "text_cells",
    f"WITH {X.FINGERPRINT_SQL} SELECT doc_id, cell, CAST(n AS BIGINT) AS n FROM cells",
)
def cells(spark, sf):
    return text_cells(spread(X.table(spark, sf, "documents")))


@query(
    "text_fingerprint",
    f"WITH {X.FINGERPRINT_SQL} SELECT doc_id, {HEX} AS dhash_hex FROM fp",
)
def fingerprint(spark, sf):
    prints = text_fingerprint(spread(X.table(spark, sf, "documents")))
    return prints.select("doc_id", KEYS.hash_hex(F.col("dhash")).alias("dhash_hex"))


EMBEDDING_BITS_SQL = """
cell AS (
  SELECT vec_id, g.range AS i, embedding[g.range + 1] AS v FROM embeddings, range(64) g),
bit AS (
  SELECT a.vec_id, (a.i // 8) * 7 + a.i % 8 AS b, n.v > a.v AS lit
  FROM cell a JOIN cell n ON n.vec_id = a.vec_id AND n.i = a.i + 1 WHERE a.i % 8 < 7),
eh AS (
  SELECT vec_id, CAST(sum(CASE WHEN lit THEN CAST(pow(2, 55 - b) AS UBIGINT) ELSE 0 END) AS UBIGINT) AS h
  FROM bit GROUP BY vec_id)"""


def embedding_hashes(spark, sf):
    from splitwarden.functions import grids as G

    e = X.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", G.dhash("embedding", 8, 8).alias("dhash"))


@query(
    "grid_dhash",
    f"WITH {EMBEDDING_BITS_SQL} SELECT vec_id, {HEX} AS dhash_hex FROM eh",
)
def grid_dhash(spark, sf):
    return embedding_hashes(spark, sf).select(
        "vec_id", KEYS.hash_hex(F.col("dhash")).alias("dhash_hex")
    )


RESIZED = [(5, 7), (11, 13)]


@query(
    "grid_resize",
    f"""WITH size(new_rows, new_cols) AS (VALUES {', '.join(str(s) for s in RESIZED)}),
spot AS (
  SELECT new_rows, new_cols, r.range AS r, c.range AS c,
    greatest((r.range + 0.5::DOUBLE) * 8 / new_rows - 0.5::DOUBLE, 0) AS y,
    greatest((c.range + 0.5::DOUBLE) * 8 / new_cols - 0.5::DOUBLE, 0) AS x
  FROM size, range(13) r, range(13) c WHERE r.range < new_rows AND c.range < new_cols),
tap AS (
  SELECT *, CAST(least(floor(y), 7) AS INTEGER) AS top, CAST(least(floor(x), 7) AS INTEGER) AS lft FROM spot),
px AS (
  SELECT vec_id, new_rows, new_cols, r * new_cols + c AS cell, y - top AS dy, x - lft AS dx,
    embedding[top * 8 + lft + 1]::DOUBLE AS a, embedding[top * 8 + least(lft + 1, 7) + 1]::DOUBLE AS b,
    embedding[least(top + 1, 7) * 8 + lft + 1]::DOUBLE AS d, embedding[least(top + 1, 7) * 8 + least(lft + 1, 7) + 1]::DOUBLE AS e
  FROM embeddings, tap)
SELECT vec_id, new_rows, new_cols, CAST(cell AS INTEGER) AS cell,
  round((a * (1 - dx) + b * dx) * (1 - dy) + (d * (1 - dx) + e * dx) * dy, 5) + 0.0::DOUBLE AS value FROM px""",
)
def grid_resize(spark, sf):
    """Grids of the embeddings made smaller and larger, in built-in functions."""
    from splitwarden.functions import grids as G

    grids = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    sizes = F.array(*[F.struct(F.lit(r).alias("new_rows"), F.lit(c).alias("new_cols"), G.resize("embedding", 8, 8, r, c).alias("cells")) for r, c in RESIZED])
    sized = grids.select("vec_id", F.explode(sizes).alias("s")).select("vec_id", "s.new_rows", "s.new_cols", F.posexplode("s.cells").alias("cell", "value"))
    return sized.withColumn("value", F.round("value", 5) + F.lit(0.0))  # no negative zero


@query(
    "hamming_to_nearest_hash",
    f"""WITH {EMBEDDING_BITS_SQL} SELECT a.vec_id AS vec_id,
  CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM eh a JOIN eh b ON b.vec_id = a.vec_id + 1""",
)
def hamming(spark, sf):
    h = embedding_hashes(spark, sf).select("vec_id", "dhash")
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("dhash").alias("other"))
    return h.join(nxt, "vec_id").select(
        "vec_id", KEYS.hamming(F.col("dhash"), F.col("other")).alias("distance")
    )


# --- exact and near duplicates -------------------------------------------------------------

EXACT_SQL = """
eg AS (
  SELECT sha256, count(*) AS group_size, min(relative_path) AS first_path,
    count(DISTINCT class_name) > 1 AS cross_class FROM rec GROUP BY sha256 HAVING count(*) >= 2),
en AS (SELECT *, row_number() OVER (ORDER BY first_path) AS number FROM eg)"""


@query(
    "exact_duplicates",
    f"""WITH {X.RECORDS_SQL}, {EXACT_SQL} SELECT printf('EXACT_%04d', number) AS exact_group_id,
  sha256, class_name, relative_path, '/data/' || relative_path AS path,
  CAST(group_size AS BIGINT) AS group_size, cross_class AS cross_class_duplicate
FROM rec JOIN en USING (sha256)""",
)
def exact(spark, sf):
    return EX.exact_duplicates(X.records(spark, sf))


@query(
    "exact_summary",
    f"""WITH {X.RECORDS_SQL}, {EXACT_SQL} SELECT count(*) AS exact_duplicate_groups,
  CAST(sum(group_size) AS BIGINT) AS files_in_exact_duplicate_groups,
  CAST(sum(group_size - 1) AS BIGINT) AS redundant_exact_copies,
  count(*) FILTER (cross_class) AS cross_class_exact_duplicate_groups FROM eg""",
)
def exact_summary(spark, sf):
    return EX.exact_summary(EX.content_groups(X.records(spark, sf)))


@query(
    "near_duplicates",
    f"""WITH {X.RECORD_PAIRS_SQL} SELECT
  printf('NEAR_%05d', row_number() OVER (ORDER BY dhash_distance, relative_path_1, relative_path_2)) AS pair_id,
  relative_path_1, class_1, relative_path_2, class_2, CAST(dhash_distance AS INTEGER) AS dhash_distance,
  cross_class_candidate, n_pairs FROM pairs""",
)
def near(spark, sf):
    pairs = X.record_pairs(spark, sf).select(
        "relative_path_1",
        "class_1",
        "relative_path_2",
        "class_2",
        "dhash_distance",
        "cross_class_candidate",
        "n_pairs",
    )
    return NE.number_pairs(pairs)


@query(
    "near_duplicate_members",
    f"""WITH {X.PAIRS_SQL}, linked AS (
  SELECT row_1 AS row_no, count(*) AS n FROM (SELECT row_1 FROM pairs UNION ALL SELECT row_2 FROM pairs) GROUP BY 1)
SELECT rec.relative_path, r.relative_path AS representative, cell.n AS copies, CAST(linked.n AS BIGINT) AS n_links
FROM rec JOIN linked USING (row_no) JOIN cell ON cell.sha256 = rec.sha256 AND cell.class_name = rec.class_name
JOIN rec r ON r.row_no = cell.row_no""",
)
def near_members(spark, sf):
    """From every record with a near duplicate to the record that stands for it in the list."""
    members = NE.near_members(X.records(spark, sf), X.near_pairs(spark, sf))
    return members.select("relative_path", "representative", "copies", "n_links")


@query(
    "near_hash_pairs",
    f"""WITH {EMBEDDING_BITS_SQL}, d AS (SELECT DISTINCT h FROM eh)
SELECT lpad(lower(hex(a.h)), 16, '0') AS hash_1, lpad(lower(hex(b.h)), 16, '0') AS hash_2,
  CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM d a JOIN d b ON a.h < b.h
WHERE bit_count(xor(a.h, b.h)) <= 12""",
)
def near_hashes(spark, sf):
    pairs = NE.near_hash_pairs(embedding_hashes(spark, sf), 12, bits=56)
    return pairs.select(
        KEYS.hash_hex(F.col("h1")).alias("hash_1"),
        KEYS.hash_hex(F.col("h2")).alias("hash_2"),
        "distance",
    )


@query(
    "near_pair_totals",
    f"""WITH {X.PAIRS_SQL} SELECT CAST(dhash_distance AS INTEGER) AS dhash_distance,
  CAST(count(*) AS DECIMAL(38, 0)) AS pairs,
  CAST(count(*) FILTER (cross_class_candidate) AS DECIMAL(38, 0)) AS cross_class_pairs
FROM pairs GROUP BY 1""",
)
def near_totals(spark, sf):
    return NE.near_pair_totals(X.records(spark, sf), T)


@query(
    "review_read",
    f"""WITH {X.RECORD_PAIRS_SQL} SELECT least(relative_path_1, relative_path_2) AS relative_path_1,
  greatest(relative_path_1, relative_path_2) AS relative_path_2, decision, '' AS notes
FROM reviewed""",
)
def review_read(spark, sf):
    return TB.read_review(X.review_rows(spark, sf, X.record_pairs(spark, sf)))


REVIEW_FILE_ROWS = 200_000
# Rows of both rounds that lie on disk as review files at once.
REVIEW_ROWS = 4_000_000


@query(
    "review_csv_files",
    f"""WITH {X.PAIRS_SQL} SELECT least(relative_path_1, relative_path_2) AS relative_path_1,
  greatest(relative_path_1, relative_path_2) AS relative_path_2, decision,
  'said "' || least(relative_path_1, relative_path_2) || '",' || chr(10) || 'twice' AS notes
FROM reviewed WHERE listed""",
)
def review_csv_files(spark, sf):
    """Review files of two rounds with a byte order mark, quotes and line ends in fields; the later wins."""
    rows = X.review_rows(spark, sf).drop("line_no", "notes").withColumn(
        "notes",
        F.concat(F.lit('said "'), F.trim(F.least(F.trim("relative_path_1"), F.trim("relative_path_2"))), F.lit('",\ntwice')),
    )
    parts = -(-2 * X.near_pairs(spark, sf).count() // REVIEW_ROWS)
    if parts <= 1:
        return TB.read_review(_review_files(rows))
    # All rows of a pair are in one part, whose files go when it is read.
    pair = KEYS.pair_key(*[F.trim(c) for c in ("relative_path_1", "relative_path_2")])
    part = F.pmod(F.xxhash64(pair), F.lit(parts))
    path = scratch_path(spark, "review")
    for k in range(parts):
        files = _review_files(rows.filter(part == k))
        found = TB.read_review(files)
        found.write.mode("append").parquet(path)
        release(files)
    return spark.read.schema(found.schema).parquet(path)


def _review_files(rows):
    """The rows of a second round written as review files behind those of a first, and read again."""
    spark = rows.sparkSession
    root = scratch_path(spark, "review-files")
    second = rows.withColumnRenamed("relative_path_1", "\ufeffrelative_path_1")
    first = second.withColumns({"decision": F.lit("no"), "notes": F.lit("first round")})
    # A file with line ends in fields is read by one task, so its rows are bounded. A round is written
    # as its rows are read: nothing is shuffled or sorted for it.
    for number, part in enumerate((first, second), 1):
        part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).option("maxRecordsPerFile", REVIEW_FILE_ROWS).csv(f"{root}/round={number}")
    files = TB.read_review_csv(spark, root)
    files.scratch_path = root
    return files


@query(
    "apply_review",
    f"""WITH {X.RECORD_PAIRS_SQL} SELECT relative_path_1, relative_path_2, decision, '' AS notes, n_pairs
FROM reviewed""",
)
def apply_review(spark, sf):
    return X.reviewed_records(spark, sf).select(
        "relative_path_1", "relative_path_2", "decision", "notes", "n_pairs"
    )


AUTO = "CASE WHEN decision = '' AND NOT cross_class_candidate THEN"


@query(
    "auto_group",
    f"""WITH {X.RECORD_PAIRS_SQL} SELECT relative_path_1, relative_path_2,
  {AUTO} 'yes' ELSE decision END AS decision,
  {AUTO} '{NE.AUTO_NOTE.format(threshold=T)}' ELSE '' END AS notes FROM reviewed""",
)
def auto_group(spark, sf):
    return NE.auto_group(X.reviewed_records(spark, sf), T).select(
        "relative_path_1", "relative_path_2", "decision", "notes"
    )


@query(
    "confirmed_edges",
    f"""WITH {X.RECORD_PAIRS_SQL} SELECT least(relative_path_1, relative_path_2) AS relative_path_1,
  greatest(relative_path_1, relative_path_2) AS relative_path_2, cross_class_candidate
FROM reviewed WHERE decision = 'yes'""",
)
def confirmed(spark, sf):
    review = TB.read_review(X.review_rows(spark, sf, X.record_pairs(spark, sf)))
    return NE.confirmed_by_path(review, X.records(spark, sf)).select(
        "relative_path_1", "relative_path_2", "cross_class_candidate"
    )


# --- components, manifest, summary, gate ---------------------------------------------------

NEAR_LINKS_SQL = """
nl AS (SELECT row_2 AS src, row_1 AS dst FROM reviewed
       WHERE decision = 'yes' AND NOT cross_class_candidate)"""
AUTO_LINKS_SQL = """
nl AS (SELECT row_2 AS src, row_1 AS dst FROM pairs WHERE NOT cross_class_candidate)"""


def chain(links: str, pairs: str = X.PAIRS_SQL) -> str:
    return f"{pairs}, {X.EXACT_LINKS_SQL}, {links}, {X.COMPONENT_SQL}"


@query(
    "duplicate_components",
    f"WITH RECURSIVE {chain(NEAR_LINKS_SQL, X.RECORD_PAIRS_SQL)} SELECT row_no, component FROM comp",
)
def components(spark, sf):
    recs = X.records(spark, sf)
    links = EX.exact_edges(recs).union(NE.confirmed_edges(X.reviewed_records(spark, sf)))
    return CC.duplicate_components(recs.select("row_no"), links)


@query(
    "auto_components",
    f"WITH RECURSIVE {chain(AUTO_LINKS_SQL)} SELECT row_no, component FROM comp",
)
def auto_components(spark, sf):
    recs = X.records(spark, sf)
    links = EX.exact_edges(recs).union(NE.auto_edges(recs, T))
    return CC.duplicate_components(recs.select("row_no"), links)


MANIFEST_SQL = """
fl AS (
  SELECT row_no, max(e) AS e, max(n) AS n FROM (
    SELECT src AS row_no, 1 AS e, 0 AS n FROM el UNION ALL SELECT dst, 1, 0 FROM el
    UNION ALL SELECT src, 0, 1 FROM nl UNION ALL SELECT dst, 0, 1 FROM nl) GROUP BY row_no),
mem AS (SELECT rec.*, component, coalesce(e, 0) AS e, coalesce(n, 0) AS n
        FROM rec JOIN comp USING (row_no) LEFT JOIN fl USING (row_no)),
gp AS (SELECT component, class_name, count(*) AS group_size, max(e) AS e, max(n) AS n
       FROM mem GROUP BY ALL),
gn AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY component) AS number FROM gp),
man AS (
  SELECT printf('%s_G%04d', mem.class_name, number) AS group_id, mem.class_name, relative_path,
    sha256, lpad(lower(hex(h)), 16, '0') AS dhash_hex, CAST(group_size AS BIGINT) AS group_size,
    CASE WHEN group_size = 1 THEN 'singleton'
         WHEN gn.e = 1 AND gn.n = 1 THEN 'exact_and_confirmed_near'
         WHEN gn.e = 1 THEN 'exact' WHEN gn.n = 1 THEN 'confirmed_near'
         ELSE 'linked_group' END AS grouping_basis
  FROM mem JOIN gn USING (component))"""


def manifest(spark, sf):
    """Groups by the decision on each pair of records."""

    def build():
        recs = X.records(spark, sf)
        return A.group_manifest(
            recs, EX.exact_edges(recs), NE.confirmed_edges(X.reviewed_records(spark, sf))
        )

    return X.remembered(spark, sf, "manifest", build)


def cell_manifest(spark, sf):
    """Groups by one decision for all copies of two contents."""

    def build():
        recs = X.records(spark, sf)
        return A.group_manifest(
            recs, EX.exact_edges(recs), NE.confirmed_edges(X.reviewed_pairs(spark, sf), recs)
        )

    return X.remembered(spark, sf, "cell-manifest", build)


@query(
    "group_manifest",
    f"""WITH RECURSIVE {chain(NEAR_LINKS_SQL, X.RECORD_PAIRS_SQL)}, {MANIFEST_SQL} SELECT group_id, class_name,
  relative_path, sha256, dhash_hex, group_size, grouping_basis FROM man""",
)
def group_manifest(spark, sf):
    return manifest(spark, sf).select(
        "group_id", "class_name", "relative_path", "sha256", "dhash_hex", "group_size",
        "grouping_basis",
    )


SUMMARY_SQL = """
sz AS (SELECT group_id, class_name, count(*) AS n FROM man GROUP BY ALL),
sm AS (
  SELECT 'supported_image_files_found' AS counter, count(*) AS value FROM rec
  UNION ALL SELECT 'readable_image_files', count(*) FILTER (readable) FROM rec
  UNION ALL SELECT 'unreadable_image_files', count(*) FILTER (NOT readable) FROM rec
  UNION ALL SELECT 'exact_duplicate_groups', count(*) FROM xg
  UNION ALL SELECT 'files_in_exact_duplicate_groups', coalesce(sum(group_size), 0) FROM xg
  UNION ALL SELECT 'redundant_exact_copies', coalesce(sum(group_size - 1), 0) FROM xg
  UNION ALL SELECT 'cross_class_exact_duplicate_groups', count(*) FILTER (cross_class) FROM xg
  UNION ALL SELECT 'potential_near_duplicate_pairs', count(*) FROM rv
  UNION ALL SELECT 'confirmed_near_duplicate_pairs', count(*) FILTER (decision = 'yes') FROM rv
  UNION ALL SELECT 'rejected_near_duplicate_pairs', count(*) FILTER (decision = 'no') FROM rv
  UNION ALL SELECT 'unresolved_near_duplicate_pairs', count(*) FILTER (decision = '') FROM rv
  UNION ALL SELECT 'cross_class_near_duplicate_candidates', count(*) FILTER (cross_class_candidate) FROM rv
  UNION ALL SELECT 'confirmed_cross_class_near_pairs',
    count(*) FILTER (decision = 'yes' AND cross_class_candidate) FROM rv
  UNION ALL SELECT 'final_duplicate_groups', count(*) FROM sz
  UNION ALL SELECT 'non_singleton_groups', count(*) FILTER (n > 1) FROM sz
  UNION ALL SELECT 'largest_group_size', max(n) FROM sz
  UNION ALL SELECT 'class_file_counts.' || class_name, sum(n) FROM sz GROUP BY class_name
  UNION ALL SELECT 'class_group_counts.' || class_name, count(*) FROM sz GROUP BY class_name)"""
XG_SQL = """
xg AS (SELECT sha256, count(*) AS group_size, count(DISTINCT class_name) > 1 AS cross_class
       FROM rec GROUP BY sha256 HAVING count(*) >= 2)"""


def summary(spark, sf, pairs, groups):
    recs = X.records(spark, sf)
    return A.audit_summary(
        FI.build_inventory(recs),
        EX.exact_summary(EX.content_groups(recs)),
        A.decision_counts(pairs),
        groups,
        X.classes(spark),
    )


def whole_summary(spark, sf):
    """The counters of all record pairs, a row of the list for each."""
    return summary(spark, sf, X.reviewed_records(spark, sf).drop("n_pairs"), manifest(spark, sf))


@query(
    "audit_summary",
    f"""WITH RECURSIVE {chain(NEAR_LINKS_SQL, X.RECORD_PAIRS_SQL)}, {MANIFEST_SQL}, {XG_SQL},
rv AS (SELECT * FROM reviewed), {SUMMARY_SQL}
SELECT counter, CAST(value AS DECIMAL(38, 0)) AS value FROM sm""",
)
def audit_summary(spark, sf):
    return whole_summary(spark, sf)


@query(
    "audit_gate",
    f"""WITH RECURSIVE {chain(NEAR_LINKS_SQL, X.RECORD_PAIRS_SQL)}, {MANIFEST_SQL}, {XG_SQL},
rv AS (SELECT * FROM reviewed), {SUMMARY_SQL},
why(counter, reason) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in A.BLOCKERS.items())})
SELECT counter, CAST(value AS DECIMAL(38, 0)) AS value, reason FROM sm JOIN why USING (counter) WHERE value > 0""",
)
def audit_gate(spark, sf):
    return A.audit_gate(whole_summary(spark, sf))


@query(
    "audit_gate_waived",
    f"""WITH RECURSIVE {chain(NEAR_LINKS_SQL)}, {MANIFEST_SQL}, {XG_SQL},
rv AS (SELECT * FROM reviewed), {SUMMARY_SQL},
why(counter, reason) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in A.BLOCKERS.items())})
SELECT counter, CAST(value AS DECIMAL(38, 0)) AS value, reason FROM sm JOIN why USING (counter)
WHERE value > 0 AND counter <> 'unresolved_near_duplicate_pairs'""",
)
def audit_gate_waived(spark, sf):
    """The gate when pairs without a decision are accepted."""
    decided = summary(spark, sf, X.reviewed_pairs(spark, sf), cell_manifest(spark, sf))
    return A.audit_gate(decided, allow_unreviewed=True)


@query(
    "auto_audit_summary",
    f"""WITH RECURSIVE {chain(AUTO_LINKS_SQL)}, {MANIFEST_SQL}, {XG_SQL},
rv AS (SELECT *, CASE WHEN cross_class_candidate THEN '' ELSE 'yes' END AS decision FROM pairs),
{SUMMARY_SQL} SELECT counter, CAST(value AS DECIMAL(38, 0)) AS value FROM sm""",
)
def auto_audit(spark, sf):
    return run_audit(X.records(spark, sf), X.classes(spark), T).summary


@query(
    "class_counts",
    "SELECT l AS class_name, count(lang) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr')) v(l) "
    "LEFT JOIN documents ON lang = l GROUP BY l",
)
def class_counts(spark, sf):
    return A.class_counts(X.records(spark, sf), X.classes(spark))


# --- splits --------------------------------------------------------------------------------

TARGETS_SQL = """
tg AS (
  SELECT class_index, class_name, count(*) AS total,
    CAST(round_even(count(*) * 0.2, 0) AS BIGINT) AS test,
    CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS validation
  FROM og GROUP BY ALL)"""


@query(
    "split_targets",
    f"""WITH {X.ORDER_GROUPS_SQL}, {TARGETS_SQL} SELECT class_index, class_name,
  total AS total_class_images, test, validation, total - test - validation AS train FROM tg""",
)
def targets(spark, sf):
    return SP.split_targets(X.order_groups(spark, sf))


RANK_SQL = """
gs AS (SELECT group_id, class_index, count(*) AS group_size FROM og GROUP BY ALL),
rg AS (
  SELECT *, row_number() OVER (PARTITION BY class_index, group_size
    ORDER BY md5(CAST(42 + class_index AS VARCHAR) || ':' || group_id), group_id) AS rank FROM gs)"""


@query(
    "seeded_group_order",
    f"""WITH {X.ORDER_GROUPS_SQL}, {RANK_SQL} SELECT group_id, class_index,
  CAST(group_size AS BIGINT) AS group_size, rank FROM rg""",
)
def seeded(spark, sf):
    return SP.ranked_groups(SP.group_sizes(X.order_groups(spark, sf)), 42)


def split(spark, sf):
    return X.remembered(
        spark, sf, "split", lambda: SP.group_split(X.order_groups(spark, sf))
    )


@query(
    "group_split",
    f"""WITH {X.ORDER_GROUPS_SQL}, {TARGETS_SQL},
ng AS (SELECT class_index, count(DISTINCT group_id) AS groups FROM og GROUP BY 1)
SELECT class_name, s.split, CASE s.split WHEN 'test' THEN test WHEN 'validation' THEN validation
    ELSE total - test - validation END AS target_image_count,
  CASE s.split WHEN 'test' THEN test WHEN 'validation' THEN validation
    ELSE total - test - validation END AS actual_image_count,
  CAST(0 AS BIGINT) AS difference_from_target, total AS total_class_images,
  groups AS total_class_groups
FROM tg JOIN ng USING (class_index), (VALUES ('train'), ('validation'), ('test')) s(split)""",
)
def group_split(spark, sf):
    return SP.split_summary(SP.group_split(X.order_groups(spark, sf))).drop("group_count")


@query(
    "split_plan",
    f"""WITH {X.ORDER_GROUPS_SQL}, {TARGETS_SQL} SELECT CAST(class_index AS INTEGER) AS class_index, test, validation,
  CAST(0 AS BIGINT) AS error, true AS proven FROM tg""",
)
def split_plan(spark, sf):
    return SP.split_plan(X.order_groups(spark, sf))


@query(
    "group_split_documents",
    f"""WITH RECURSIVE {chain(NEAR_LINKS_SQL)}, {MANIFEST_SQL},
og AS (SELECT class_name, list_position(['de', 'en', 'es', 'fr'], class_name) AS class_index, group_id FROM man),
{TARGETS_SQL}
SELECT class_name, s.split, CASE s.split WHEN 'test' THEN test WHEN 'validation' THEN validation
    ELSE total - test - validation END AS actual_image_count, CAST(0 AS BIGINT) AS difference_from_target
FROM tg, (VALUES ('train'), ('validation'), ('test')) s(split)""",
)
def split_docs(spark, sf):
    done = SP.group_split(cell_manifest(spark, sf))
    return SP.split_summary(done).select(
        "class_name", "split", "actual_image_count", "difference_from_target"
    )


@query(
    "leakage_after_split",
    f"""WITH RECURSIVE {chain(NEAR_LINKS_SQL)}, {MANIFEST_SQL}
SELECT k AS kind, CAST(0 AS BIGINT) AS n, (SELECT count(*) FROM man) AS rows
FROM (VALUES ('group_in_several_splits'), ('group_with_several_classes'), ('content_in_several_splits')) v(k)""",
)
def leakage_none(spark, sf):
    """The document manifest holds equal contents, so the content rule has something to find."""
    kinds = ["group_in_several_splits", "group_with_several_classes", "content_in_several_splits"]
    done = SP.group_split(cell_manifest(spark, sf))
    counts = SP.leakage_report(done).groupBy("kind").agg(F.count("*").alias("n"))
    listed = done.agg(F.count("*").alias("rows")).withColumn(
        "kind", F.explode(F.array(*[F.lit(k) for k in kinds]))
    )
    return listed.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), "rows")


@query(
    "leakage_report",
    """WITH m AS (
  SELECT CAST(o_custkey % 400 AS VARCHAR) AS group_id,
    CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split,
    substr(o_orderpriority, 1, 1) AS class_name, sha256(CAST(o_totalprice AS VARCHAR)) AS sha256,
    CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS VARCHAR) AS price FROM orders)
SELECT 'group_in_several_splits' AS kind, group_id AS key FROM m GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'group_with_several_classes', group_id FROM m GROUP BY 2 HAVING count(DISTINCT class_name) > 1
UNION ALL SELECT 'content_in_several_splits', price FROM m GROUP BY 2 HAVING count(DISTINCT split) > 1""",
)
def leakage(spark, sf):
    o = X.table(spark, sf, "orders")
    m = o.select(
        (F.col("o_custkey") % 400).cast("string").alias("group_id"),
        F.when(F.col("o_orderkey") % 10 < 7, "train").otherwise("test").alias("split"),
        F.substring("o_orderpriority", 1, 1).alias("class_name"),
        F.floor(F.col("o_totalprice") / 100).cast("string").alias("sha256"),
    )
    return SP.leakage_report(m)


@query(
    "split_group_counts",
    f"""WITH {X.ORDER_GROUPS_SQL} SELECT class_name, CAST(count(*) AS BIGINT) AS image_count,
  count(DISTINCT group_id) AS group_count FROM og GROUP BY class_name""",
)
def split_counts(spark, sf):
    return A.group_counts(X.order_groups(spark, sf), ["class_name"])


@query(
    "split_destination_names",
    """WITH m AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split,
    printf('c%d/f%d%s%08d.JPG', o_custkey % 6, o_custkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '__' END, o_orderkey // 2) AS relative_path,
    'c' || CAST(o_custkey % 6 AS VARCHAR) AS class_name FROM orders),
f AS (SELECT *, replace(regexp_replace(relative_path, '^[^/]+/', ''), '/', '__') AS flat,
  regexp_replace(regexp_replace(relative_path, '^.*/', ''), '[.][^.]*$', '') AS stem FROM m),
d AS (SELECT DISTINCT split, class_name, flat, relative_path, stem FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY split, class_name, flat ORDER BY relative_path) AS n FROM d)
SELECT split, class_name, relative_path, split || '/' || class_name || '/' ||
  CASE WHEN n = 1 THEN flat ELSE stem || '_' || CAST(n - 1 AS VARCHAR) || '.jpg' END AS destination_relative_path
FROM n""",
)
def destination_names(spark, sf):
    o = X.table(spark, sf, "orders")
    joint = F.when(F.col("o_orderkey") % 2 == 0, "/").otherwise("__")
    m = o.select(
        F.when(F.col("o_orderkey") % 10 < 7, "train").otherwise("test").alias("split"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 6).cast("string")).alias("class_name"),
        F.format_string(
            "c%d/f%d%s%08d.JPG", F.col("o_custkey") % 6, F.col("o_custkey") % 7, joint,
            F.floor(F.col("o_orderkey") / 2),
        ).alias("relative_path"),
    )
    return SK.split_destinations(m)


@query(
    "materialized_split",
    f"""WITH {X.ORDER_GROUPS_SQL}, {TARGETS_SQL}
SELECT class_name, s.split, CASE s.split WHEN 'test' THEN test WHEN 'validation' THEN validation
    ELSE total - test - validation END AS n
FROM tg, (VALUES ('train'), ('validation'), ('test')) s(split)""",
)
def materialized(spark, sf):
    path = scratch_path(spark, "split-out")
    SK.materialize_split(split(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("class_name", "split").agg(F.count("*").alias("n"))


@query(
    "manifest_read",
    f"""WITH {X.ORDER_GROUPS_SQL} SELECT row_id, class_index, group_id FROM og WHERE row_id % 10 = 7""",
)
def manifest_read(spark, sf):
    m = X.order_groups(spark, sf).withColumn(
        "split",
        F.when(F.col("row_id") % 10 < 7, "train")
        .when(F.col("row_id") % 10 == 7, " validation ")
        .otherwise("test"),
    )
    names = TB.class_dictionary(spark, [f"class_{i}" for i in range(6)])
    return TB.read_manifest(m, "validation", names).select("row_id", "class_index", "group_id")


@query(
    "manifest_violations",
    """WITH m AS (
  SELECT printf('p%d', o_orderkey // 3) AS relative_path, CAST(o_custkey AS VARCHAR) AS group_id,
    'class_' || CAST(o_custkey % 7 AS VARCHAR) AS class_name, o_orderkey % 6 AS class_index FROM orders)
SELECT rule, count(*) AS n FROM (
  SELECT 'unknown_class' AS rule FROM m WHERE class_name = 'class_6'
  UNION ALL SELECT 'wrong_index' FROM m WHERE class_name <> 'class_6' AND class_name <> 'class_' || CAST(class_index AS VARCHAR)
  UNION ALL SELECT 'repeated_path' FROM (SELECT relative_path FROM m GROUP BY 1 HAVING count(*) > 1)
) GROUP BY rule""",
)
def violations(spark, sf):
    m = X.table(spark, sf, "orders").select(
        F.format_string("p%d", F.floor(F.col("o_orderkey") / 3)).alias("relative_path"),
        F.col("o_custkey").cast("string").alias("group_id"),
        F.concat(F.lit("class_"), (F.col("o_custkey") % 7).cast("string")).alias("class_name"),
        (F.col("o_orderkey") % 6).cast("int").alias("class_index"),
        F.lit("train").alias("split"),
    )
    names = TB.class_dictionary(spark, [f"class_{i}" for i in range(6)])
    return TB.manifest_violations(m, names).groupBy("rule").agg(F.count("*").alias("n"))


# --- folds ---------------------------------------------------------------------------------


def folds(spark, sf):
    return X.remembered(spark, sf, "folds", lambda: FO.group_kfold(X.order_groups(spark, sf)))


@query(
    "group_kfold_balance",
    f"""WITH {X.ORDER_GROUPS_SQL}, gs AS (SELECT class_index, group_id, count(*) AS n FROM og GROUP BY ALL)
SELECT class_index, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups, CAST(5 AS BIGINT) AS folds,
  CAST(0 AS BIGINT) AS groups_in_two_folds, true AS balanced FROM gs GROUP BY class_index""",
)
def kfold_balance(spark, sf):
    f = FO.group_kfold(X.order_groups(spark, sf))
    per_group = f.groupBy("class_index", "group_id").agg(
        F.count("*").alias("n"), F.min("fold").alias("a"), F.max("fold").alias("b")
    )
    per_fold = per_group.groupBy("class_index", "a").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("groups"),
        F.max("n").alias("largest"),
        F.count_if(F.expr("a <> b")).alias("split"),
    )
    return per_fold.groupBy("class_index").agg(
        F.sum("rows").alias("rows"),
        F.sum("groups").alias("groups"),
        F.count("*").alias("folds"),
        F.sum("split").alias("groups_in_two_folds"),
        (F.max("rows") - F.min("rows") <= F.max("largest")).alias("balanced"),
    )


@query(
    "fold_assignments",
    f"""WITH {X.ORDER_GROUPS_SQL}, per AS (SELECT count(*) AS n FROM og)
SELECT r.role, CAST(42 AS INTEGER) AS seed, CASE r.role WHEN 'validation' THEN n ELSE 4 * n END AS rows
FROM per, (VALUES ('train'), ('validation')) r(role)""",
)
def assignments(spark, sf):
    a = FO.fold_assignments(folds(spark, sf))
    return a.groupBy("role", "seed").agg(F.count("*").alias("rows"))


@query(
    "fold_integrity",
    """WITH f AS (SELECT o_orderkey % 5 + 1 AS held, o_custkey FROM orders),
a AS (SELECT k.range AS fold, held = k.range AS val, o_custkey FROM f, range(1, 6) k),
g AS (SELECT fold, o_custkey, sum(CAST(NOT val AS INTEGER)) AS t, sum(CAST(val AS INTEGER)) AS v FROM a GROUP BY ALL)
SELECT CAST(fold AS INTEGER) AS fold, CAST(sum(t) AS BIGINT) AS train_image_count,
  CAST(sum(v) AS BIGINT) AS validation_image_count, count(*) FILTER (t > 0) AS train_group_count,
  count(*) FILTER (v > 0) AS validation_group_count,
  count(*) FILTER (t > 0 AND v > 0) AS overlap_group_count FROM g GROUP BY fold""",
)
def integrity(spark, sf):
    rows = X.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("fold")
    )
    return FO.fold_integrity(FO.fold_roles(rows))


@query(
    "fold_overlap_of_kfold",
    "SELECT CAST(f.range AS INTEGER) AS fold, CAST(0 AS BIGINT) AS overlap_group_count FROM range(1, 6) f",
)
def kfold_overlap(spark, sf):
    done = FO.fold_integrity(FO.fold_roles(folds(spark, sf)))
    return done.select("fold", "overlap_group_count")


@query(
    "fold_class_counts",
    """WITH f AS (SELECT o_orderkey % 5 + 1 AS held, o_custkey % 6 AS c FROM orders)
SELECT CAST(k.range AS INTEGER) AS fold, CASE WHEN held = k.range THEN 'validation' ELSE 'train' END AS role,
  CAST(c AS INTEGER) AS class_index, count(*) AS n FROM f, range(1, 6) k GROUP BY ALL""",
)
def fold_counts(spark, sf):
    rows = X.order_groups(spark, sf).withColumn(
        "fold", (F.col("row_id") % 5 + 1).cast("int")
    )
    return FO.fold_class_counts(FO.fold_roles(rows))


@query(
    "fold_preconditions",
    """WITH o AS (SELECT o_custkey AS g, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS c FROM orders)
SELECT 'group_with_several_classes' AS rule, CAST(g AS VARCHAR) AS subject, count(DISTINCT c) AS value
FROM o GROUP BY g HAVING count(DISTINCT c) > 1
UNION ALL SELECT 'class_with_too_few_groups', CAST(c AS VARCHAR), count(DISTINCT g) FROM o GROUP BY c
HAVING count(DISTINCT g) < 900""",
)
def preconditions(spark, sf):
    rows = X.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("group_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("class_index"),
    )
    return FO.fold_preconditions(rows, 900)


@query(
    "oof_coverage",
    """WITH e AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 < 8),
o AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 > 1
      UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 5)
SELECT (SELECT count(*) FROM e) AS expected_rows, (SELECT count(*) FROM o) AS observed_rows,
  (SELECT count(*) FROM (SELECT id FROM e EXCEPT SELECT id FROM o)) AS missing,
  (SELECT count(*) FROM (SELECT id FROM o EXCEPT SELECT id FROM e)) AS extra,
  (SELECT count(*) FROM (SELECT id FROM o GROUP BY id HAVING count(*) > 1)) AS repeated""",
)
def coverage(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    expected = o.filter("id % 10 < 8")
    observed = o.filter("id % 10 > 1").unionAll(o.filter("id % 100 = 5"))
    return FO.oof_coverage(expected, observed, "id")


# --- images --------------------------------------------------------------------------------


@query(
    "admit_images",
    """WITH r AS (SELECT event_id, event_id % 5 AS k FROM events)
SELECT CASE k WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' END AS image_format,
  CASE k WHEN 2 THEN 'no_decoder' WHEN 3 THEN 'unsupported_format' WHEN 4 THEN 'empty' END AS rejection,
  CASE WHEN k < 2 THEN 200 ELSE 415 END AS status, event_id AS seq FROM r""",
)
def admit(spark, sf):
    return IM.admit_images(X.requests(spark, sf)).select(
        "seq", "image_format", "rejection", "status"
    )


@query(
    "grid_quality",
    """WITH c AS (SELECT vec_id, g.range AS i, CAST(round((CAST(embedding[g.range + 1] AS DOUBLE) + 1) * 127.5) AS DOUBLE) AS v
  FROM embeddings, range(64) g),
b AS (SELECT vec_id, avg(v) AS brightness FROM c GROUP BY vec_id),
l AS (SELECT a.vec_id, 4 * a.v - w.v - e.v - n.v - s.v AS d FROM c a
  JOIN c w ON w.vec_id = a.vec_id AND w.i = a.i - 1 JOIN c e ON e.vec_id = a.vec_id AND e.i = a.i + 1
  JOIN c n ON n.vec_id = a.vec_id AND n.i = a.i - 8 JOIN c s ON s.vec_id = a.vec_id AND s.i = a.i + 8
  WHERE a.i % 8 BETWEEN 1 AND 6 AND a.i // 8 BETWEEN 1 AND 6),
q AS (SELECT vec_id, var_pop(d) AS blur FROM l GROUP BY vec_id)
SELECT vec_id, round(brightness, 6) AS brightness, round(blur, 4) AS blur_variance,
  concat_ws(',', CASE WHEN brightness < 45 THEN 'tooDark' END,
    CASE WHEN brightness > 225 THEN 'tooBright' END, CASE WHEN blur < 60 THEN 'tooBlurry' END) AS warnings
FROM b JOIN q USING (vec_id)""",
)
def grid_quality(spark, sf):
    e = X.table(spark, sf, "embeddings")
    gray = e.select(
        "vec_id",
        F.transform("embedding", lambda v: F.round((v.cast("double") + 1) * 127.5)).alias("gray"),
    )
    done = IM.grid_quality(gray, "gray", 8, 8)
    return done.select(
        "vec_id",
        F.round("brightness", 6).alias("brightness"),
        F.round("blur_variance", 4).alias("blur_variance"),
        F.array_join("warnings", ",").alias("warnings"),
    )


def embedding_images(spark, sf):
    """Embeddings drawn as 8 x 8 gray pictures in the layout of the image source."""
    e = X.table(spark, sf, "embeddings")
    level = "CAST(least(greatest(round((x + 1) * 127.5), 0), 255) AS INT)"
    data = f"unhex(array_join(transform(embedding, x -> lpad(hex({level}), 2, '0')), ''))"
    return e.select(
        F.struct(
            F.col("vec_id").cast("string").alias("origin"),
            F.lit(8).alias("height"),
            F.lit(8).alias("width"),
            F.lit(1).alias("nChannels"),
            F.expr(data).alias("data"),
        ).alias("image")
    )


@query(
    "prepare_images",
    """SELECT CAST(vec_id AS VARCHAR) AS origin, 8 AS original_width, 8 AS original_height,
  CAST(8 * 8 * 3 AS INTEGER) AS cells,
  CAST(3 * list_sum([least(greatest(round((x + 1) * 127.5), 0), 255) FOR x IN embedding]) AS BIGINT) AS total
FROM embeddings""",
)
def prepare(spark, sf):
    prepared = IM.prepare_images(embedding_images(spark, sf), 8)
    total = F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return prepared.select(
        "origin",
        "original_width",
        "original_height",
        F.size("tensor").alias("cells"),
        total.cast("bigint").alias("total"),
    )


@query("image_quality_pixels")
def pixel_quality(spark, sf):
    return round_cols(IM.image_quality(embedding_images(spark, sf)), 3)


@query("image_dhash_pixels")
def pixel_dhash(spark, sf):
    return IM.image_dhash(embedding_images(spark, sf))

