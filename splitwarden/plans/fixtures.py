"""Operator inputs derived from the given tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.functions import keys as K
from splitwarden.operators.exact import number_records
from splitwarden.operators.fingerprint import text_fingerprint
from splitwarden.operators.scale import materialise, spread
from splitwarden.sources.tables import class_dictionary

LANGS = ["de", "en", "es", "fr"]
K_PRED = 5
RUN_SEEDS = [42, 123, 2026]
_memo: dict[tuple, DataFrame] = {}


def clear_memo() -> None:
    _memo.clear()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remembered(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Materialise an input shared by several queries once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _memo:
        _memo[key] = materialise(build(), name)
    return _memo[key]


# --- predictions from orders -------------------------------------------------------------


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Stored prediction table derived from all orders, built once per session."""
    return remembered(spark, sf, "predictions", lambda: _predictions(spark, sf))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(table(spark, sf, "orders"))
    y = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    base = F.col("o_orderkey") * 31 + F.floor("o_totalprice")
    raw = [
        (base + (j + 1) * 7919) % 97 + 1 + F.when(F.col("y_true") == j, 60).otherwise(0)
        for j in range(K_PRED)
    ]
    total = sum(raw[1:], raw[0])
    rest = F.col("o_orderkey") % 10
    return o.withColumn("y_true", y).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("group_id"),
        "y_true",
        F.array(*[r.cast("double") / total for r in raw]).alias("probs"),
        F.when(rest < 7, "train").when(rest == 7, "validation").otherwise("test").alias("split"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("fold"),
        F.concat(F.lit("exp"), (F.floor(F.col("o_custkey") / 3) % 2).cast("string")).alias(
            "experiment"
        ),
        F.get(F.array(*[F.lit(s) for s in RUN_SEEDS]), (F.col("o_custkey") % 3).cast("int")).alias(
            "seed"
        ),
    )


PREDS_SQL = """
raw AS (
  SELECT o_orderkey, o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y_true,
         o_orderkey * 31 + CAST(floor(o_totalprice) AS BIGINT) AS base
  FROM orders),
sc AS (
  SELECT *,
    1 + (base + 7919) % 97 + CASE WHEN y_true = 0 THEN 60 ELSE 0 END AS r0,
    1 + (base + 15838) % 97 + CASE WHEN y_true = 1 THEN 60 ELSE 0 END AS r1,
    1 + (base + 23757) % 97 + CASE WHEN y_true = 2 THEN 60 ELSE 0 END AS r2,
    1 + (base + 31676) % 97 + CASE WHEN y_true = 3 THEN 60 ELSE 0 END AS r3,
    1 + (base + 39595) % 97 + CASE WHEN y_true = 4 THEN 60 ELSE 0 END AS r4
  FROM raw),
tot AS (SELECT *, CAST(r0 + r1 + r2 + r3 + r4 AS DOUBLE) AS s FROM sc),
preds AS (
  SELECT o_orderkey AS row_id, o_custkey AS group_id, y_true,
    [r0 / s, r1 / s, r2 / s, r3 / s, r4 / s] AS probs,
    CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 = 7 THEN 'validation'
         ELSE 'test' END AS split,
    CAST(o_orderkey % 5 + 1 AS INTEGER) AS fold,
    'exp' || CAST((o_custkey // 3) % 2 AS VARCHAR) AS experiment,
    [42, 123, 2026][o_custkey % 3 + 1] AS seed
  FROM tot),
pr AS (
  SELECT *, list_position(probs, list_max(probs)) - 1 AS y_pred, list_max(probs) AS conf
  FROM preds)
"""




def label_sql(by: str, source: str = "pr") -> str:
    """Confusion cells, per-class scores and label scores per ``by`` (comma list)."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"x.{k} = g.{k}" for k in keys)
    using = ", ".join(keys)
    return f"""
grid AS (
  SELECT g.*, t.range AS y_true, p.range AS y_pred
  FROM (SELECT DISTINCT {using} FROM {source}) g, range({K_PRED}) t, range({K_PRED}) p),
cm AS (
  SELECT {', '.join('g.' + k for k in keys)}, g.y_true, g.y_pred, count(x.y_true) AS n
  FROM grid g LEFT JOIN {source} x
    ON {on} AND x.y_true = g.y_true AND x.y_pred = g.y_pred
  GROUP BY ALL),
tt AS (SELECT {using}, y_true AS c, sum(n) AS support FROM cm GROUP BY ALL),
pp AS (SELECT {using}, y_pred AS c, sum(n) AS predicted FROM cm GROUP BY ALL),
dd AS (SELECT {using}, y_true AS c, n AS tp FROM cm WHERE y_true = y_pred),
al AS (SELECT {using}, sum(n) AS total FROM cm GROUP BY ALL),
cnt AS (
  SELECT {using}, c, support, predicted, tp, predicted - tp AS fp, support - tp AS fn,
         total - support - predicted + tp AS tn, total
  FROM tt JOIN pp USING ({using}, c) JOIN dd USING ({using}, c) JOIN al USING ({using})),
pc AS (
  SELECT *,
    CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS prec,
    CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS rec,
    CASE WHEN tn + fp = 0 THEN 0.0 ELSE CAST(tn AS DOUBLE) / (tn + fp) END AS spec,
    CASE WHEN support + predicted = 0 THEN 0.0
         ELSE 2.0 * CAST(tp AS DOUBLE) / (support + predicted) END AS f1
  FROM cnt),
lab AS (
  SELECT {using}, CAST(sum(support) AS BIGINT) AS sample_count,
    CAST(sum(tp) AS BIGINT) AS correct_count,
    CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
    avg(rec) FILTER (support > 0) AS balanced_accuracy,
    avg(prec) FILTER (support + predicted > 0) AS precision_macro,
    avg(rec) FILTER (support + predicted > 0) AS recall_macro,
    avg(f1) FILTER (support + predicted > 0) AS f1_macro,
    sum(prec * support) / sum(support) AS precision_weighted,
    sum(rec * support) / sum(support) AS recall_weighted,
    sum(f1 * support) / sum(support) AS f1_weighted,
    avg(spec) AS specificity_macro,
    sum(spec * support) / sum(support) AS specificity_weighted,
    (CAST(sum(tp) AS DOUBLE) / sum(support)
      - sum(CAST(support AS DOUBLE) * predicted) / pow(sum(support), 2))
     / (1 - sum(CAST(support AS DOUBLE) * predicted) / pow(sum(support), 2)) AS cohen_kappa,
    (CAST(sum(tp) AS DOUBLE) * sum(support) - sum(CAST(support AS DOUBLE) * predicted))
     / sqrt((pow(sum(support), 2) - sum(CAST(predicted AS DOUBLE) * predicted))
          * (pow(sum(support), 2) - sum(CAST(support AS DOUBLE) * support)))
     AS matthews_correlation_coefficient
  FROM pc GROUP BY {using})
"""


def prob_sql(by: str, source: str = "pr") -> str:
    """Log loss, Brier, confidence, calibration error and areas per ``by``."""
    edges = [i * 0.1 for i in range(1, 10)]
    bins = " + ".join(f"CAST(conf >= CAST('{e!r}' AS DOUBLE) AS INTEGER)" for e in edges)
    brier = " + ".join(
        f"pow(probs[{i + 1}] - CAST(y_true = {i} AS INTEGER), 2)" for i in range(K_PRED)
    )
    return f"""
pb AS (
  SELECT {by}, avg(-ln(greatest(least(probs[y_true + 1], 1 - 2.220446049250313e-16),
                                2.220446049250313e-16))) AS log_loss,
    avg({brier}) AS brier_score_multiclass,
    avg(conf) AS mean_confidence
  FROM {source} GROUP BY {by}),
rel AS (
  SELECT {by}, {bins} AS bin, count(*) AS n, avg(CAST(y_true = y_pred AS INTEGER)) AS acc,
         avg(conf) AS cf
  FROM {source} GROUP BY ALL),
ec AS (SELECT {by}, sum(n * abs(acc - cf)) / sum(n) AS ece FROM rel GROUP BY {by}),
ex AS (
  SELECT {by}, y_true, k.range AS c, probs[k.range + 1] AS score
  FROM {source}, range({K_PRED}) k),
gr AS (
  SELECT {by}, c, score, sum(CAST(y_true = c AS INTEGER)) AS pos,
         sum(CAST(y_true <> c AS INTEGER)) AS neg
  FROM ex GROUP BY ALL),
cu AS (
  SELECT *, sum(neg) OVER (PARTITION BY {by}, c ORDER BY score) AS upto FROM gr),
au AS (
  SELECT {by}, c, sum(pos) AS positives, sum(neg) AS negatives,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0
      THEN sum(pos * (upto - neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auc
  FROM cu GROUP BY {by}, c),
ar AS (
  SELECT {by},
    CASE WHEN count(auc) = {K_PRED} THEN avg(auc) END AS roc_auc_ovr_macro,
    CASE WHEN count(auc) = {K_PRED} THEN sum(auc * positives) / sum(positives) END
      AS roc_auc_ovr_weighted
  FROM au GROUP BY {by})
"""


WIDE_METRICS = [
    "accuracy",
    "balanced_accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "precision_weighted",
    "recall_weighted",
    "f1_weighted",
    "specificity_macro",
    "specificity_weighted",
    "cohen_kappa",
    "matthews_correlation_coefficient",
    "log_loss",
    "brier_score_multiclass",
    "mean_confidence",
    "confidence_accuracy_gap",
    "expected_calibration_error_10_bins",
    "roc_auc_ovr_macro",
    "roc_auc_ovr_weighted",
]


def bundle_sql(by: str, source: str = "pr") -> str:
    """CTE ``wide``: all metrics per ``by``."""
    return (
        label_sql(by, source)
        + ","
        + prob_sql(by, source)
        + f""",
wide AS (
  SELECT lab.*, log_loss, brier_score_multiclass, mean_confidence,
    mean_confidence - accuracy AS confidence_accuracy_gap,
    ece AS expected_calibration_error_10_bins, roc_auc_ovr_macro, roc_auc_ovr_weighted
  FROM lab JOIN pb USING ({by}) JOIN ec USING ({by}) JOIN ar USING ({by}))
"""
    )


def round_cols(df: DataFrame, places: int = 6) -> DataFrame:
    """Round the double columns, as the SQL twins do."""
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# --- document records ----------------------------------------------------------------------


def classes(spark: SparkSession) -> DataFrame:
    return class_dictionary(spark, LANGS)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"))
    index = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang")) - 1
    path = F.format_string("%s/%08d.txt", "lang", "doc_id")
    rows = docs.select(
        "doc_id",
        F.col("lang").alias("class_name"),
        index.cast("int").alias("class_index"),
        path.alias("relative_path"),
        F.concat(F.lit("/data/"), path).alias("path"),
        (F.col("n_chars") > 0).alias("readable"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").cast("int").alias("width"),
        F.lit(1).alias("height"),
        F.lit("T").alias("mode"),
    )
    prints = text_fingerprint(docs)
    return number_records(rows.join(prints, "doc_id"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records of the documents table, built once per session."""
    return remembered(spark, sf, "records", lambda: _records(spark, sf))


FINGERPRINT_SQL = r"""
toks AS (
  SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'),
    '[\p{L}\p{N}]+(?:[-’''][\p{L}\p{N}]+)*')) AS token
  FROM documents),
cells AS (
  SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 72 AS cell, count(*) AS n
  FROM toks GROUP BY ALL),
full_grid AS (
  SELECT d.doc_id, g.range AS cell, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN range(72) g
  LEFT JOIN cells c ON c.doc_id = d.doc_id AND c.cell = g.range),
bits AS (
  SELECT a.doc_id, (a.cell // 9) * 8 + a.cell % 9 AS bit, b.n > a.n AS lit
  FROM full_grid a JOIN full_grid b ON a.doc_id = b.doc_id AND b.cell = a.cell + 1
  WHERE a.cell % 9 < 8),
fp AS (
  SELECT doc_id,
    CASE WHEN doc_id IN (SELECT doc_id FROM toks) THEN
      CAST(sum(CASE WHEN lit THEN CAST(pow(2, 63 - bit) AS UBIGINT) ELSE 0 END) AS UBIGINT) END AS h
  FROM bits GROUP BY doc_id)
"""

RECORDS_SQL = (
    FINGERPRINT_SQL
    + """,
recs AS (
  SELECT d.doc_id, d.lang AS class_name, list_position(['de', 'en', 'es', 'fr'], d.lang) - 1 AS class_index,
    printf('%s/%08d.txt', d.lang, d.doc_id) AS relative_path, sha256(d.text) AS sha256,
    d.n_chars > 0 AS readable, CAST(d.n_chars AS INTEGER) AS width, fp.h
  FROM documents d JOIN fp USING (doc_id)),
rec AS (
  SELECT *, row_number() OVER (ORDER BY class_index, relative_path) AS row_no FROM recs)
"""
)

THRESHOLD = 4

# All record pairs; ``listed`` marks the one that stands for its two contents and classes, and
# all of them share its decision.
PAIRS_SQL = (
    RECORDS_SQL
    + f""",
cell AS (
  SELECT sha256, class_name, min(row_no) AS row_no, arg_min(doc_id, row_no) AS doc_id, count(*) AS n
  FROM rec GROUP BY ALL),
pairs AS (
  SELECT a.row_no AS row_1, b.row_no AS row_2, ca.doc_id AS doc_1, cb.doc_id AS doc_2,
    a.row_no = ca.row_no AND b.row_no = cb.row_no AS listed, CAST(ca.n * cb.n AS DECIMAL(38, 0)) AS n_pairs,
    a.relative_path AS relative_path_1, b.relative_path AS relative_path_2,
    a.class_name AS class_1, b.class_name AS class_2,
    bit_count(xor(a.h, b.h)) AS dhash_distance,
    a.class_name <> b.class_name AS cross_class_candidate
  FROM rec a JOIN rec b ON a.row_no < b.row_no AND a.sha256 <> b.sha256
  JOIN cell ca ON ca.sha256 = a.sha256 AND ca.class_name = a.class_name
  JOIN cell cb ON cb.sha256 = b.sha256 AND cb.class_name = b.class_name
  WHERE bit_count(xor(a.h, b.h)) <= {THRESHOLD}),
reviewed AS (
  SELECT *, CASE (doc_1 + doc_2) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS decision
  FROM pairs)
"""
)

# All record pairs, each with a decision of its own; ``n_pairs`` counts those of its two contents and
# classes.
RECORD_PAIRS_SQL = (
    RECORDS_SQL
    + f""",
sized AS (SELECT *, count(*) OVER (PARTITION BY sha256, class_name) AS n FROM rec),
pairs AS (
  SELECT a.row_no AS row_1, b.row_no AS row_2, a.doc_id AS doc_1, b.doc_id AS doc_2,
    CAST(a.n * b.n AS DECIMAL(38, 0)) AS n_pairs,
    a.relative_path AS relative_path_1, b.relative_path AS relative_path_2,
    a.class_name AS class_1, b.class_name AS class_2,
    bit_count(xor(a.h, b.h)) AS dhash_distance,
    a.class_name <> b.class_name AS cross_class_candidate
  FROM sized a JOIN sized b ON a.row_no < b.row_no AND a.sha256 <> b.sha256
  WHERE bit_count(xor(a.h, b.h)) <= {THRESHOLD}),
reviewed AS (
  SELECT *, CASE (doc_1 + doc_2) % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS decision
  FROM pairs)
"""
)

EXACT_LINKS_SQL = """
eg AS (
  SELECT sha256, min(row_no) AS dst FROM rec GROUP BY sha256
  HAVING count(*) >= 2 AND min(class_index) = max(class_index)),
el AS (SELECT r.row_no AS src, eg.dst FROM rec r JOIN eg USING (sha256) WHERE r.row_no <> eg.dst)
"""

COMPONENT_SQL = """
links AS (
  SELECT src, dst FROM el UNION SELECT dst, src FROM el
  UNION SELECT src, dst FROM nl UNION SELECT dst, src FROM nl),
reach AS (
  SELECT row_no AS node, row_no AS label FROM rec
  UNION
  SELECT l.dst, r.label FROM reach r JOIN links l ON l.src = r.node),
comp AS (SELECT node AS row_no, min(label) AS component FROM reach GROUP BY node)
"""


def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The review list without full paths and digests, which nothing reads again."""
    from splitwarden.operators.near import near_duplicates

    wide = ("path_1", "path_2", "sha256_1", "sha256_2")
    return remembered(
        spark,
        sf,
        "near-pairs",
        lambda: near_duplicates(records(spark, sf), THRESHOLD, carried=["doc_id"]).drop(*wide),
    )


def record_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of records that the review list stands for."""
    from splitwarden.operators.near import record_pairs as all_pairs

    return remembered(
        spark,
        sf,
        "record-pairs",
        lambda: all_pairs(near_pairs(spark, sf), records(spark, sf), carried=["doc_id"]),
    )


def review_rows(spark: SparkSession, sf: str, pairs: DataFrame | None = None) -> DataFrame:
    """A reviewer's table over ``pairs``, with untidy spellings and paths swapped."""
    rest = (F.col("doc_id_1") + F.col("doc_id_2")) % 3
    return (near_pairs(spark, sf) if pairs is None else pairs).select(
        F.concat(F.lit(" "), "relative_path_2").alias("relative_path_1"),
        F.concat("relative_path_1", F.lit(" ")).alias("relative_path_2"),
        F.when(rest == 0, " Y ").when(rest == 1, "Different").otherwise("").alias("decision"),
        F.lit(None).cast("string").alias("notes"),
        (F.col("doc_id_1") * 1000003 + F.col("doc_id_2")).alias("line_no"),
    )


def reviewed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The review list with its decisions, made once per session: links and counters read it."""
    from splitwarden.operators.near import apply_review
    from splitwarden.sources.tables import read_review

    def build():
        review = read_review(review_rows(spark, sf))
        return apply_review(near_pairs(spark, sf), review, records(spark, sf))

    return remembered(spark, sf, "reviewed-pairs", build)


def reviewed_records(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of records, each with its own decision, made once per session."""
    from splitwarden.operators.near import apply_review
    from splitwarden.sources.tables import read_review

    def build():
        pairs = record_pairs(spark, sf)
        review = read_review(review_rows(spark, sf, pairs))
        return apply_review(pairs.drop("doc_id_1", "doc_id_2", "class_1", "class_2"), review)

    return remembered(spark, sf, "reviewed-records", build)


# --- single-class groups from orders -------------------------------------------------------


def order_groups(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(table(spark, sf, "orders"))
    index = (F.col("o_custkey") % 6).cast("int")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").cast("string").alias("group_id"),
        index.alias("class_index"),
        F.concat(F.lit("class_"), index.cast("string")).alias("class_name"),
        F.format_string("class_%d/%d/%08d.jpg", index, "o_custkey", "o_orderkey").alias(
            "relative_path"
        ),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
    )


ORDER_GROUPS_SQL = """
og AS (
  SELECT o_orderkey AS row_id, CAST(o_custkey AS VARCHAR) AS group_id,
    CAST(o_custkey % 6 AS INTEGER) AS class_index,
    'class_' || CAST(o_custkey % 6 AS VARCHAR) AS class_name
  FROM orders)
"""

# --- requests and knowledge ----------------------------------------------------------------


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return request_columns(e)


def request_columns(e: DataFrame) -> DataFrame:
    heads = F.array(
        F.lit("FFD8FFE0"), F.lit("89504E470D0A1A0A"), F.lit("524946460000000057454250"),
        F.lit("47494638"), F.lit(""),
    )
    head = F.get(heads, (F.col("event_id") % 5).cast("int"))
    body = F.when(F.col("event_id") % 5 == 4, F.lit("")).otherwise(F.hex(F.encode("props", "UTF-8")))
    return e.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        F.date_format("ts", "yyyy-MM-dd").alias("selected_date"),
        F.concat(F.lit("class_"), (F.col("event_id") % 6).cast("string")).alias("class_name"),
        F.unhex(F.concat(head, body)).alias("content"),
    )


def knowledge_tables(spark: SparkSession, sf: str):
    """Advice tables from the benchmark texts: six classes, two languages."""
    b = table(spark, sf, "benchmark").select(
        F.concat(F.lit("class_"), (F.col("item_id") % 6).cast("string")).alias("class_name"),
        F.when(F.floor(F.col("item_id") / 6) % 2 == 0, "en").otherwise("fil").alias("lang"),
        F.col("item_id").alias("pos"),
        "text",
    )
    first = b.groupBy("class_name", "lang").agg(F.min_by("text", "pos").alias("text"))
    meta = first.select(
        "class_name",
        "lang",
        F.when(F.col("class_name") != "class_2", F.concat_ws(" ", "class_name", "lang")).alias("name"),
        F.array("text").alias("description"),
    )
    notes = first.filter("class_name <> 'class_3'").select(
        "class_name",
        "lang",
        F.explode(F.array(F.lit("wet"), F.lit("dry"))).alias("season"),
        F.substring("text", 1, 20).alias("text"),
    )
    sources = (
        b.filter("class_name <> 'class_4' AND lang = 'en'")
        .select(
            "class_name",
            "pos",
            F.concat(F.lit("title "), F.col("pos").cast("string")).alias("title"),
            F.concat(F.lit("http://example.com/"), F.col("pos").cast("string")).alias("url"),
        )
    )
    return meta, b, notes, sources
