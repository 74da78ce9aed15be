"""Text, advice, scalar, streaming and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwarden.functions import dates as D
from splitwarden.functions import keys as KEYS
from splitwarden.functions import text as TX
from splitwarden.functions.lexicon import BILINGUAL_RULES, LanguageRules
from splitwarden.operators import advice as AD
from splitwarden.operators import folds as FO
from splitwarden.operators import learn as LE
from splitwarden.operators import metrics as M
from splitwarden.operators.scale import scratch_path, spread
from splitwarden.plans import fixtures as X
from splitwarden.plans.fixtures import round_cols
from splitwarden.sources import knowledge as KN
from splitwarden.sources import sinks as SK
from splitwarden.sources import tables as TB
from splitwarden.streaming import requests as RQ

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Rules over the vocabulary of the given texts: words, phrases and a hyphenated term.
FIXTURE_RULES = LanguageRules(
    terms={
        "monitoring": ("the", "les", "and the"),
        "sanitation": ("der", "que les", "los", "in that"),
        "treatment": ("und", "de la", "éeau", "tion"),
        "prevention": ("for", "der und", "la-la", "ser"),
        "field_management": ("with", "avec", "mit", "con"),
    },
    labels=BILINGUAL_RULES["en"].labels,
    stopwords=frozenset(["the", "and", "les", "que", "der", "und", "was"]),
)
TOKENS_SQL = r"""regexp_extract_all(replace(lower({text}), 'ß', 'ss'),
    '[\p{{L}}\p{{N}}]+(?:[-’''][\p{{L}}\p{{N}}]+)*')"""


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.format(text=text)


@query(
    "tokenize",
    f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS k FROM documents) "
    "SELECT doc_id, CAST(len(k) AS INTEGER) AS token_count, array_to_string(k, '|') AS tokens FROM t",
)
def tokenize(spark, sf):
    d = spread(X.table(spark, sf, "documents")).select("doc_id", TX.tokenize("text").alias("k"))
    return d.select(
        "doc_id", F.size("k").alias("token_count"), F.array_join("k", "|").alias("tokens")
    )


@query(
    "normalize_phrase",
    f"SELECT conv_id, turn, array_to_string({tokens_sql('text')}, ' ') AS phrase FROM conversations",
)
def phrase(spark, sf):
    return spread(X.table(spark, sf, "conversations")).select(
        "conv_id", "turn", TX.normalize_phrase("text").alias("phrase")
    )


def quote(term: str) -> str:
    return "'" + term.replace("'", "''") + "'"


def rules_sql(rules: LanguageRules, source: str, key: str) -> str:
    """CTE ``an``: category, label, matched terms, keywords and token count per text."""

    def hit(term: str) -> str:
        return f"contains(' ' || ph || ' ', {quote(' ' + TX.fold_literal(term) + ' ')})"

    def matched(terms) -> str:
        cells = ", ".join(f"CASE WHEN {hit(t)} THEN {quote(t)} END" for t in terms)
        return f"list_filter([{cells}], lambda x: x IS NOT NULL)"

    scores = ", ".join(
        "("
        + " + ".join(
            f"CAST({hit(t)} AS INTEGER) * {TX.term_weight(t)}" for t in rules.terms[c]
        )
        + f") AS s{i}, {matched(rules.terms[c])} AS m{i}"
        for i, c in enumerate(rules.priority)
    )
    n = len(rules.priority)
    top = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    pick = " ".join(f"WHEN s{i} = top THEN {quote(c)}" for i, c in enumerate(rules.priority))
    pick_m = " ".join(f"WHEN s{i} = top THEN m{i}" for i in range(n))
    labels = " ".join(f"WHEN {quote(c)} THEN {quote(v)}" for c, v in rules.labels.items())
    everything = list(dict.fromkeys(t for ts in rules.terms.values() for t in ts))
    stop = ", ".join(quote(w) for w in sorted(rules.stopwords))
    return f"""
tk AS (SELECT {key}, text, {tokens_sql('text')} AS k FROM {source} WHERE length(text) > 0),
ph AS (SELECT *, array_to_string(k, ' ') AS ph FROM tk),
sc AS (SELECT *, {scores}, {matched(everything)} AS every FROM ph),
tp AS (SELECT *, {top} AS top FROM sc),
ct AS (
  SELECT {key}, text, k, every,
    CASE WHEN top = 0 THEN {quote(rules.default)} ELSE CASE {pick} END END AS category,
    CASE WHEN top = 0 THEN CAST([] AS VARCHAR[]) ELSE CASE {pick_m} END END AS matched FROM tp),
cand AS (
  SELECT {key}, u.w, u.i FROM ct, unnest(list_concat(matched, every,
    list_filter(k, lambda t: length(t) > 2 AND NOT list_contains([{stop}], t))))
    WITH ORDINALITY AS u(w, i)),
firsts AS (SELECT {key}, w, min(i) AS i FROM cand GROUP BY ALL),
kw AS (
  SELECT {key}, array_to_string((list(w ORDER BY i))[1:6], '|') AS keywords FROM firsts GROUP BY {key}),
an AS (
  SELECT ct.*, CASE category {labels} END AS label, coalesce(kw.keywords, '') AS keywords
  FROM ct LEFT JOIN kw USING ({key}))"""


@query(
    "classify_text",
    f"WITH {rules_sql(FIXTURE_RULES, 'documents', 'doc_id')} SELECT doc_id, category, "
    "array_to_string(matched, '|') AS matched_terms FROM an",
)
def classify(spark, sf):
    d = spread(X.table(spark, sf, "documents")).select("doc_id", "text")
    done = AD.classify_text(d, FIXTURE_RULES)
    return done.select("doc_id", "category", F.array_join("matched_terms", "|").alias("matched_terms"))


@query(
    "analyze_texts",
    f"WITH {rules_sql(FIXTURE_RULES, 'documents', 'doc_id')} SELECT doc_id, category, "
    "label AS category_label, keywords, array_to_string(matched, '|') AS matched_terms, "
    "CAST(len(k) AS INTEGER) AS token_count, sha256(label || ': ' || text) AS formatted_digest FROM an",
)
def analyze(spark, sf):
    d = spread(X.table(spark, sf, "documents")).select("doc_id", "text")
    done = AD.analyze_texts(
        d.withColumn("lang", F.lit("en")), rules={"en": FIXTURE_RULES}
    )
    return done.select(
        "doc_id",
        "analysis.category",
        "analysis.category_label",
        F.array_join("analysis.keywords", "|").alias("keywords"),
        F.array_join("analysis.matched_terms", "|").alias("matched_terms"),
        "analysis.token_count",
        F.sha2("analysis.formatted_text", 256).alias("formatted_digest"),
    )


@query(
    "escape_html",
    """SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS digest FROM pages""",
)
def escape(spark, sf):
    return X.table(spark, sf, "pages").select(
        "page_id", F.sha2(TX.escape_html(F.col("html")), 256).alias("digest")
    )


@query(
    "valid_links",
    """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp')
    WHEN 2 THEN substr(url, 5) ELSE upper(substr(url, 1, 5)) || substr(url, 6) END AS url,
  CASE WHEN page_id % 7 = 0 THEN '' ELSE 't' END AS title FROM pages)
SELECT page_id FROM p WHERE title <> '' AND regexp_matches(lower(url), '^https?://')""",
)
def links(spark, sf):
    url = F.col("url")
    rest = F.col("page_id") % 4
    changed = (
        F.when(rest == 0, url)
        .when(rest == 1, F.replace(url, F.lit("http"), F.lit("ftp")))
        .when(rest == 2, F.expr("substring(url, 5)"))
        .otherwise(F.expr("concat(upper(substring(url, 1, 5)), substring(url, 6))"))
    )
    title = F.when(F.col("page_id") % 7 == 0, "").otherwise("t")
    pages = X.table(spark, sf, "pages")
    return pages.filter(TX.valid_link(title, changed)).select("page_id")


@query(
    "clean_path",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN '"' || o_orderpriority ELSE o_orderpriority END AS path FROM orders""",
)
def clean(spark, sf):
    p = F.col("o_orderpriority")
    rest = F.col("o_orderkey") % 4
    dirty = (
        F.when(rest == 0, F.concat(F.lit(' "'), p, F.lit('" ')))
        .when(rest == 1, F.concat(F.lit("'"), p, F.lit("'")))
        .when(rest == 2, F.concat(F.lit('"'), p))
        .otherwise(F.concat(F.lit("  "), p))
    )
    return X.table(spark, sf, "orders").select(
        "o_orderkey", KEYS.clean_path(dirty).alias("path")
    )


@query(
    "season",
    """WITH d AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE 'ok' END AS k FROM orders)
SELECT o_orderkey, CASE WHEN k = 'bad' THEN NULL WHEN month(o_orderdate) BETWEEN 6 AND 11 THEN 'wet' ELSE 'dry' END AS season,
  CASE WHEN k = 'bad' THEN '' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS shown FROM d""",
)
def season(spark, sf):
    o = X.table(spark, sf, "orders")
    bad = F.col("o_orderkey") % 9 == 0
    padded = F.date_format("o_orderdate", "yyyy-MM-dd")
    loose = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(padded)
    return o.select(
        "o_orderkey",
        D.season(F.when(bad, F.lit("2024-13-45")).otherwise(loose)).alias("season"),
        D.display_date(F.when(bad, F.lit("")).otherwise(padded)).alias("shown"),
    )


@query(
    "normalise_decision",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '' WHEN 3 THEN 'yes' ELSE lower(event_type) END AS decision FROM events""",
)
def decision(spark, sf):
    rest = F.col("event_id") % 5
    raw = (
        F.when(rest == 0, " SAME ").when(rest == 1, "0").when(rest == 2, "Pending")
        .when(rest == 3, "true").otherwise(F.col("event_type"))
    )
    return X.table(spark, sf, "events").select(
        "event_id", KEYS.normalise_decision(raw, strict=False).alias("decision")
    )


# --- advice --------------------------------------------------------------------------------

REQUEST_SQL = """
rq AS (
  SELECT user_id AS session, event_id AS seq, 'class_' || CAST(event_id % 6 AS VARCHAR) AS class_name,
    CASE WHEN month(ts) BETWEEN 6 AND 11 THEN 'wet' ELSE 'dry' END AS season FROM events),
it AS (
  SELECT 'class_' || CAST(item_id % 6 AS VARCHAR) AS class_name,
    CASE WHEN (item_id // 6) % 2 = 0 THEN 'en' ELSE 'fil' END AS lang, item_id AS pos, text FROM benchmark),
mt AS (
  SELECT class_name, lang, CASE WHEN class_name = 'class_2' THEN 'class 2' ELSE class_name || ' ' || lang END AS name,
    count(*) AS items, arg_min(text, pos) AS first_text,
    array_to_string(list(sha256(text) ORDER BY pos), ',') AS item_digests FROM it GROUP BY class_name, lang),
bn AS (
  SELECT mt.class_name, lang, season, name, CAST(items AS INTEGER) AS item_count, item_digests,
    CASE WHEN mt.class_name = 'class_3' THEN '' ELSE substr(first_text, 1, 20) END AS season_note,
    CAST(CASE WHEN mt.class_name = 'class_4' THEN 0 ELSE
      (SELECT count(*) FROM it x WHERE x.class_name = mt.class_name AND x.lang = 'en') END AS INTEGER) AS source_count
  FROM mt, (VALUES ('wet'), ('dry')) s(season))"""


def bundles(spark, sf):
    def build():
        return AD.advice_bundles(*X.knowledge_tables(spark, sf))

    return X.remembered(spark, sf, "bundles", build)


def flat(bundle):
    digests = F.transform("general_recommendations", lambda t: F.sha2(t, 256))
    return AD.flat_bundle(bundle).withColumn("item_digests", F.array_join(digests, ","))


@query(
    "result_bundle",
    f"""WITH {REQUEST_SQL} SELECT session, seq, class_name, season, lang, name, season_note,
  item_count, source_count, item_digests FROM rq JOIN bn USING (class_name, season)""",
)
def bundle(spark, sf):
    preds = X.requests(spark, sf).withColumn("season", D.season(F.col("selected_date"), True))
    # The readable columns are made on the static side, once per bundle.
    done = AD.result_bundle(preds.drop("content", "selected_date"), flat(bundles(spark, sf)))
    return done.select(
        "session", "seq", "class_name", "season", "lang", "name", "season_note", "item_count",
        "source_count", "item_digests",
    )


@query(
    "advice_item_analysis",
    "SELECT * FROM ("
    + ") UNION ALL SELECT * FROM (".join(
        f"""WITH {REQUEST_SQL}, src AS (SELECT pos, text FROM it WHERE lang = '{lang}'),
{rules_sql(BILINGUAL_RULES[lang], 'src', 'pos')}
SELECT pos, category, keywords, CAST(len(k) AS INTEGER) AS token_count FROM an"""
        for lang in ("en", "fil")
    )
    + ")",
)
def item_analysis(spark, sf):
    _, items, _, _ = X.knowledge_tables(spark, sf)
    done = AD.analyze_texts(items)
    return done.select(
        "pos",
        "analysis.category",
        F.array_join("analysis.keywords", "|").alias("keywords"),
        "analysis.token_count",
    )


@query(
    "knowledge_json",
    """WITH c AS (SELECT conv_id, role, list(text ORDER BY turn) AS general FROM conversations GROUP BY ALL)
SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS class_name, role AS lang, role || ' ' || CAST(conv_id AS VARCHAR) AS name,
  CAST(1 AS INTEGER) AS paragraphs, CAST(len(general) AS BIGINT) AS items,
  sha256(array_to_string(general, '|')) AS item_digest, 'wet note' AS wet_note, 'dry note' AS dry_note FROM c""",
)
def knowledge(spark, sf):
    """Conversations packed into the nested advice JSON and flattened again."""
    c = X.table(spark, sf, "conversations")
    per_role = c.groupBy("conv_id", "role").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("general")
    )
    # The description is a list for one role and plain text for the others.
    listed = F.array(F.get("general", 0), F.lit(" "))
    body = F.struct(
        F.concat_ws(" ", "role", F.col("conv_id").cast("string")).alias("name"),
        F.when(F.col("role") == "user", listed).alias("description"),
        "general",
        F.struct(F.lit("wet note").alias("wet"), F.lit("dry note").alias("dry")).alias("season_notes"),
    )
    plain = F.struct(
        F.concat_ws(" ", "role", F.col("conv_id").cast("string")).alias("name"),
        F.get("general", 0).alias("description"),
        "general",
        F.struct(F.lit("wet note").alias("wet"), F.lit("dry note").alias("dry")).alias("season_notes"),
    )
    json_text = F.when(F.col("role") == "user", F.to_json(body)).otherwise(F.to_json(plain))
    packed = per_role.select(
        "conv_id", F.concat(F.to_json(F.array("role")).substr(F.lit(2), F.length(F.to_json(F.array("role"))) - 2), F.lit(":"), json_text).alias("pair")
    ).groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list("pair")), ",").alias("pairs"))
    texts = packed.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("class_name"),
        F.concat(F.lit("{"), "pairs", F.lit("}")).alias("value"),
    )
    k = KN.flatten_knowledge(KN.parse_object(texts))
    items = k.items.groupBy("class_name", "lang").agg(
        F.count("*").alias("items"),
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), "|"
            ),
            256,
        ).alias("item_digest"),
    )
    noted = k.notes.groupBy("class_name", "lang").agg(
        F.max(F.when(F.col("season") == "wet", F.col("text"))).alias("wet_note"),
        F.max(F.when(F.col("season") == "dry", F.col("text"))).alias("dry_note"),
    )
    return (
        k.meta.select("class_name", "lang", "name", F.size("description").alias("paragraphs"))
        .join(items, ["class_name", "lang"])
        .join(noted, ["class_name", "lang"])
    )


# --- predictions read back, records, runs --------------------------------------------------


@query(
    "prediction_read",
    f"WITH {X.PREDS_SQL} SELECT row_id, y_true, "
    + ", ".join(f"round(probs[{i + 1}], 6) AS p{i}" for i in range(5))
    + " FROM preds",
)
def prediction_read(spark, sf):
    names = [f"c{i}" for i in range(5)]
    wide = X.predictions(spark, sf).select(
        "row_id",
        F.concat(F.lit("c"), F.col("y_true").cast("string")).alias("actual_class"),
        *[F.get("probs", i).alias(f"probability_{n}") for i, n in enumerate(names)],
    )
    back = TB.read_predictions(wide, TB.class_dictionary(spark, names))
    return round_cols(back.select("row_id", "y_true", *[F.get("probs", i).alias(f"p{i}") for i in range(5)]))


@query(
    "prediction_records",
    f"""WITH {X.PREDS_SQL} SELECT row_id, 'c' || CAST(y_pred AS VARCHAR) AS prediction,
  round(conf * 100, 6) AS confidence_percent, round(least(greatest(conf, 0), 0.999) * 100, 1) AS display_confidence_percent,
  round(probs[3], 6) AS p_c2 FROM pr""",
)
def prediction_records(spark, sf):
    names = [f"c{i}" for i in range(5)]
    path = scratch_path(spark, "records-out")
    preds = X.predictions(spark, sf).select("row_id", "probs")
    SK.append_prediction_records(preds.filter("row_id % 2 = 0"), names, path)
    SK.append_prediction_records(preds.filter("row_id % 2 = 1"), names, path)
    schema = (
        "row_id bigint, prediction string, confidence_percent double, "
        "display_confidence_percent double, all_probabilities map<string,double>"
    )
    back = spark.read.schema(schema).json(path)
    return round_cols(
        back.select(
            "row_id", "prediction", "confidence_percent", "display_confidence_percent",
            F.col("all_probabilities")["c2"].alias("p_c2"),
        )
    )


@query(
    "missing_runs",
    "SELECT 'run' || CAST(range AS VARCHAR) AS run FROM range(12) WHERE range NOT IN (SELECT o_custkey % 10 FROM orders)",
)
def missing_runs(spark, sf):
    have = X.table(spark, sf, "orders").select(
        F.concat(F.lit("run"), (F.col("o_custkey") % 10).cast("string")).alias("run")
    )
    wanted = spark.createDataFrame([(f"run{i}",) for i in range(12)], "run string")
    return TB.missing_runs(have, wanted)


_run_roots: dict[tuple[str, str], str] = {}
RUN_TABLES = ["fold_results", "per_class", "predictions"]
RUN_SCHEMA = "fold int, rows bigint, price double"
RUNS_SQL = """
r AS (SELECT o_custkey % 10 AS run, CAST(o_orderkey % 5 AS INTEGER) AS fold, o_totalprice FROM orders),
status AS (
  SELECT 'run' || CAST(run AS VARCHAR) AS run,
    CASE run WHEN 3 THEN 'per_class' WHEN 7 THEN 'predictions' ELSE '' END AS missing
  FROM (SELECT DISTINCT run FROM r))"""


def run_folders(spark, sf):
    """Results of ten runs as CSV folders; run 3 lacks a table, run 7 has one without content."""

    def build():
        root = scratch_path(spark, "runs")
        rows = X.table(spark, sf, "orders").groupBy(
            (F.col("o_custkey") % 10).alias("number"), (F.col("o_orderkey") % 5).cast("int").alias("fold")
        ).agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("price"))
        tables = F.explode(F.array(*[F.lit(t) for t in RUN_TABLES]))
        rows = rows.withColumn("file", tables).filter(
            "NOT (number = 3 AND file = 'per_class') AND NOT (number = 7 AND file = 'predictions')"
        )
        rows = rows.select("fold", "rows", "price", F.concat(F.lit("run"), F.col("number").cast("string")).alias("run"), "file")
        rows.repartition("run").write.partitionBy("run", "file").option("header", True).csv(root)
        hollow = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/run=run7/file=predictions/part-0.csv")
        hollow.getFileSystem(spark._jsc.hadoopConfiguration()).create(hollow).close()
        return root

    # One set of folders serves the three queries of a session.
    key = (spark.sparkContext.applicationId, sf)
    if key not in _run_roots:
        _run_roots[key] = build()
    return _run_roots[key]


@query(
    "run_discovery",
    f"WITH {RUNS_SQL} SELECT run, missing, missing = '' AS complete FROM status",
)
def run_discovery(spark, sf):
    """Runs found by their folders, with the tables that are missing or empty."""
    found = TB.discover_runs(spark, run_folders(spark, sf), RUN_TABLES)
    return found.select("run", F.array_join("missing", ",").alias("missing"), "complete")


@query(
    "run_results_lenient",
    f"""WITH {RUNS_SQL} SELECT s.run, fold, count(*) AS rows, round(sum(o_totalprice), 2) AS price
FROM r JOIN status s ON s.run = 'run' || CAST(r.run AS VARCHAR) WHERE missing = '' GROUP BY ALL""",
)
def run_results_lenient(spark, sf):
    """Fold results of the complete runs; others are left out."""
    root = run_folders(spark, sf)
    wanted = spark.createDataFrame([(f"run{i}",) for i in range(12)], "run string")
    rows = TB.read_run_table(spark, root, "fold_results", RUN_SCHEMA, RUN_TABLES, wanted, strict=False)
    return rows.select("run", "fold", "rows", "price")


@query(
    "run_results_strict",
    f"""WITH {RUNS_SQL} SELECT s.run, fold, count(*) AS rows FROM r
JOIN status s ON s.run = 'run' || CAST(r.run AS VARCHAR) WHERE s.run IN ('run1', 'run2') GROUP BY ALL""",
)
def run_results_strict(spark, sf):
    """Two runs that must be complete."""
    wanted = spark.createDataFrame([("run1",), ("run2",)], "run string")
    root = run_folders(spark, sf)
    rows = TB.read_run_table(spark, root, "predictions", RUN_SCHEMA, RUN_TABLES, wanted)
    return rows.select("run", "fold", "rows")


@query(
    "class_violations",
    """WITH d AS (SELECT p_partkey AS class_index, CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE 'n' || CAST(p_partkey % 1500 AS VARCHAR) END AS class_name FROM part)
SELECT rule, count(*) AS n FROM (SELECT 'blank_name' AS rule FROM d WHERE trim(class_name) = ''
  UNION ALL SELECT 'repeated_name' FROM (SELECT class_name FROM d GROUP BY 1 HAVING count(*) > 1)) GROUP BY rule""",
)
def class_violations(spark, sf):
    key = F.col("p_partkey")
    d = X.table(spark, sf, "part").select(
        key.cast("int").alias("class_index"),
        F.when(key % 50 == 0, " ").otherwise(F.concat(F.lit("n"), (key % 1500).cast("string"))).alias("class_name"),
    )
    return TB.class_violations(d).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "table_sinks",
    "SELECT f AS format, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum "
    "FROM orders, (VALUES ('csv'), ('json'), ('parquet')) v(f) GROUP BY f",
)
def sinks(spark, sf):
    rows = X.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    schema = "o_orderkey bigint, o_orderpriority string"
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"sink-{fmt}")
        SK.write_table(rows, path, fmt)
        reader = spark.read.schema(schema).format(fmt)
        back = reader.option("header", True).load(path) if fmt == "csv" else reader.load(path)
        parts.append(
            back.agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("key_sum")).withColumn(
                "format", F.lit(fmt)
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "prediction_table",
    """SELECT vec_id, 'c' || CAST(label % 10 AS VARCHAR) AS actual_class, round(list_max(p), 6) AS confidence,
  'c' || CAST(list_position(p, list_max(p)) - 1 AS VARCHAR) AS predicted_class,
  label % 10 = list_position(p, list_max(p)) - 1 AS correct, round(p[1], 6) AS probability_c0, round(p[10], 6) AS probability_c9
FROM (SELECT vec_id, label, [CAST(abs(x) AS DOUBLE) / list_sum([CAST(abs(y) AS DOUBLE) FOR y IN embedding[1:10]])
  FOR x IN embedding[1:10]] AS p FROM embeddings)""",
)
def written_table(spark, sf):
    """Wide table written as CSV and read back."""
    sizes = F.transform(F.slice("embedding", 1, 10), lambda x: F.abs(x.cast("double")))
    scored = X.table(spark, sf, "embeddings").select(
        "vec_id",
        (F.col("label") % 10).cast("int").alias("y_true"),
        F.transform(sizes, lambda x: x / F.aggregate(sizes, F.lit(0.0), lambda a, y: a + y)).alias("probs"),
    )
    path = scratch_path(spark, "prediction-table")
    wide = SK.prediction_table(scored, [f"c{i}" for i in range(10)], ["vec_id"])
    SK.write_table(wide, path, "csv")
    back = spark.read.schema(wide.schema).csv(path, header=True)
    return round_cols(
        back.select(
            "vec_id", "actual_class", "predicted_class", "correct", "confidence", "probability_c0", "probability_c9"
        )
    )


# --- streams -------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = X.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query(
    "enrich_stream",
    f"""WITH {REQUEST_SQL}, k AS (SELECT *, seq % 5 AS k FROM rq)
SELECT session, seq, 200 AS status, '' AS rejection, lang, name, item_count
FROM k JOIN bn USING (class_name, season) WHERE k < 2 AND seq % 13 <> 0
UNION ALL SELECT session, seq, 500, 'unknown_class', '', '', 0 FROM k WHERE k < 2 AND seq % 13 = 0
UNION ALL SELECT session, seq, 415, CASE k WHEN 2 THEN 'no_decoder' WHEN 3 THEN 'unsupported_format' ELSE 'empty' END,
  '', '', 0 FROM k WHERE k >= 2""",
)
def enrich(spark, sf):
    static = AD.flat_bundle(bundles(spark, sf)).select(
        "class_name", "season", "lang", "name", "item_count"
    )
    asked = X.request_columns(event_stream(spark, sf))
    # Some requests name a class without advice; they must stay as rows.
    unknown = F.when(F.col("seq") % 13 == 0, "class_9").otherwise(F.col("class_name"))
    stream = RQ.enrich_requests(asked.withColumn("class_name", unknown), static)
    path = scratch_path(spark, "enriched")
    RQ.run_available(stream.drop("content"), path)
    back = spark.read.parquet(path)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return back.select(
        "session", "seq", "status", blank("rejection"), blank("lang"), blank("name"),
        F.coalesce("item_count", F.lit(0)).alias("item_count"),
    )


@query(
    "latest_per_session",
    "SELECT user_id AS session, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, "
    "arg_max(value, event_id) AS value FROM events GROUP BY user_id",
)
def latest(spark, sf):
    rows = event_stream(spark, sf).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "event_type", "value", "ts"
    )
    return RQ.run_latest(
        rows, "session", "seq", ["event_type", "value"], scratch_path(spark, "latest"), "ts"
    )


@query(
    "latest_per_session_batch",
    "SELECT user_id AS session, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, "
    "arg_max(value, event_id) AS value FROM events GROUP BY user_id",
)
def latest_batch(spark, sf):
    rows = X.table(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), "event_type", "value"
    )
    return RQ.latest_per_key(rows, "session", "seq", ["event_type", "value"])


# --- learning ------------------------------------------------------------------------------


def features(spark, sf):
    return X.table(spark, sf, "embeddings").select(
        "vec_id",
        "embedding",
        F.col("label").alias("class_index"),
        F.col("vec_id").cast("string").alias("group_id"),
    )


@query(
    "head_scores",
    "SELECT CAST(label AS INTEGER) AS y_true, count(*) AS sample_count, true AS distributions "
    "FROM embeddings WHERE vec_id % 5 = 0 GROUP BY label",
)
def head(spark, sf):
    """A head fitted on four fifths of the rows scores the rest."""
    rows = features(spark, sf)
    model = LE.fit_head(rows.filter("vec_id % 5 <> 0"), 64, 10, hidden=16, rounds=10)
    scored = LE.score(rows.filter("vec_id % 5 = 0"), model)
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy("y_true").agg(
        F.count("*").alias("sample_count"),
        F.bool_and((F.size("probs") == 10) & (F.abs(total - 1) < 1e-9)).alias("distributions"),
    )


def out_of_fold(spark, sf):
    return X.remembered(
        spark, sf, "oof", lambda: LE.cross_validate(features(spark, sf), 64, 10, rounds=5)
    )


@query(
    "cross_validation_coverage",
    "SELECT count(*) AS expected_rows, count(*) AS observed_rows, CAST(0 AS BIGINT) AS missing, "
    "CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS repeated FROM embeddings",
)
def oof(spark, sf):
    return FO.oof_coverage(features(spark, sf), out_of_fold(spark, sf), "vec_id")


@query(
    "cross_validation_metrics",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT CAST(f AS INTEGER) AS fold, CAST(sum(n // 5 + CASE WHEN (f + 9 - label) % 5 < n % 5 THEN 1 ELSE 0 END) AS BIGINT)
  AS sample_count, true AS in_range FROM c, range(1, 6) t(f) GROUP BY f""",
)
def oof_metrics(spark, sf):
    """Scores per fold; how well the head learns is not known to SQL, how many rows it gets is."""
    scores = M.metric_bundle(out_of_fold(spark, sf), 10, ["fold"])
    inside = F.col("accuracy").between(0, 1) & F.col("roc_auc_ovr_macro").between(0, 1)
    return scores.select("fold", "sample_count", inside.alias("in_range"))
