"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitwarden.llm.decontaminate import decontamination_report
from splitwarden.llm.lexical import lexical_search
from splitwarden.llm.license import license_scan
from splitwarden.llm.lines import line_report
from splitwarden.llm.near_duplicates import near_duplicates
from splitwarden.llm.packing import pack_documents
from splitwarden.llm.pii import replace_pii
from splitwarden.llm.quality import quality_report
from splitwarden.llm.segments import repeated_passages
from splitwarden.llm.simhash import as_hex, simhash_classes
from splitwarden.llm.tokenfile import read_token_files, write_token_files
from splitwarden.llm.trie import conversation_trie
from splitwarden.llm.warc import read_records, write_archives
from splitwarden.operators.scale import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The name of the failed rule depends on the measured order, so it is not part of the result.
    return quality_report(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return report.drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(_table(spark, sf_dir, "pages"), folder)
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_records(index, folder, fields)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "stop", "n_words", "kept_doc_id", "kept_start")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    written = write_token_files(_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, written)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("splitwarden.pii.key", "a key for tests; production sets its own")
    replaced = replace_pii(_table(spark, sf_dir, "documents"), key.encode())
    return replaced.select(
        "doc_id",
        F.size("pii_changes").cast("bigint").alias("n_entities"),
        "text",
        F.transform("pii_changes", lambda c: c["kind"]).alias("kinds"),
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_warc": op7_warc,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_token_files": op9_token_files,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_lexical_search": op11_lexical_search,
    "op12_simhash": op12_simhash,
    "op13_conversation_trie": op13_conversation_trie,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL: dict[str, str] = {
    "op4_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1),
      lambda i: {'i': i, 'g': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]})) AS u
  FROM w WHERE len(ws) >= 3
), twice AS (
  SELECT doc_id, u.i AS i, count(*) OVER (PARTITION BY doc_id, u.g) AS n FROM g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words
    OR word_chars > 25 * n_words OR 5 * n_symbols > word_chars OR 3 * n_dup_lines > n_lines) AS kept
FROM m""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_words("text")} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(ws)) AS n, unnest(list_transform(
    range(1, len(ws) - least(13, len(ws)) + 2),
    lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS win
  FROM b WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2),
    lambda i: {{'i': i, 'win': array_to_string(ws[i:i + n - 1], ' ')}})) AS u
  FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n
), hits AS (
  SELECT doc_id, u.i AS i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.u.win = bw.win
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id
    THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_lexical_search": f"""
WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents),
size AS (SELECT count(*) FILTER (len(ws) > 0) AS n, sum(len(ws))::BIGINT AS total FROM d),
tf AS (
  SELECT doc_id, w, count(*) AS tf, any_value(n) AS n
  FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) GROUP BY doc_id, w
), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
q AS (
  SELECT item_id, w, count(*) AS repeats
  FROM (SELECT item_id, unnest({_words("text")}) AS w FROM benchmark) GROUP BY item_id, w
), scored AS (
  SELECT item_id, doc_id, sum(repeats * floor(1000 * ln((2 * size.n + 2) / (2 * df + 1)))::BIGINT
      * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * tf.n * size.n) // size.total))))::BIGINT AS score
  FROM q JOIN df USING (w) JOIN tf USING (w), size GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank,
  doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
    "op13_conversation_trie": r"""
WITH RECURSIVE cells AS (
  SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM cells WHERE k < 8
), crc_table AS (SELECT b, v FROM cells WHERE k = 8),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, name, 4294967295::BIGINT AS v, 0 AS place FROM ids
  UNION ALL
  SELECT conv_id, name, xor(crc.v >> 8, crc_table.v), place + 1
  FROM crc JOIN crc_table ON b = (xor(crc.v, ascii(name[place + 1])) & 255) WHERE place < length(name)
), borrow AS (SELECT conv_id, (xor(v, 4294967295) % 4)::INTEGER AS h FROM crc WHERE place = length(name)),
own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id
), rebuilt AS (
  SELECT own.conv_id, list_concat(coalesce(donor.turns[:h], []), own.turns[h + 1:]) AS turns
  FROM own JOIN borrow USING (conv_id) LEFT JOIN own AS donor ON donor.conv_id = own.conv_id - own.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, sha256((turns[:d])::VARCHAR) AS name,
    CASE WHEN d > 0 THEN sha256((turns[:d - 1])::VARCHAR) END AS above, d = len(turns) AS ends,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^ 	-
]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, name, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, name
), kids AS (SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, name)),
subtrees AS (
  SELECT p.d, p.name, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM full_nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.name
)
SELECT n.conv_id, n.d::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children,
  s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s USING (d, name) LEFT JOIN full_nodes a ON a.d = n.d - 1 AND a.name = n.above""",
}
