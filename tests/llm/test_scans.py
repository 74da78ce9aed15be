"""Licence scan, quality rules and decontamination against plain versions."""

import hashlib
from collections import Counter

import pytest
from helpers import corpus, prose, table, words
from pyspark.sql import functions as F

from splitwarden.llm.decontaminate import decontamination_report, drop_contaminated, remove_spans
from splitwarden.llm.license import BASE_PHRASES, TEMPLATES, license_scan
from splitwarden.llm.quality import RULES, quality_filter, quality_report, rule_order

LICENSES = [
    (100, "Released under the MIT License. then text"),
    (101, "x MIT License y MIT-License z apache license"),
    (102, "This work is licensed under the GNU General Public License, version 3."),
    (103, "Licensed under CC BY-NC 4.0."),
    (104, "license mit, general and public license"),
    (105, "licensed under the apache licence version 2 0"),
    (106, TEMPLATES[2][1] + " tail"),
]


def test_license_base_columns_and_labels(spark):
    rows = corpus() + LICENSES
    found = license_scan(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by_text = Counter()
    for r in found:
        by_text[(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)] += 1
    expected = Counter()
    for doc, text in rows:
        w = words(text)
        starts, labels = [], set()
        for phrase, label in BASE_PHRASES.items():
            p = phrase.split()
            places = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += places
            labels |= {label} if places else set()
        expected[(doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))] += 1
    assert by_text == expected
    at = {r.doc_id: r for r in found}
    assert at[100].labels == "mit" and at[100].score == 1.0
    assert at[102].labels == "gpl,gpl-3.0" and at[103].labels == "cc-by-nc-4.0"
    assert at[106].labels == "mit-text" and at[104].labels == "" and at[105].labels == ""
    assert at[101].score == 0.5 and at[62].score == 0 and at[62].labels == ""


def test_license_of_no_rows(spark):
    assert license_scan(table(spark, [])).count() == 0


def measures(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    repeated = {p for i, g in enumerate(windows) if count[g] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality_measures(spark):
    rows = corpus() + [(200, "a b c a b c a b\n\nx\nx\n　 y\x0b"), (201, "one # two\n" * 60), (202, "a a a a"), (203, "a b")]
    found = quality_report(table(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found)
    expected = Counter()
    for doc, text in rows:
        m = measures(text)
        expected[(doc, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == expected
    assert all(not (r.base_failed and r.kept) for r in found)
    assert {r.doc_id for r in found if r.kept} >= {1, 2, 3, 67}


def test_quality_order_does_not_change_the_verdict(spark):
    docs = table(spark, corpus())
    order = [name for name, _, _ in rule_order(docs)]
    assert sorted(order) == sorted(RULES)
    kept = Counter(r.doc_id for r in quality_report(docs).collect() if r.kept)
    filtered = quality_filter(docs)
    assert filtered.columns == docs.columns
    assert Counter(r.doc_id for r in filtered.collect()) == kept
    assert quality_report(table(spark, [])).count() == 0


def test_quality_runs_no_python(spark):
    plan = quality_report(table(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_hits(text, items):
    w, hit, names = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add("null" if item is None else str(item))
    return w, hit, names


ITEMS = [(1, prose(70, 30)), (2, "Short ITEM here"), (3, None), (4, ""), (5, prose(71, 13)), (None, prose(72, 20)), (1, prose(70, 30)), (10, prose(70, 30))]


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_decontamination(spark, block_bytes):
    rows = corpus() + [
        (300, prose(80, 40) + " " + prose(70, 30) + " end"),
        (301, "a short, item HERE and " + prose(81, 400)),
        (302, prose(71, 13)),
        (303, " ".join(prose(71, 13).split()[:12])),
        (304, prose(72, 20).upper().replace(" ", ", ")),
        (305, prose(70, 30) + "\n" + prose(70, 30)),
    ]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination_report(table(spark, rows), items, block_bytes=block_bytes).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    expected = Counter()
    for doc, text in rows:
        w, hit, names = plain_hits(text, ITEMS)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected[(doc, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == expected
    assert any(n for (_, _, n, *_), _ in got.items())


def test_decontamination_cuts(spark):
    text = "Keep this. " + prose(71, 13).upper() + "! And that."
    docs = table(spark, [(1, text), (2, None), (3, "clean")])
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    cut = remove_spans(docs, items)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Keep this. ! And that.", 2: None, 3: "clean"}
    assert [r.doc_id for r in drop_contaminated(docs, items).orderBy("doc_id").collect()] == [2, 3]
    none = items.filter(F.lit(False))
    assert drop_contaminated(docs, none).count() == 3
    assert decontamination_report(docs.limit(0), items).count() == 0
