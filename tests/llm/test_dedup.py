"""Near duplicates, line dedup and repeated passages against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, prose, table, words
from pyspark.sql import functions as F

from splitwarden.llm.lines import drop_repeated_lines, edit_distance, line_report, probes, segments
from splitwarden.llm.near_duplicates import band_keys, drop_near_duplicates, jaccard, near_duplicates, shingles, signatures
from splitwarden.llm.segments import remove_passages, repeated_passages, text_units
from splitwarden.llm.text import words_of


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    names = {}
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            names[i] = min(ids, default=None)
    return sorted(((rows[i][0], names[i]) for i in names), key=str)


def test_near_duplicate_classes(spark):
    rows = corpus()
    found = near_duplicates(table(spark, rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == plain_classes(rows)


def test_near_duplicate_chain_and_large_class(spark):
    base = prose(500, 200).split()
    rows = [(i, " ".join(base[: 200 - i % 40])) for i in range(300)]  # every text near its neighbours
    rows += [(1000 + i, prose(600 + i, 60)) for i in range(30)]
    found = near_duplicates(table(spark, rows).repartition(4)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in found), key=str) == plain_classes(rows)


def test_near_duplicate_filter(spark):
    docs = table(spark, corpus())
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    names = {c for d, c in plain_classes(corpus())}
    assert sorted(set(ids), key=str) == sorted(names, key=str)
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert drop_near_duplicates(table(spark, [])).count() == 0


def test_registers_agree_as_often_as_the_similarity_says():
    rnd = random.Random(1)
    for changed in (0, 4, 12, 30):
        base = [str(rnd.random()) for _ in range(400)]
        other = [w if rnd.random() > changed / 400 else "new" + w for w in base]
        a, b = pa.array([" ".join(base)]), pa.array([" ".join(other)])
        row, element, count = shingles(words_of(pa.array([a[0].as_py(), b[0].as_py()])))
        registers = signatures(2, row, element, 1 + np.log(count))
        assert abs((registers[0] == registers[1]).mean() - jaccard(words_of(a), words_of(b))[0]) < 0.12
        assert band_keys(registers).shape == (2, 32)


def test_repeats_do_not_hide_a_near_duplicate(spark):
    rows = []
    for i in range(150):  # the same shingles, one half or the other repeated 100 times
        a, b = prose(2000 + i, 12), prose(5000 + i, 12)
        one = " ".join([a] * 100 + [b] * 3 + [a])
        other = " ".join([a] * 3 + [b] * 100 + [a])
        rows += [(2 * i, one), (2 * i + 1, other)]
        assert jaccard(words_of(pa.array([one])), words_of(pa.array([other])))[0] == 1
    found = near_duplicates(table(spark, rows).repartition(4)).collect()
    assert {(r.doc_id, r.class_id) for r in found} == {(d, d // 2 * 2) for d, _ in rows}


def test_edit_distance_and_probes():
    rnd = random.Random(5)
    for _ in range(6000):
        alphabet = "ab" if rnd.random() < 0.5 else "abcdé漢"
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(6, 40)))
        b = list(a)
        for _ in range(rnd.randrange(5)):
            p = rnd.randrange(len(b))
            rnd.choice([lambda: b.pop(p), lambda: b.insert(p, rnd.choice(alphabet)), lambda: b.__setitem__(p, "x")])()
        b = "".join(b)
        for t in (1, 2, 3):
            near = plain_distance(a, b) <= t
            assert (edit_distance(a, b, t) <= t) == near
            short, long = sorted((a, b), key=len)
            if near and len(short) > 2 * t:
                index = {(len(short), i, short[s : s + n]) for i, (s, n) in enumerate(segments(len(short), t + 1))}
                assert index & {(n, i, long[s : s + k]) for n, i, s, k in probes(len(long), t)}


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def line_corpus():
    rnd = random.Random(8)
    lines = [prose(i, 6) for i in range(25)]
    rows = []
    for i in range(60):
        chosen = []
        for _ in range(rnd.randrange(1, 5)):
            line = list(rnd.choice(lines))
            for _ in range(rnd.randrange(4)):
                line[rnd.randrange(len(line))] = "z"
            chosen.append("".join(line))
        rows.append((i, "\n".join([*chosen, "short"])))
    return rows + [(None, rows[0][1]), (90, None), (91, ""), (92, "  " + rows[1][1].split("\n")[0] + "\t"), (3, rows[3][1])]


def plain_removed(rows):
    places = []
    for doc, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if len(line) >= 20:
                places.append(((doc is None, doc or 0, no), line))
    first = {}
    for place, line in sorted(places):
        first.setdefault(line, place)
    near = {
        a: min(first[b] for b in first if abs(len(a) - len(b)) <= 2 and plain_distance(a, b) <= 2) for a in first
    }
    return {place for place, line in places if place != min(first[line], near[line])}


def test_line_dedup(spark):
    rows = line_corpus()
    removed = plain_removed(rows)
    found = line_report(table(spark, rows).repartition(3)).collect()
    assert len(found) == len(rows)
    got = {(r.doc_id is None, r.doc_id or 0, n) for r in found for n in r.removed_lines}
    assert got == removed and all(r.n_removed == len(r.removed_lines) for r in found)
    docs = table(spark, rows)
    cleaned = drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    for r in cleaned.collect():
        text = dict((d, t) for d, t in rows)[r.doc_id]
        kept = [x for n, x in enumerate((text or "").split("\n")) if (r.doc_id is None, r.doc_id or 0, n) not in removed]
        assert (r.text or "") == "\n".join(kept)
    assert line_report(table(spark, [])).count() == 0 and drop_repeated_lines(table(spark, [])).count() == 0


def test_the_halves_of_a_line_digest_are_independent(spark):
    from splitwarden.llm.lines import _occurrences

    rows = _occurrences(table(spark, line_corpus()), "doc_id", "text", 20)
    # A 64-bit hash of the first half alone would tell lines apart no better than that half.
    dependent = F.col("digest_b") == F.xxhash64("text", F.lit(1))
    assert rows.count() > 0 and rows.filter(dependent).count() == 0


def test_a_document_without_lines_left_is_dropped(spark):
    line = "a line that is long enough to count"
    docs = table(spark, [(1, line), (2, line + "!"), (3, None), (4, "")])
    assert sorted(r.doc_id for r in drop_repeated_lines(docs).collect()) == [1, 3, 4]


def test_repeated_passages(spark):
    passage = prose(700, 60)
    rows = corpus(2)[:40] + [(400 + i, f"{prose(710 + i, 40)} {passage.upper()} {prose(730 + i, 30)}") for i in range(6)]
    rows += [(None, passage), (500, None), (501, ""), (502, "The same notice of one line."), (503, "The same notice of one line.")]
    found = repeated_passages(table(spark, rows).repartition(4)).collect()
    flagged = {r.doc_id for r in found}
    assert flagged == {401, 402, 403, 404, 405, None}
    texts = dict(rows)
    for r in found:
        cut = words(texts[r.doc_id][r.start : r.stop])
        assert len(cut) == r.n_words and " ".join(cut) in passage and r.kept_doc_id == 400
        assert " ".join(words(texts[400][r.kept_start :])[:3]) in " ".join(cut)
    docs = table(spark, rows)
    cleaned = {r.doc_id: r.text for r in remove_passages(docs).collect()}
    assert cleaned[400] == texts[400] and cleaned[500] is None and cleaned[502] == texts[502]
    spans = {r.doc_id: r for r in found}
    for doc in (401, 405):
        assert cleaned[doc] == texts[doc][: spans[doc].start] + texts[doc][spans[doc].stop :]
    assert repeated_passages(table(spark, [])).count() == 0


def test_passages_of_equal_rows_and_of_one_document(spark):
    passage = prose(800, 50)
    rows = [(1, passage), (1, passage), (2, passage + "\n" + passage + "\n" + prose(801, 30))]
    found = repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in found} == {2} and all(r.kept_doc_id == 1 for r in found)


@pytest.mark.parametrize("where", [0, 7, 23])
def test_a_passage_is_found_wherever_it_stands(spark, where):
    rows = []
    for i in range(40):
        passage = prose(900 + i, 52)
        rows += [(2 * i, passage), (2 * i + 1, f"{prose(i, where)} {passage} {prose(50 + i, 9)}")]
    flagged = {r.doc_id for r in repeated_passages(table(spark, rows)).collect()}
    assert len(flagged & {2 * i + 1 for i in range(40)}) >= 39 and not flagged & {2 * i for i in range(40)}


def test_a_passage_stays_whole_when_edited_copies_stand_earlier(spark):
    rows = []
    for i in range(20):
        passage = prose(6000 + i, 96).split()
        edited = [f"edit{i}x{k}" if k % 12 == 5 else w for k, w in enumerate(passage)]
        rows += [(10 * i, " ".join(edited)), (10 * i + 1, " ".join(passage))]
        rows += [(10 * i + 2, f"{prose(7000 + i, 30)} {' '.join(passage)} {prose(8000 + i, 30)}")]
    found = defaultdict(list)
    for r in repeated_passages(table(spark, rows)).collect():
        found[r.doc_id].append(r.n_words)
    # One run each, whole but for the units cut at its two ends.
    assert all(len(found[10 * i + 2]) == 1 and found[10 * i + 2][0] >= 70 for i in range(20)), found
    # Two short notices of different documents that stand together once are no passage.
    a, b = prose(9000, 10), prose(9001, 10)
    notices = [(1, f"{a}\n{prose(9002, 30)}"), (2, f"{prose(9003, 30)}\n{b}"), (3, f"{a}\n{b}")]
    assert repeated_passages(table(spark, notices)).count() == 0


def plain_passages(units, min_words=16):
    """The stated rule over a list of units, one after the other."""
    rank = lambda u: (u.doc_id is None, u.doc_id or 0, u.start)
    digest = lambda u: (u.hash_a, u.hash_b)
    keeper, times = {}, defaultdict(int)
    for u in units:
        key = (*rank(u), u.text_key, u.unit)
        times[digest(u)] += 1
        if digest(u) not in keeper or key < keeper[digest(u)]:
            keeper[digest(u)] = key
    documents = defaultdict(dict)
    for u in units:
        documents[u.doc_id, u.text_key][u.unit] = u
    stands = defaultdict(set)
    for found in documents.values():
        for n, u in found.items():
            if n + 1 in found:
                stands[digest(u), digest(found[n + 1])].add(rank(u))
    out = []
    for (doc, _), found in documents.items():
        repeats = [found[n] for n in sorted(found) if rank(found[n]) != keeper[digest(found[n])][:3]]
        run = []
        for u in [*repeats, None]:
            if run and u is not None and u.unit == run[-1].unit + 1:
                a, b = keeper[digest(run[-1])], keeper[digest(u)]
                if (a[1], a[0], a[3], a[4] + 1) == (b[1], b[0], b[3], b[4]) or min(stands[digest(run[-1]), digest(u)]) < rank(run[-1]):
                    run.append(u)
                    continue
            if run and sum(x.words for x in run) >= min_words:
                first = keeper[digest(run[0])]
                out.append((doc, run[0].start, run[-1].stop, sum(x.words for x in run), None if first[0] else first[1], first[2]))
            run = [u]
    return sorted(out, key=str)


def passage_corpus(seed):
    rnd = random.Random(seed)
    passages = [prose(3000 + seed * 50 + i, 6 + rnd.randrange(40)) for i in range(14)]
    rows = corpus(seed)[:50] + [(None, passages[0]), (None, passages[0] + " " + passages[1]), (77, passages[2]), (77, passages[2] + "\n" + passages[3])]
    for i in range(120):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else prose(rnd.randrange(10**6), rnd.randrange(1, 30)) for _ in range(rnd.randrange(1, 6))]
        rows.append((1000 + i, rnd.choice([" ", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_follow_the_rule(spark, seed):
    docs = table(spark, passage_corpus(seed)).repartition(5)
    units = text_units(docs).distinct().collect()
    found = repeated_passages(docs).select("doc_id", "start", "stop", "n_words", "kept_doc_id", "kept_start").collect()
    assert sorted(map(tuple, found), key=str) == plain_passages(units)
    assert len(found) > 60
    # The filter leaves out units that occur once, and no others.
    fewer = text_units(docs, repeats_only=True).select("hash_a", "hash_b").collect()
    times = defaultdict(int)
    for u in text_units(docs).collect():
        times[u.hash_a, u.hash_b] += 1
    assert sum(1 for u in fewer if times[u.hash_a, u.hash_b] > 1) == sum(n for n in times.values() if n > 1)
    assert len(fewer) < sum(times.values())


def test_only_what_stands_together_is_joined(spark):
    p, q, between = prose(9100, 10), prose(9101, 10), prose(9102, 60)
    rows = [(1, f"{p}\n{between}\n{q}"), (2, f"{p}\n{q}")]
    assert repeated_passages(table(spark, rows)).count() == 0
    # Once the two stand together somewhere, the next time is a repeat.
    found = repeated_passages(table(spark, rows + [(3, f"{p}\n{q}")])).collect()
    assert [(r.doc_id, r.n_words) for r in found] == [(3, 20)]


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = table(spark, passage_corpus(3)).repartition(3)
    expected = sorted(map(tuple, repeated_passages(docs).collect()), key=str)
    monkeypatch.setattr("splitwarden.llm.segments.FILTER_BITS", 4)
    assert sorted(map(tuple, repeated_passages(docs).collect()), key=str) == expected
