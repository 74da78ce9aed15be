"""The conversation trie against a plain version that looks at every prefix."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from splitwarden.llm.queries import op13_conversation_trie
from splitwarden.llm.trie import conversation_trie, conversation_turns, ending_members, rebuild

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, depth string, a int, end_a int, n int, block int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None, 2, 3, 4) for r in rows], SCHEMA)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {}
    for c, found in own.items():
        # Equal turn numbers are ordered by digest.
        found.sort(key=lambda r: (*r[:2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        turns[c] = [(role, text) for _, _, role, text in found]
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + turns[c][h:]
    return rebuilt


def plain_trie(rows):
    rebuilt = plain_rebuilt(rows)
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
            if d:
                children[tuple(rebuilt[c][: d - 1])].add(tuple(rebuilt[c][:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(rebuilt[c]) == len(node))
        out.append((ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def check(spark, rows, parts=4):
    found = conversation_trie(conversations(spark, rows).repartition(parts))
    assert sorted(map(tuple, found.collect())) == plain_trie(rows)


def test_rebuilt_sequences(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (20, 21, 22, 25, 47, 48, 5, 60) for t in range(c % 5 + 1)]
    turns, convs = rebuild(conversation_turns(conversations(spark, rows)))
    want = plain_rebuilt(rows)
    assert {r.conv_id: r.length for r in convs.collect()} == {c: len(s) for c, s in want.items()}
    places = sorted((r.conv_id, r.pos) for r in turns.collect())
    assert places == sorted((c, i) for c, s in want.items() for i in range(len(s)))


def test_shared_beginnings(spark):
    rnd = random.Random(5)
    rows = []
    for c in range(160):
        shared = rnd.choice([0, 2, 3, 7])
        for t in range(rnd.randrange(1, 11)):
            rows.append((c, t, rnd.choice("ab"), f"same {t}" if t < shared else f"w {rnd.randrange(3)} {t}"))
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "", ""), (2, None, "", ""), (2, 0, "", None), (3, 5, "u", "x y"), (3, 5, "u", "x y"),
            (3, 5, "u", "other"), (None, 0, "u", "lost"), (4, 0, "us", "er"), (5, 0, "u", "ser"), (40, 0, "s", "long " * 100_000),
            (41, 0, "s", "one"), (44, 0, "s", "one"), (46, 0, "s", "\tone\x0btwo é")]
    check(spark, rows)


def test_deep_and_copied_conversations(spark):
    long = [(c, t, "u", f"turn {t % 7}") for c in (100, 101) for t in range(300 + c)]
    copies = [(c, t, "u", f"copy {t}") for c in range(200, 320) for t in range(3)]
    check(spark, long + copies)


def test_long_pieces_are_joined_with_salts(spark, monkeypatch):
    monkeypatch.setattr("splitwarden.llm.trie.TARGET_ROWS", 8)
    monkeypatch.setattr("splitwarden.operators.scale.TARGET_ROWS", 8)
    check(spark, [(c, t, "u", f"turn {t}") for c in (100, 101, 102) for t in range(20 + c % 3)])


def test_one_turn_and_no_rows(spark):
    check(spark, [(7, 0, "u", "a b c")])
    assert conversation_trie(conversations(spark, [])).count() == 0


def test_hot_lists_are_made_in_parts(spark):
    check(spark, [(c, 0, "u", "same") for c in range(0, 2000, 20)] + [(c, 0, "u", "same") for c in range(1, 60, 20)])
    ends = spark.createDataFrame([(1, 2, 3, c) for c in range(100)] + [(1, 2, 4, 7)], "depth bigint, a bigint, b bigint, conv_id bigint")
    found = {r.b: r.ends_sha256 for r in ending_members(ends, part_ids=3).collect()}
    assert found == {3: hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest(), 4: hashlib.sha256(b"7").hexdigest()}


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, op13_conversation_trie(spark, folder).collect())) == plain_trie([tuple(r) for r in table.collect()])
