"""The trie of conversation prefixes by van Emde Boas recursion.

A conversation is a sequence of turns. The trie's node of depth d is a distinct prefix of d turns;
a conversation is a member of every prefix it starts with.

The recursion cuts sequences at half their depth. The prefix that ends at the cut is named by a
128-bit digest, the different upper halves make the upper trie, and the lower halves under one
cut prefix make a lower forest. Upper trie and lower forests are again tries of half the depth, so
they are cut in the next round, all of them in one Spark job: a row is one turn of one distinct
piece, and a piece is known by the names of the prefixes at its two ends. Equal upper halves melt
into one by an aggregate (least conversation id, sum of members), so copies disappear at the first
round and shared beginnings round by round. After log2(depth) rounds a piece is one turn long, and
each row is a node.

Totals go up the same way. Each node's own numbers lie on one row, that of its least member. Where a
piece is cut, the sum of its lower half is grafted to all rows of its upper half; when equal upper
halves melt, the grafts add up. A row gets every node below it exactly once, in the round in which
the two are parted, so log2(depth) rounds give the totals of all subtrees, however deep they are.

A piece shorter than half of the round's length has nothing to melt with yet, so it waits for the
round of its own length: a turn takes part in as many rounds as its own conversation asks for, not
in those of the deepest one.

Rows are narrow (names and counts, no text), aggregates combine before the shuffle, and a piece of
round k has at most 2**k rows, so sums over pieces have no hot key; pieces longer than one task
should get are summed by partial aggregates and joined with salts. Turns are numbered by a range sort, so one conversation may hold a third of
all turns. A node's list of ending members is made in parts by a range sort as well, and only the
finished parts, some thousand ids each, are hashed one after the other.

Cases: rows without a conv_id are left out; null roles and texts are empty; equal turn numbers are
ordered by digest of role and text, a null turn comes first; repeated rows are turns of their own;
an empty table gives no rows; a conversation without turns is a member of the root alone; very
long texts enter by digest and word count only; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splitwarden.operators.scale import TARGET_ROWS, attach, materialise, number_rows, release

DONOR_STEP = 20  # conversations c - c % DONOR_STEP lend their first turns
MOST_BORROWED = 4  # a conversation borrows crc32(c) % MOST_BORROWED turns
PART_IDS = 10_000  # ids of one part of a node's list of ending members
_PIECE = ["end_a", "end_b"]  # the prefix at a piece's end names the piece
_ROW = [*_PIECE, "size", "pos", "top_a", "top_b", "hash_a", "hash_b"]
_NODE = ["depth", "a", "b"]


def conversation_turns(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, pos from 0, symbol, words): every turn in order, role and text as a digest."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256)).alias("symbol"),
        F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    turns = materialise(turns, "turns")
    numbered = number_rows(turns, ["conv_id", "turn", "symbol"], {"pos": ["conv_id"]})
    return numbered.select("conv_id", (F.col("pos") - 1).alias("pos"), "symbol", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): the first h turns of each conversation come from its donor.

    h is the CRC-32 of the decimal id modulo ``MOST_BORROWED``; the donor of c is c - c % ``DONOR_STEP``.
    """
    turns = materialise(turns, "numbered-turns")
    convs = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    donors = convs.filter(F.col("conv_id") % DONOR_STEP == 0).select(
        F.col("conv_id").alias("donor"), F.col("n").alias("donor_n")
    )
    wanted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_BORROWED
    convs = (
        convs.withColumn("h", wanted)
        .withColumn("donor", F.col("conv_id") - F.col("conv_id") % DONOR_STEP)
        .join(donors, "donor", "left")
        .withColumn("got", F.least("h", F.coalesce("donor_n", F.lit(0))))
        .withColumn("length", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
        .select("conv_id", "donor", "n", "h", "got", "length")
    )
    convs = materialise(convs, "rebuilt")
    heads = turns.filter((F.col("conv_id") % DONOR_STEP == 0) & (F.col("pos") < MOST_BORROWED - 1)).select(
        F.col("conv_id").alias("donor"), "pos", "symbol", "words"
    )
    borrowed = convs.join(heads, "donor").filter(F.col("pos") < F.col("h"))
    own = attach(turns, convs.select("conv_id", "n", "h", "got"), "conv_id", "n").filter(F.col("pos") >= F.col("h"))
    columns = ["conv_id", "pos", "symbol", "words"]
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("got"))
    return own.select(columns).unionByName(borrowed.select(columns)), convs.select("conv_id", "length")


def _hashes() -> list[Column]:
    """Two independent hashes of a turn at its place; a prefix is named by their exclusive or."""
    return [F.xxhash64(F.lit(seed), "symbol", "pos").alias(name) for seed, name in ((1, "hash_a"), (2, "hash_b"))]


def cut_pieces(rows: DataFrame, k: int, least: list[str], totals: list[str], graft: dict[str, str] | None = None) -> DataFrame:
    """Cut pieces of up to 2**k turns into halves; equal upper halves become one.

    ``least`` and ``totals`` are columns that melt by minimum and sum; ``graft`` adds the sum of
    a column over a piece's lower half to another column of its upper half.
    """
    graft = graft or {}
    half = 1 << (k - 1)
    lower = F.shiftright("pos", k - 1) % 2 == 1
    block = F.shiftright("pos", k).alias("block")
    rows = rows.select("*", block)
    key = [*_PIECE, "block"]
    sums = {
        "half_a": F.bit_xor(F.when(lower, 0).otherwise(F.col("hash_a"))),
        "half_b": F.bit_xor(F.when(lower, 0).otherwise(F.col("hash_b"))),
        **{f"below_{c}": F.sum(F.when(lower, F.col(c)).otherwise(0)) for c in graft},
    }
    if half < TARGET_ROWS:
        # A piece has at most 2**k rows, so a window over a piece is bounded.
        piece = Window.partitionBy(*key)
        cut = rows.withColumns({name: total.over(piece) for name, total in sums.items()})
    else:
        owned = F.count("*").alias("owned")
        pieces = rows.groupBy(*key).agg(owned, *[total.alias(name) for name, total in sums.items()])
        cut = attach(rows, pieces, key, "owned")
    cut_a, cut_b = F.col("top_a").bitwiseXOR(F.col("half_a")), F.col("top_b").bitwiseXOR(F.col("half_b"))
    grafted = {
        into: F.when(lower, F.col(into)).otherwise(F.col(into) + F.col(f"below_{c}")) for c, into in graft.items()
    }
    halves = cut.select(
        F.when(lower, F.col("end_a")).otherwise(cut_a).alias("end_a"),
        F.when(lower, F.col("end_b")).otherwise(cut_b).alias("end_b"),
        F.when(lower, F.col("size") - half).otherwise(F.least("size", F.lit(half))).alias("size"),
        "pos",
        F.when(lower, cut_a).otherwise(F.col("top_a")).alias("top_a"),
        F.when(lower, cut_b).otherwise(F.col("top_b")).alias("top_b"),
        "hash_a",
        "hash_b",
        *least,
        *[grafted.get(c, F.col(c)).alias(c) for c in totals],
    )
    return _melt(halves, least, totals)


def _melt(rows: DataFrame, least: list[str], totals: list[str]) -> DataFrame:
    return rows.groupBy(*_ROW).agg(
        *[F.min(c).alias(c) for c in least], *[F.sum(c).alias(c) for c in totals]
    )


def _recurse(rows: DataFrame, rounds: int, *columns) -> DataFrame:
    """All rounds of cutting, each stored once.

    Round k takes the pieces of 2**(k-1) to 2**k turns: those of the round before and those that
    have waited, of earlier rounds.
    """
    stored = [rows]
    for k in range(rounds, 0, -1):
        half = 1 << (k - 1)
        waiting = [t.filter((F.col("size") >= half) & (F.col("size") < 2 * half)) for t in stored[:-1]]
        active = reduce(DataFrame.unionByName, [*waiting, stored[-1].filter(F.col("size") >= half)])
        stored.append(materialise(cut_pieces(active, k, *columns), f"pieces-{k - 1}"))
    release(*stored[1:-1])
    return stored[-1]


def _parts(most: int):
    """Runs of one node's ids, in order, as comma-joined text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(c).to_pylist() for c in _NODE]))
            names = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
            ids = batch.column("conv_id").to_pylist()
            rows, low = [], 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[low] or at - low == most:
                    rows.append((*keys[low], ids[low], ",".join(names[low:at])))
                    low = at
            columns = [pa.array(c) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_NODE, "first_id", "ids"])

    return run


def _hash_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's parts, which follow each other in order."""
    key, digest, done = None, None, []
    for batch in batches:
        for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "ids")]):
            if node != key:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*_NODE, "ends_sha256"])
            done = []
    if key:
        last = (*key, digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in last], names=[*_NODE, "ends_sha256"])


def ending_members(ends: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """(depth, a, b, ends_sha256): digest of the ids that end at each node, in numerical order."""
    order = [*_NODE, "conv_id"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _parts(part_ids), "depth bigint, a bigint, b bigint, first_id bigint, ids string"
    )
    in_order = parts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first_id")
    return in_order.mapInArrow(_hash_parts, "depth bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv_id, pos, symbol, words).

    ``conversations`` has the length of every conversation, those without turns too.
    """
    spark = turns.sparkSession
    rows = materialise(turns.select("conv_id", "pos", "words", *_hashes()), "trie-turns")
    whole = conversations.agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n"), F.max("length").alias("depth")
    ).first()
    rounds = max(0, (whole["depth"] or 0) - 1).bit_length()
    names = rows.groupBy("conv_id").agg(
        F.bit_xor("hash_a").alias("end_a"), F.bit_xor("hash_b").alias("end_b"), F.count("*").alias("size")
    )
    names = materialise(names, "sequence-names")
    zero = F.lit(0).cast("bigint")
    ends = conversations.join(names, "conv_id", "left").select(
        F.col("length").alias("depth"),
        F.coalesce("end_a", zero).alias("a"),
        F.coalesce("end_b", zero).alias("b"),
        "conv_id",
    )
    digests = ending_members(materialise(ends, "ends"))

    # Down: from distinct sequences to nodes.
    sequences = attach(rows, names, "conv_id", "size").select(
        *_PIECE, "size", "pos", zero.alias("top_a"), zero.alias("top_b"), "hash_a", "hash_b",
        "conv_id", "words", F.lit(1).cast("bigint").alias("n_convs"),
    )
    # Equal turns have equally many words, so any minimum is theirs.
    sequences = materialise(_melt(sequences, ["conv_id", "words"], ["n_convs"]), "sequences")
    found = _recurse(sequences, rounds, ["conv_id", "words"], ["n_convs"])
    nodes = found.select(
        (F.col("pos") + 1).alias("depth"), F.col("end_a").alias("a"), F.col("end_b").alias("b"),
        "top_a", "top_b", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("top_a").alias("a"), F.col("top_b").alias("b"))
    children = materialise(children.agg(F.count("*").alias("n_children")), "children")
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialise(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "nodes")

    # Up: own numbers lie on the row of the least member, grafts collect what is below.
    own = nodes.select("conv_id", (F.col("depth") - 1).alias("pos"), "leaf", "saved")
    numbers = ["leaf", "saved", "leaf_below", "saved_below"]
    start = sequences.drop("n_convs", "words").join(own, ["conv_id", "pos"], "left").select(
        *_ROW,
        F.coalesce("leaf", zero).alias("leaf"),
        F.coalesce("saved", zero).alias("saved"),
        zero.alias("leaf_below"),
        zero.alias("saved_below"),
    )
    start = materialise(start, "totals")
    totals = _recurse(start, rounds, [], numbers, {"leaf": "leaf_below", "saved": "saved_below"}).select(
        (F.col("pos") + 1).alias("depth"),
        F.col("end_a").alias("a"),
        F.col("end_b").alias("b"),
        (F.col("leaf") + F.col("leaf_below")).alias("n_leaves"),
        (F.col("saved") + F.col("saved_below")).alias("saved_tokens"),
    )
    release(sequences)

    # The root stands for all conversations; it is one row of sums.
    below = nodes.agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).first()
    first = children.filter("depth = 0").first()
    root = (whole["least"], 0, 0, 0, whole["n"], first["n_children"] if first else 0, below["leaves"] or 1, below["saved"] or 0)
    fields = "conv_id bigint, depth bigint, a bigint, b bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    root = spark.createDataFrame([root] if whole["n"] else [], fields).withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    parents = nodes.filter("n_children > 0").select(
        F.col("depth").alias("above"), F.col("a").alias("top_a"), F.col("b").alias("top_b"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"),
    )
    parents = parents.unionByName(
        root.filter("n_children > 0").select(
            F.col("depth").alias("above"), F.col("a").alias("top_a"), F.col("b").alias("top_b"),
            F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"),
        )
    )
    joined = attach(
        nodes.join(totals, _NODE).withColumn("above", F.col("depth") - 1),
        parents, ["above", "top_a", "top_b"], "siblings", keep_size=False,
    )
    columns = ["conv_id", *_NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    result = joined.select(columns).unionByName(root.select(columns)).join(digests, _NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return result.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations; ``columns`` renames conv_id, turn, role, text."""
    turns, convs = rebuild(conversation_turns(conversations, **columns))
    return prefix_trie(turns, convs)
