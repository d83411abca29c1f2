"""Conversation prefix trie: which conversations begin alike, and how many bytes of turns are saved if a shared beginning is kept once.

A node is a sequence of turns (role, text) with which at least one conversation begins; its members are the conversations that begin so, and its
smallest member owns it. A child's members are among its parent's, so a conversation that owns a node owns all nodes further down its own path:
**each conversation owns a suffix of its path**, which one number says, the depth `first` from which it is the owner (`length + 1` if it owns
nothing). From that, all counts of subtrees are sums over the members of a node, with no walk over the tree:

- bytes saved below a node = bytes of all occurrences - bytes of all owned nodes = for each member, the bytes at depths from the node's to `first - 1`;
- children = members that own the next node of their path;
- leaves = members whose last node is theirs and has nothing below it.

Windows over the turns of a conversation carry prefix and bytes along; the smallest member of each prefix (summed up before the shuffle) gives `first`
and so marks the owned nodes; one group-by of prefixes sums up the rest. A window by prefix would put the root, or a first turn that a
third of the conversations share, into one task, hence the minimum in its place.

A prefix is held as two 64-bit values: the exclusive or of a hash of (depth, role, text) over its turns. Texts are hashed where they are read;
no text is shuffled. Conversations of any length are split: turns are dealt by ranges of (conv_id, turn), running values are worked out
within a range, and the few conversations that span ranges (fewer than there are ranges) get what came before from a small table. The ids of
the conversations that end at a node are gathered by 4,096s of ids; where a node has several such pieces, its SHA-256, which is by nature taken in
order, is updated piece by piece.

Rebuilding (`rebuilt`): conversation c gets the first h turns of conversation c - c % 5 and its own turns after its first h, with h = crc32(c) % 9.

Defined results: null role or text counts as empty; null turns come first, turns that tie come in an order of their content, repeated rows
count as turns of their own; rows without a conv_id belong to no conversation; a conversation may be left without turns, it is then a member of the
root alone; only the four columns named are read; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, to_arrow

#: Conversations come in families of FAMILY ids; a rebuilt one takes fewer than HEAD turns from the first of its family.
FAMILY, HEAD = 5, 9
#: Ids of a piece of a node's ends.
PIECE = 4096
NODE = ["depth", "p1", "p2"]


def _bits(i: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(i), *parts)


def ranged_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, pos, t1, t2, bytes): a row for each turn with its place in its conversation, from 1, and two hashes of its content. part: the
    range of (conv_id, turn) that holds it."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _bits(1, empty("role"), empty("text")).alias("t1"), _bits(2, empty("role"), empty("text")).alias("t2"), F.octet_length(empty("text")).cast("long").alias("bytes"))
    # Written out, so that which turn is in which range is settled.
    dealt = staged(turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "turns")
    order = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    local = dealt.withColumn("at", F.row_number().over(order))
    before = _carried(dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")), {"n": F.sum}, {"n": "started"})
    return local.join(F.broadcast(before), ["conv_id", "part"], "left").select("conv_id", "part", (F.col("at") + F.coalesce("started", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def _carried(totals: DataFrame, how: dict, names: dict) -> DataFrame:
    """totals: one row for each (conv_id, part). Of conversations in several parts: what all parts before one come to. There are fewer such rows than
    twice the number of parts."""
    w = Window.partitionBy("conv_id").orderBy("part")
    several = totals.withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).filter("parts > 1")
    rows = w.rowsBetween(Window.unboundedPreceding, -1)
    return several.select("conv_id", "part", *[how[c](c).over(rows).alias(names[c]) for c in names])


def occurrences(turns: DataFrame) -> DataFrame:
    """(conv_id, length, whole, depth, p1, p2, q1, q2, bytes, total): for each rebuilt conversation a row for each of its prefixes, the root's with depth
    0; q1, q2: the prefix without its last turn; bytes: of its last turn; total: of all its turns; whole: of all turns of the conversation."""
    mix = lambda i, depth: _bits(i, depth, F.col("t1"), F.col("t2"))
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # The first turns of a family's first conversation: HEAD - 1 at most.
    first = turns.filter(f"conv_id % {FAMILY} = 0 and pos < {HEAD}").withColumns({"m1": mix(1, F.col("pos").cast("long")), "m2": mix(2, F.col("pos").cast("long"))})
    first = first.select("conv_id", F.col("pos").cast("long").alias("depth"), F.bit_xor("m1").over(running).alias("p1"), F.bit_xor("m2").over(running).alias("p2"), "m1", "m2", "bytes", F.sum("bytes").over(running).alias("total"))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("depth", "p1", "p2", (F.col("p1").bitwiseXOR(F.col("m1"))).alias("q1"), (F.col("p2").bitwiseXOR(F.col("m2"))).alias("q2"), "bytes", "total"))).alias("head"))
    turns = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD)
    rest = F.coalesce(F.sum(F.when(F.col("pos") > F.col("h"), F.col("bytes"))), F.lit(0))
    convs = turns.groupBy("conv_id", "h").agg(F.count("*").alias("own"), rest.alias("rest")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    taken = F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    convs = convs.join(heads, "base", "left").withColumn("k", F.when(F.col("head").isNull(), 0).otherwise(taken))
    convs = convs.withColumn("head", F.when(F.col("k") > 0, F.slice("head", F.lit(1), F.col("k").cast("int")))).withColumn("last", F.element_at("head", -1))
    zero = lambda c: F.coalesce(f"last.{c}", F.lit(0).cast("long"))
    convs = staged(convs.select("conv_id", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"), (zero("total") + F.col("rest")).alias("whole"), "head", zero("p1").alias("b1"), zero("p2").alias("b2"), zero("total").alias("taken")), "conversations")
    none = F.lit(0).cast("long")
    root = convs.select("conv_id", "length", "whole", none.alias("depth"), none.alias("p1"), none.alias("p2"), none.alias("q1"), none.alias("q2"), none.alias("bytes"), none.alias("total"))
    shared = convs.filter("k > 0").select("conv_id", "length", "whole", F.inline("head"))
    # Their own turns after the first h, each at its depth in the rebuilt conversation.
    rest = turns.filter("pos > h").join(convs.drop("head"), "conv_id").withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    rest = rest.withColumns({"m1": mix(1, F.col("depth")), "m2": mix(2, F.col("depth"))})
    totals = rest.groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("bytes").alias("n"))
    before = F.broadcast(_carried(totals, {"x1": F.bit_xor, "x2": F.bit_xor, "n": F.sum}, {"x1": "c1", "x2": "c2", "n": "c"}))
    local = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumns({"x1": F.bit_xor("m1").over(local), "x2": F.bit_xor("m2").over(local), "n": F.sum("bytes").over(local)}).join(before, ["conv_id", "part"], "left")
    xor = lambda b, c, x: F.col(b).bitwiseXOR(F.coalesce(c, none)).bitwiseXOR(F.col(x))
    rest = rest.withColumns({"p1": xor("b1", "c1", "x1"), "p2": xor("b2", "c2", "x2")})
    rest = rest.select("conv_id", "length", "whole", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("m1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("m2")).alias("q2"), "bytes", (F.col("taken") + F.coalesce("c", none) + F.col("n")).alias("total"))
    return root.unionByName(shared).unionByName(rest)


def _digests(pieces: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes with several pieces: the pieces of a node come one after another and update one hash."""
    kind = "depth long, p1 long, p2 long, ends_sha256 string"
    arrow = to_arrow(pieces.sparkSession, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for batch in batches:
            for *at, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256(ids.encode())
            if len(out) > PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if node:
            out.append((*node, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(run, kind)


def ends(met: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of every node at which a conversation ends: SHA-256 of their ids, ascending, joined by commas."""
    # Ids are distinct, so a piece has PIECE ids at most, however many end at the node.
    pieces = met.filter("depth = length").groupBy(*NODE, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    pieces = staged(pieces, "ends")
    n = pieces.groupBy(*NODE).agg(F.count("*").alias("pieces"), F.min("ids").alias("ids"))
    one = n.filter("pieces = 1").select(*NODE, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    return one.unionByName(_digests(pieces.join(n.filter("pieces > 1").select(*NODE), NODE, "left_semi")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (bytes) and ends_sha256."""
    met = staged(occurrences(ranged_turns(conversations)), "prefixes")
    same = [F.min(c).alias(c) for c in ("q1", "q2", "bytes", "total")]  # all members have the same
    nodes = staged(met.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max("length").alias("deepest"), *same), "nodes")
    owners = nodes.groupBy("owner").agg(F.min(F.struct("depth", "q1", "q2", (F.col("total") - F.col("bytes")).alias("before"))).alias("top"), F.bool_or(F.col("deepest") == F.col("depth")).alias("leaf"))
    # Above the first node that a conversation owns lies one of another conversation.
    parents = nodes.select((F.col("depth") + 1).alias("first"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("above"))
    owners = owners.select(F.col("owner").alias("conv_id"), F.col("top.depth").alias("first"), "top.q1", "top.q2", "top.before", "leaf").join(parents, ["first", "q1", "q2"], "left").drop("q1", "q2")
    marked = met.drop("q1", "q2").join(owners, "conv_id", "left").withColumns({"first": F.coalesce("first", F.col("length") + 1), "before": F.coalesce("before", "whole")})
    below = F.col("depth") + 1
    sums = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(F.when(F.col("depth") > F.col("first"), F.col("conv_id")).when(F.col("depth") == F.col("first"), F.col("above"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.count_if(below.between(F.col("first"), F.col("length"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("first"), F.col("before") - F.col("total") + F.col("bytes")).otherwise(0)).alias("saved_tokens"),
    )
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return sums.join(ends(met), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
