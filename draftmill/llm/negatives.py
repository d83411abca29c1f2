"""Hard negatives by bit-sliced integer products.

Vectors are whole numbers (component x counts as floor(256 x)). A score is the inner product of an anchor and a row, worked out from the row's
bit planes, the most significant first: in two's complement a row is -2^(b-1) plane[b-1] + 2^(b-2) plane[b-2] + ... + plane[0], and a
product with a plane of zeros and ones is a sum of the anchor's components. With the planes below t still to come, the score lies in

    [partial + (2^t - 1) negative, partial + (2^t - 1) positive]

where `negative` and `positive` are the sums of the anchor's components of either sign. Each plane halves that interval. A row is dropped for an anchor
as soon as its interval can't qualify: it misses the wanted range of scores, or lies below the k-th best score that others are certain to reach. The planes
still to come are worked out for the rows that are left alone; scores of those that last to the end are exact.

Two searches use it: an anchor's positives (same label, the best scores), and for each positive its negatives (other labels, the best scores within a range
that follows from the positive's score).

Anchors, a hundredth of the rows, are packed in blocks of some BLOCK and rows in slabs of SLAB at most; each slab meets each block once
(a stated set of queries against all rows, in blocks). Blocks and slabs are dealt to tasks by a key of both, so no task's share depends on labels or on
copies, and nothing is broadcast but what Spark finds small. A task holds one block, one slab and the best rows so far, and hands on at most k rows for each
query; ranks are cut before and after the shuffle.

Defined results: rows without id, label or vector, or with a component that is null or not finite take no part; of rows that share an id one counts, with
the smallest label, then the smallest vector; vectors of different lengths are compared as if the shorter went on with zeros; equal scores come by
smaller id; an anchor with no other row of its label has no positives; no rows in, no rows out. Scores are exact; where one might not fit into 62 bits an error
is raised. Only vec_id, embedding and label are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, to_arrow

#: Anchors of a block, about; of the part of it that is worked on at a time; rows of a slab, at most; slabs of a cell, about; tasks of a search, at most.
BLOCK, PART, SLAB, SLABS, CELLS = 4096, 128, 2048, 4, 100_000
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
_LOW = -(2**62)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, one for each id; v: whole numbers."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.filter("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), numbers.alias("x"))
    rows = rows.filter(F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    # Beyond 2^52 a product might not fit; the kernel raises an error there.
    v = F.transform("x", lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-(2.0**52))), F.lit(2.0**52))))
    return rows.select("vec_id", "label", v.alias("v")).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _packed(rows: DataFrame, key: str, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, vec_id, label, v, extra longs) as records (key, n, fields, v) of `size` rows of one key at most, in the order in which they come."""
    kind = f"{key} long, n int, fields binary, v binary"
    arrow = to_arrow(rows.sparkSession, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist() if len(own) else []
            for first, end in zip(starts, [*starts[1:], len(own)], strict=True):
                for at in range(first, end, size):
                    part = batch.slice(at, min(size, end - at))
                    n = part.column(3).value_lengths().to_numpy(zero_copy_only=False)
                    wide = np.zeros((part.num_rows, int(n.max())), np.int64)
                    wide[np.arange(wide.shape[1]) < n[:, None]] = part.column(3).flatten().to_numpy(zero_copy_only=False)
                    if np.abs(wide).max(initial=0) < 2**31:
                        wide = wide.astype(np.int32)
                    fields = np.stack([part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, *range(4, 4 + len(extra)))])
                    out = [[int(own[at])], [part.num_rows], [fields.tobytes()], [bytes([wide.itemsize]) + wide.tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return rows.select(key, "vec_id", "label", "v", *extra).mapInArrow(run, kind)


def _unpacked(n: int, fields: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fields, np.int64).reshape(-1, n), np.frombuffer(v, np.int32 if v[0] == 4 else np.int64, offset=1).reshape(n, -1)


def planes(v: np.ndarray) -> list[np.ndarray]:
    """The bit planes of v in two's complement, the lowest first."""
    bits = int(np.abs(v).max(initial=0)).bit_length() + 1
    return [(v >> t & 1).astype(np.float32) for t in range(bits)]


def qualifying(a: np.ndarray, v: list[np.ndarray], wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) and their scores that may be among the k best of one of the anchor's ranges. a: anchors x components, v: planes of rows x components,
    wanted: anchors x rows; lo, hi: anchors x ranges, inclusive (lo over hi: none); floor: a score that k others of the range are known to reach."""
    bits, rows, d = len(v), wanted.shape[1], min(a.shape[1], v[0].shape[1])
    a, v = a[:, :d].astype(np.int64), [plane[:, :d] for plane in v]
    sums = int(np.abs(a).sum(axis=1).max(initial=0))
    if sums * 2**bits >= -_LOW:
        raise ValueError("inner products of these vectors don't fit into 62 bits")
    exact = lambda n: np.float32 if n < 2**24 else np.float64  # noqa: E731  holds whole numbers below n
    factors, kind = a.astype(exact(sums)), np.int64 if sums * 2**bits >= 2**53 else exact(sums * 2**bits)
    up, down = np.maximum(a, 0).sum(axis=1).astype(kind), np.minimum(a, 0).sum(axis=1).astype(kind)
    weight = lambda t: kind(-(2**t) if t == bits - 1 else 2**t)
    floor, highest = np.maximum(floor, lo), hi.max(axis=1)
    alive, partial, t = wanted & (lo <= hi).any(axis=1)[:, None], np.zeros(wanted.shape, kind), bits
    few = lambda: np.count_nonzero(alive) * 8 <= alive.size  # noqa: E731  then pairs one by one cost less than all of them
    while t and not few():
        t -= 1
        partial += (factors @ v[t].T).astype(kind, copy=False) * weight(t)
        rest = kind(2**t - 1)
        # low <= x where partial <= x - rest * down, and so on: the bounds move, not the matrix.
        alive &= (partial >= (floor.min(axis=1) - rest * up)[:, None]) & (partial <= (highest - rest * down)[:, None])
        for j in range(lo.shape[1]):
            narrow = np.flatnonzero(rest * (up - down) <= hi[:, j] - lo[:, j]) if t and rows >= k and not few() else []
            if len(narrow):  # the k-th best of those that are sure to lie within the range
                own = partial[narrow]
                sure = alive[narrow] & (own >= (lo[narrow, j] - rest * down[narrow])[:, None]) & (own <= (hi[narrow, j] - rest * up[narrow])[:, None])
                kth = np.partition(np.where(sure, own, kind(_LOW)), rows - k, axis=1)[:, rows - k] + rest * down[narrow]
                floor[narrow, j] = np.maximum(floor[narrow, j], kth.astype(np.int64))
    q, r = np.nonzero(alive)
    score = partial[q, r]
    while t and len(q):
        t -= 1
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            score[part] += np.einsum("ij,ij->i", factors[q[part]], v[t][r[part]]).astype(kind, copy=False) * weight(t)
        low, high = score + kind(2**t - 1) * down[q], score + kind(2**t - 1) * up[q]
        narrow = t and len(q) and (high - low).mean() < np.ptp(score)  # before that, intervals say little
        for j in range(lo.shape[1]) if narrow else ():
            sure = np.flatnonzero((low >= floor[q, j]) & (high <= hi[q, j]))
            at, kth, _ = best(q[sure], low[sure], r[sure], k)
            full = np.bincount(at, minlength=len(a)) == k
            floor[full, j] = kth[np.cumsum(np.bincount(at, minlength=len(a)))[full] - 1].astype(np.int64)
        stay = (high >= floor.min(axis=1)[q]) & (low <= highest[q])
        q, r, score = q[stay], r[stay], score[stay]
    return q, r, score.astype(np.int64)


def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each q the k highest scores, ties by smaller id."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) < k
    return q[keep], score[keep], ids[keep]


def _search(blocks: DataFrame, slabs: DataFrame, n_blocks: int, n_slabs: int, per: int, k: int, ranges, same: bool) -> DataFrame:
    """(anchor_id, slot, other_id, score): of each cell, a block and some slabs, the k best rows for each range of each anchor. ranges(fields) gives the
    ranges of the anchors of a block (lo, hi)."""
    slices = -(-n_slabs // per)
    kind = "anchor_id long, slot int, other_id long, score long"
    arrow = to_arrow(slabs.sparkSession, kind)

    def results(state) -> Iterator[pa.RecordBatch]:
        for j, (q, score, ids) in enumerate(state["best"]):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((state["fields"][0][q], np.full(len(q), j), ids, score), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[dict] = []
        cell = None
        for batch in batches:
            for i in range(batch.num_rows):
                block, slice_, slab, n, raw, v = (batch.column(c)[i].as_py() for c in ("block", "slice", "slab", "n", "fields", "v"))
                fields, v = _unpacked(n, raw, v)
                if cell != (block, slice_):
                    for state in states:
                        yield from results(state)
                    states, cell = [], (block, slice_)
                if slab < 0:  # anchors: a cell's first records
                    for at in range(0, n, PART):
                        own = fields[:, at : at + PART]
                        lo, hi = ranges(own)
                        none = np.zeros(0, np.int64)
                        states.append({"fields": own, "a": v[at : at + PART], "lo": lo, "hi": hi, "best": [(none, none, none)] * lo.shape[1], "floor": np.full(lo.shape, _LOW)})
                    continue
                v = planes(v)
                for state in states:
                    own, lo, hi = state["fields"], state["lo"], state["hi"]
                    alike = own[1][:, None] == fields[1]
                    wanted = alike & (own[0][:, None] != fields[0]) if same else ~alike
                    q, r, score = qualifying(state["a"], v, wanted, lo, hi, state["floor"], k)
                    for j, (bq, bs, bi) in enumerate(state["best"]):
                        fits = (score >= np.maximum(lo[q, j], state["floor"][q, j])) & (score <= hi[q, j])
                        state["best"][j] = bq, bs, bi = best(np.r_[bq, q[fits]], np.r_[bs, score[fits]], np.r_[bi, fields[0][r[fits]]], k)
                        full, last = np.bincount(bq, minlength=len(lo)), np.cumsum(np.bincount(bq, minlength=len(lo))) - 1
                        state["floor"][full == k, j] = bs[last[full == k]]
        for state in states:
            yield from results(state)

    dealt = slabs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), (F.col("slab") % slices).alias("slice"), "slab", "n", "fields", "v")
    heads = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(-1).cast("long").alias("slab"), "n", "fields", "v")
    cells = heads.unionByName(dealt).repartition(min(n_blocks * slices, CELLS), "block", "slice").sortWithinPartitions("block", "slice", "slab")
    return cells.select("block", "slice", "slab", "n", "fields", "v").mapInArrow(run, kind)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """found with `rank` among the rows of the same keys, from 1 to k."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, block: int = BLOCK, slab: int = SLAB, per: int = SLABS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for every anchor (vec_id divisible by `every`) and each of its best
    `positives` rows of the same label, the first `negatives` rows of other labels with a score between LEAST and MOST hundredths of the positive's."""
    spark = embeddings.sparkSession
    rows = staged(whole_vectors(embeddings), "vectors")
    slabs = staged(_packed(rows.withColumn("key", F.lit(0).cast("long")), "key", slab), "slabs")
    # Numbered in the order of the partitions; one count for each.
    slabs = staged(slabs.select("n", "fields", "v", F.monotonically_increasing_id().alias("at")), "slabs")
    n_slabs, anchors = slabs.count(), rows.filter(F.col("vec_id") % every == 0)
    n_blocks = -(-anchors.count() // block)
    if not n_blocks:
        return spark.createDataFrame([], RESULT)
    slabs = slabs.withColumn("slab", F.pmod(F.xxhash64("at"), F.lit(2**40)))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("long"))
    together = lambda df: df.repartition("block").sortWithinPartitions("block", "vec_id")
    everything = lambda fields: (np.full((fields.shape[1], 1), _LOW), np.full((fields.shape[1], 1), -_LOW))
    near = _search(_packed(together(anchors), "block", 2 * block), slabs, n_blocks, n_slabs, per, positives, everything, True)
    near = staged(_ranked(near, ["anchor_id"], positives).select("anchor_id", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    slots = [f"s{j}" for j in range(positives)]
    scores = near.groupBy("anchor_id").agg(*[F.max(F.when(F.col("slot") == j + 1, F.col("positive_score"))).alias(s) for j, s in enumerate(slots)])
    queries = anchors.join(scores.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumns({s: F.coalesce(s, F.lit(_LOW)) for s in slots})

    def within(fields: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = fields[2:].T
        hundreds, rest = np.divmod(score, 100)
        none = score == _LOW
        return np.where(none, 1, LEAST * hundreds - (-LEAST * rest) // 100), np.where(none, 0, MOST * hundreds + MOST * rest // 100)

    far = _search(_packed(together(queries), "block", 2 * block, tuple(slots)), slabs, n_blocks, n_slabs, per, negatives, within, False)
    far = _ranked(far, ["anchor_id", "slot"], negatives).withColumn("slot", F.col("slot") + 1)
    return far.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
