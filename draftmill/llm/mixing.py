"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

The documents of a source, in the order of a hash, form blocks of `block` documents; a block takes one slot of the mix. Weights are
brought to quotas q that sum to the period Q. Block i of a source with quota q is released at floor(i Q / q) and due at
ceil((i + 1) Q / q); in every slot the released block with the earliest deadline goes first. On one slot line with full use this meets every
deadline, so after any t slots a source has had t q / Q blocks, give or take less than one.

The schedule repeats after Q slots, so the driver works out one period, from the weights alone, and a block's slot is arithmetic:
no document waits for another. When a source has no blocks left, the others go on by their weights among themselves, as a next phase with a
period of its own; in the last period of a phase an ended source leaves slots empty. While more than SINGLY sources go on, a phase lasts until a quarter of
them have ended (or SINGLY are left), those that end leaving their slots empty; so there are SINGLY phases and some more, and the promise holds for every
source, of however many, as long as it lasts. What the driver holds is one count for each source and the schedule, some twenty numbers for each
source (a million for SINGLY); it is broadcast up to BROADCAST numbers and joined by source beyond that. More than MOST sources are refused with an error.

All documents are kept, each once. The rank of a document in its source is found in two levels, so that a source that holds a third
of the table is ranked by many tasks: within buckets of keys, then by the buckets' counts. Only keys are shuffled for it. To put texts in
order they are shuffled once: a table of the first key of each part of the mix tells a text its part, before any rank is known.

Defined results: a null source is the source ''. Null ids and repeated rows are ranked like others (of rows equal in doc_id and
text either comes first). Sources without a given weight get the weight 0 and come last, in a phase of their own. No rows in, no
rows out. Columns of any other name pass through `mix_rows` and are ignored by `mix`.
"""

from __future__ import annotations

import heapq
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, text_of

BLOCK, PERIOD = 16, 1000
SPAN = 64  # slots of a span
SINGLY, MOST = 512, 1 << 22  # sources, at most, while each that ends begins a phase; sources at all
BUCKET_BITS, PER_BUCKET = 8, 50_000  # least number of buckets of a source; rows of one, beyond that
PARTS, PER_PART = 64, 1 << 15  # least number of parts; rows of one, beyond that
BROADCAST = 1 << 20  # rows, or numbers, at most of a table that is broadcast


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers in proportion to the weights (largest remainder), at least 1 each, that sum to the period."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    spare = period - sum(out.values())
    for i in range(max(0, spare)):
        out[by_rest[i % len(by_rest)]] += 1
    if spare < 0:  # the minimum of 1 took too much: the largest give way
        names = sorted(out, reverse=True)
        largest = [(-out[s], i) for i, s in enumerate(names)]
        heapq.heapify(largest)
        for _ in range(-spare):
            n, i = largest[0]
            out[names[i]] -= 1
            heapq.heapreplace(largest, (n + 1, i))
    return out


def one_period(quota: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks within a period, by earliest deadline first among the released."""
    period = sum(quota.values())
    waiting = [(0, s, 0) for s in sorted(quota)]  # release, source, block
    heapq.heapify(waiting)
    ready: list = []
    slots: dict[str, list[int]] = {s: [] for s in quota}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // quota[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots[s].append(t)
        if i + 1 < quota[s]:
            heapq.heappush(waiting, ((i + 1) * period // quota[s], s, i + 1))
    return slots


def plan(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> dict[str, list[dict]]:
    """For each source its phases: blocks `low` to below `high`, `quota` of them a period, at `slots` of a period of `size`; `start` is the
    phase's first slot."""
    left = {s: n for s, n in blocks.items() if n > 0}
    out: dict[str, list[dict]] = {s: [] for s in left}
    start = 0
    while left:
        active = {s: weights.get(s, 0.0) for s in left if weights.get(s, 0.0) > 0} or dict.fromkeys(left, 1.0)
        size = max(period, 4 * len(active))
        quota = quotas(active, size)
        slots = one_period(quota)
        ends = sorted(-(-left[s] // quota[s]) for s in active)
        periods = ends[max(1, len(ends) - max(SINGLY, len(ends) * 3 // 4)) - 1]  # when enough of them have ended
        for s in active:
            done = min(left[s], periods * quota[s])
            low = blocks[s] - left[s]
            out[s].append({"low": low, "high": low + done, "quota": quota[s], "slots": slots[s], "size": size, "start": start})
            left[s] -= done
        left = {s: n for s, n in left.items() if n}
        start += periods * size
    return out


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _bits(counts: dict[str, int]) -> int:
    """Of the number of buckets that the keys of a source are cut into."""
    return max(BUCKET_BITS, math.ceil(math.log2(max(1, max(counts.values(), default=0) / PER_BUCKET))))


def _keys(docs: DataFrame, counts: dict[str, int], bits: int, *more: Column) -> DataFrame:
    """doc_id, src, key (a hash that orders the documents of a source) and bucket (a range of keys)."""
    tie = text_of() if "text" in docs.columns else F.lit("")
    keyed = docs.select(*more, "doc_id", _source().alias("src"), F.xxhash64("doc_id", tie).alias("key"))
    return keyed.withColumn("bucket", (F.shiftright("key", 64 - bits) + (1 << bits - 1)).cast("int"))


def _counts(docs: DataFrame, weights: dict[str, float] | None) -> tuple[dict[str, int], dict[str, float]]:
    """Documents and weight of each source. Without weights a source weighs the square root of its number of documents."""
    each = docs.groupBy(_source().alias("src")).agg(F.count("*").alias("n")).limit(MOST + 1).toArrow()
    if each.num_rows > MOST:
        raise ValueError(f"more than {MOST} sources")
    counts = dict(zip(each.column("src").to_pylist(), each.column("n").to_pylist(), strict=True))
    return counts, {s: math.sqrt(n) for s, n in counts.items()} if weights is None else weights


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has few rows; otherwise a plain join with it."""
    return F.broadcast(df) if rows <= BROADCAST else df


def _ranked(keyed: DataFrame, buckets: int) -> DataFrame:
    """keyed with the rank of the row within its source: in two levels, within buckets of keys and by the buckets' counts."""
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    offsets = sums.select("src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last()))
    return keyed.withColumn("within", within).join(_small(offsets, buckets), ["src", "bucket"]).withColumn("rank", F.col("offset") + F.col("within") - 1).drop("within", "offset")


def _slotted(ranked: DataFrame, counts: dict[str, int], weights: dict[str, float], block: int, period: int) -> DataFrame:
    """ranked (src, rank, ...) with block and slot."""
    phases = plan({s: -(-n // block) for s, n in counts.items()}, weights, period)
    spark, kind = ranked.sparkSession, "array<struct<low: long, high: long, quota: long, slots: array<long>, size: long, start: long>>"
    if sum(p["quota"] for own in phases.values() for p in own) <= BROADCAST:
        rows = json.dumps([{"src": s, "phases": p} for s, p in sorted(phases.items())])
        table = F.broadcast(spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<src: string, phases: {kind}>>"))))
    else:
        names = sorted(phases)
        rows = pa.table({"src": pa.array(names, pa.string()), "phases": pa.array([json.dumps(phases[s]) for s in names], pa.string())})
        table = staged(spark.createDataFrame(rows), "mix-schedule").select("src", F.from_json("phases", kind).alias("phases"))
    both = ranked.withColumn("block", F.floor(F.col("rank") / block)).join(table, "src")
    phase = F.element_at(F.filter("phases", lambda p: (p["low"] <= F.col("block")) & (F.col("block") < p["high"])), 1)
    both = both.withColumn("p", phase).drop("phases").withColumn("j", F.col("block") - F.col("p.low"))
    turn = F.floor(F.col("j") / F.col("p.quota"))
    return both.withColumn("slot", F.col("p.start") + turn * F.col("p.size") + F.get("p.slots", (F.col("j") - turn * F.col("p.quota")).cast("int"))).drop("p", "j")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """Per row: doc_id, source ('' if null), block (of its source, from 0), slot (of the mix), place (within the block). The mix is the
    order by slot, place. Without weights each source weighs the square root of its number of documents."""
    counts, weights = _counts(docs, weights)
    bits = _bits(counts)
    found = _slotted(_ranked(_keys(docs, counts, bits, _source().alias("source")), len(counts) << bits), counts, weights, block, period)
    return found.select("doc_id", "source", F.col("block").cast("long").alias("block"), F.col("slot").cast("long").alias("slot"), (F.col("rank") - F.col("block") * block).cast("long").alias("place"))


def _dealt(docs: DataFrame, weights: dict[str, float] | None, block: int, period: int, span: int) -> DataFrame:
    """Whole rows of docs as `doc`, with slot and rank, sorted by them in partitions that are ranges of slots; a span of slots is never
    dealt over two. Texts are shuffled once: which part of the mix a row is in is read off its key, as ranks rise with keys."""
    counts, weights = _counts(docs, weights)
    bits, total = _bits(counts), sum(counts.values())
    slots = _slotted(_ranked(_keys(docs, counts, bits), len(counts) << bits), counts, weights, block, period)
    parts = max(PARTS, total // PER_PART)
    wide = span * max(1, -(-total // (span * block * parts)))  # slots of a part
    # Of each part the first key, and its rank, in every bucket of keys: at most sources x (buckets + parts) places.
    first = slots.groupBy("src", "bucket", F.floor(F.col("slot") / wide).alias("part")).agg(F.min(F.struct("key", "rank")).alias("at"))
    bounds = first.groupBy("src", "bucket").agg(F.sort_array(F.collect_list(F.struct(F.col("at.key").alias("key"), "part", F.col("at.rank").alias("low")))).alias("bounds"))
    bounds = _small(staged(bounds, "mix-bounds"), len(counts) * ((1 << bits) + parts))
    rows = _keys(docs, counts, bits, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).join(bounds, ["src", "bucket"])
    rows = rows.withColumn("of", F.element_at(F.filter("bounds", lambda b: b["key"] <= F.col("key")), -1)).select("doc", "doc_id", "src", "bucket", "key", F.col("of.part").alias("part"), F.col("of.low").alias("low"))
    dealt = rows.repartitionByRange("part")
    within = F.row_number().over(Window.partitionBy("part", "src", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last()))
    found = _slotted(dealt.withColumn("rank", F.col("low") + within - 1), counts, weights, block, period)
    return found.sortWithinPartitions("part", "slot", "rank")


def mix_rows(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs, all rows and columns, in the order of the mix: range-partitioned and sorted by slot and place."""
    return _dealt(docs, weights, block, period, 1).select("doc.*")


def mix_spans(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, span: int = SPAN) -> DataFrame:
    """doc_id, text and span of all rows, in the order of the mix. A span is `span` slots in a row; none is dealt over two partitions."""
    found = _dealt(docs.select("doc_id", "source", text_of().alias("text")), weights, block, period, span)
    return found.select("doc.doc_id", "doc.text", F.floor(F.col("slot") / span).alias("span"))
