"""Exact dedup: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle.

Pass one adds every hash to a Bloom filter that counts to two: `cells` cells, three per hash; merged over all tasks it
keeps the cells that were hit twice or more. Pass two keeps a row for the shuffle only if all of its cells are among those.
A text without a copy is taken for a repeated one now and then (about 1 in 200), never the other way round, and the
groups among the rows that shuffle are formed by SHA-256, so the result is exact whatever the size of the filter.

The filter has 16 cells a row, up to MAX_CELLS; so what is collected and broadcast at a time is MAX_CELLS / 8 bytes (64 MB) at most. Beyond some 30
million rows there is a filter for each range of another hash: the keys are written dealt by range (no shuffle) and each range is filtered by
itself, one after the other, so the share of rows that are taken for repeated ones stays the same at every size.

Defined results: null text counts as empty, empty texts are copies of one another, a null doc_id comes after all others,
and of rows that agree in doc_id and text one stays. No rows in, no rows out. Other columns play no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions.shared import new_path

from .common import WHITE, staged, text_of

MIN_CELLS, MAX_CELLS, PER_ROW, HASHES, SEGMENT = 1 << 16, 1 << 29, 16, 3, 1 << 16
SMALL = 1 << 19  # hashes of a set that is broadcast as it is


def normal_sha(text: Column) -> Column:
    return F.sha2(F.translate(text, WHITE, "").cast("binary"), 256)


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """HASHES cells of each hash, as rows."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) & np.uint64(cells - 1)).astype(np.int64) for i in range(HASHES)])


def hit_cells(keys: DataFrame, hash_col: str = "h", times: int = 2, rows: int | None = None) -> np.ndarray:
    """The Bloom filter's cells that `times` (1 or 2) or more rows of `keys` hit, as a bitmap of one byte for eight cells. rows: their number, if it is known."""
    cells = MIN_CELLS
    while cells < min(MAX_CELLS, PER_ROW * (keys.count() if rows is None else rows)):
        cells *= 2

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def flush() -> pd.DataFrame:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.flatnonzero(np.diff(at // SEGMENT)) + 1
            parts = list(zip(np.split(at, cut), np.split(n, cut), strict=True))
            return pd.DataFrame({"segment": [int(a[0] // SEGMENT) for a, _ in parts], "once": [(a % SEGMENT).astype("<u2").tobytes() for a, _ in parts], "again": [(a[k > 1] % SEGMENT).astype("<u2").tobytes() for a, k in parts]})

        for batch in batches:
            # The cells of one hash can coincide; each counts once for it.
            c = np.sort(_cells(batch[hash_col].to_numpy(), cells), axis=0)
            held.append(np.concatenate([c[0], *(c[i][c[i] != c[i - 1]] for i in range(1, HASHES))]))
            rows += len(batch)
            if rows >= 250_000:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(SEGMENT, np.uint8)
        for once, again in zip(group["once"], group["again"], strict=True):
            for part in (once, again):
                at = np.frombuffer(part, "<u2")
                count[at] = np.minimum(count[at] + 1, 2)
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "twice": [np.packbits(count >= times).tobytes()]})

    merged = keys.select(hash_col).mapInPandas(hits, "segment long, once binary, again binary").groupBy("segment").applyInPandas(merge, "segment long, twice binary")
    twice = np.zeros(cells // 8, np.uint8)
    for segment, part in merged.collect():  # MAX_CELLS bits at most
        twice[segment * SEGMENT // 8 : (segment + 1) * SEGMENT // 8] = np.frombuffer(part, np.uint8)
    return twice


def possibly_in(df: DataFrame, twice: np.ndarray, hash_col: str) -> Column:
    """A column of df: true where all cells of the hash are in the bitmap."""
    shared = df.sparkSession.sparkContext.broadcast(twice)
    cells = len(twice) * 8

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        at = _cells(h.to_numpy(), cells)
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return test(F.col(hash_col))


def marked(keys: DataFrame, hash_col: str = "h") -> DataFrame:
    """keys with `maybe`: false for rows whose hash surely comes once."""
    spark, rows = keys.sparkSession, keys.count()
    ranges = -(-PER_ROW * rows // MAX_CELLS)
    if ranges <= 1:
        return keys.withColumn("maybe", possibly_in(keys, hit_cells(keys, hash_col, rows=rows), hash_col))
    dealt, out = new_path(spark, "exact-ranges"), new_path(spark, "exact-marked")
    keys.withColumn("__range", F.pmod(F.xxhash64(F.lit(1), hash_col), F.lit(ranges)).cast("int")).write.partitionBy("__range").parquet(dealt)
    for r in range(ranges):
        part = spark.read.parquet(dealt).filter(F.col("__range") == r).drop("__range")  # reads the range's folder alone
        part.withColumn("maybe", possibly_in(part, hit_cells(part, hash_col, rows=-(-rows // ranges)), hash_col)).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def in_set(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows of df whose `col` (a hash) is in `keys` (a table with that column), and perhaps a few more. A set of SMALL hashes at most is broadcast; a
    larger one goes as a Bloom filter, whose size is bounded."""
    if keys.limit(SMALL + 1).count() <= SMALL:
        return df.join(F.broadcast(keys.select(col).distinct()), col, "left_semi")
    return df.filter(possibly_in(df, hit_cells(keys, col, times=1), col))


def _groups(dup: DataFrame) -> DataFrame:
    """One row a text: how often it occurs and which row stays. Counts are summed before the shuffle, so a text that fills a
    third of the table sends one row from each task."""
    best = F.min(F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d")))
    return dup.groupBy("sha").agg(F.count("*").alias("size"), best.alias("best")).filter("size > 1")


def _staged_groups(dup: DataFrame) -> DataFrame:
    """Written out, so that the join with them has an exchange of its own on either side, and one hot text can be split."""
    return staged(_groups(dup), "exact-groups")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    text = text_of()
    keys = staged(docs.select("doc_id", normal_sha(text).alias("sha"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row")).withColumn("h", F.xxhash64("sha")), "exact-keys")
    flagged = marked(keys)
    dup, single = flagged.filter("maybe"), flagged.filter("not maybe")
    groups = _staged_groups(dup)
    found = dup.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.c")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best.d") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(found)


def text_hash(text: str) -> int:
    """What Spark's xxhash64 gives for the text, as a signed number."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs as `doc`, with id, th (the hash of the text) and k (the hash of both)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(whole, F.col("doc_id").alias("id"), F.xxhash64(text_of()).alias("th")).withColumn("k", F.xxhash64("id", "th"))


def drop_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, but for those that `gone` (id, th, all) names by doc_id and hash of the text; where `all` is
    false one of several equal rows stays. Few names are broadcast; of many a Bloom filter lets nearly all other rows pass without a shuffle."""
    full = _keyed(docs)
    named = gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"), "all", F.xxhash64("id", "th").alias("k"))
    same = (F.col("k") == F.col("gone_k")) & F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th"))
    sent = named.withColumnRenamed("k", "gone_k")
    if named.limit(SMALL + 1).count() <= SMALL:
        straight, both = None, full.join(F.broadcast(sent), same, "left")
    else:
        flagged = full.withColumn("maybe", possibly_in(full, hit_cells(named, "k", times=1), "k"))
        straight, both = flagged.filter("not maybe").select("doc.*"), flagged.filter("maybe").drop("maybe").join(sent, same, "left")
    stay = both.filter("all is null").select("doc.*")
    stay = stay if straight is None else straight.unionByName(stay)
    if not named.filter("not all").limit(1).count():
        return stay
    return stay.unionByName(both.filter("not all").groupBy("k", "id").agg(F.first("doc").alias("doc")).select("doc.*"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Only texts that are possibly repeated get a SHA-256; texts are shuffled only
    where the row goes."""
    text = text_of()
    keys = staged(docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("th"), F.xxhash64(F.translate(text, WHITE, "")).alias("h")), "exact-keys")
    again = staged(marked(keys).filter("maybe").select(F.xxhash64("id", "th").alias("k")), "exact-again")
    full = _keyed(docs)
    some = in_set(full, again, "k").select("id", "th", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    dup = staged(some.select(F.col("id").alias("doc_id"), "th", normal_sha(F.col("text")).alias("sha"), F.length("text").cast("long").alias("n_chars"), F.lit(0).alias("row")), "exact-copies")
    groups = _staged_groups(dup).select("sha", F.col("best.a").alias("a"), F.col("best.c").alias("c"))
    inside = dup.join(groups, "sha")
    stays = (F.col("a") == -F.col("n_chars")) & F.col("c").eqNullSafe(F.col("doc_id"))
    # Rows that stay are named only where several are equal in doc_id and text.
    gone = inside.groupBy(F.col("doc_id").alias("id"), "th").agg(F.first(~stays).alias("all"), F.count("*").alias("n")).filter("all or n > 1").drop("n")
    return drop_rows(docs, staged(gone, "exact-gone"))
