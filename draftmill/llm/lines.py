"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a document are hashed (to 128 bits). A window that occurs more than once in the table keeps
its first place, by doc_id and then line; the lines that its later places cover, merged, are taken out of their documents. So a lone line that many
documents share stays, and a passage of three lines or more goes from all documents but the first, to its last line.

Counts and first places are partial aggregates, so a window that fills a third of the table sends one row from each task. Only
hashes and positions are shuffled for the search. For taking lines out, texts with repeated windows are shuffled once; a Bloom filter of
their hashes (of bounded size, as for exact dedup) lets nearly all others pass straight through.

Defined results: null text counts as empty. Lines are cut at line feeds and compared as they are, but for lines of white
space, which are all alike; windows of three such lines don't count. A document of under three lines is left as it is. A null
doc_id comes after all others. Rows equal in doc_id and text are one document: they get the same result. Only doc_id and
text are read, whatever other columns there are; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions.columns import let

from .common import WHITE, id_and_text, staged
from .exact import hit_cells, possibly_in


def _hashes(line: Column) -> Column:
    blank = F.translate(line, WHITE, "") == ""
    zero = F.lit(0).cast("long")
    return F.struct(F.when(blank, zero).otherwise(F.xxhash64(line)).alias("a"), F.when(blank, zero).otherwise(F.xxhash64(line, F.lit(1))).alias("b"))


def _windows(lines: Column) -> Column:
    def of(h: Column) -> Column:
        def window(i: Column) -> Column:
            x, y, z = h[i], h[i + 1], h[i + 2]
            some = (x["a"] != 0) | (y["a"] != 0) | (z["a"] != 0)
            return F.when(some, F.struct(i.alias("at"), F.xxhash64(x["a"], y["a"], z["a"]).alias("k1"), F.xxhash64(x["b"], y["b"], z["b"]).alias("k2")))

        return F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3), window))

    return let(F.transform(lines, _hashes), of)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, starts): for each document with later places of a repeated window, the lines on which they start."""
    lines = F.split("text", "\n", -1)
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), F.explode(_windows(lines)).alias("w")).filter("w is not null")
    windows = staged(found.select("doc_id", "h", "w.*"), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("h").alias("c"), F.col("at").alias("d"))
    # Written out, so that the join has an exchange of its own on either side and adaptive execution can split a hot window.
    first = staged(windows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "first-places")
    later = windows.join(first, ["k1", "k2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "h").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text without the lines taken out, n_lines before, n_removed."""
    docs = id_and_text(docs)
    cuts = staged(repeated_windows(docs), "line-cuts")
    d = docs.withColumn("h", F.xxhash64("text"))
    d = d.withColumn("maybe", possibly_in(d, hit_cells(cuts, times=1), "h"))
    cut = cuts.select(F.col("doc_id").alias("id"), F.col("h").alias("cut_h"), "starts")
    both = d.filter("maybe").join(cut, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("cut_h")), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(p, p + 1, p + 2))))
    lines = F.split("text", "\n", -1)
    left = let(lines, lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), covered), lambda i: all_[i]), "\n"))
    whole = F.col("starts").isNull()
    n_lines = F.size(lines).cast("long").alias("n_lines")
    changed = both.select("doc_id", F.when(whole, F.col("text")).otherwise(left).alias("text"), n_lines, F.when(whole, 0).otherwise(F.size(covered)).cast("long").alias("n_removed"))
    straight = d.filter("not maybe").select("doc_id", "text", n_lines, F.lit(0).cast("long").alias("n_removed"))
    return straight.unionByName(changed)
