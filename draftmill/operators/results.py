"""The results table: upsert, corrections, crops, order, rank, summary, progress and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmill.functions import columns as C
from draftmill.functions.shared import written
from draftmill.functions.tables import CSV_FIELDS, RESULT

ORDER = ("pdf_id", "page_index", "cheque_on_page")
PATCHED = ("amount", "currency", "date", "payer", "bank", "cheque_number")


def keep_last(df: DataFrame, key: str, *seq: str) -> DataFrame:
    """Keyed upsert: one row per key, the last arrival. max_by aggregates before the shuffle, so a key of very many arrivals is no matter."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("r")).select(key, "r.*")


def upsert(table: DataFrame, arrivals: DataFrame, key: str, *seq: str) -> DataFrame:
    """table with the last of the arrivals of each key in place of its row."""
    last = keep_last(arrivals, key, *seq).select(*table.columns)
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def apply_corrections(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """The latest correction of an id overwrites the patched fields, also with blanks; the row is reviewed, ok and without flags. Confidence,
    reconciliation and model stay; corrections of unknown ids are ignored."""
    last = keep_last(corrections, "id", "seq").select(F.col("id").alias("c_id"), *[F.col(c).alias(f"c_{c}") for c in PATCHED])
    both = results.join(last, F.col("id") == F.col("c_id"), "left")
    hit = F.col("c_id").isNotNull()
    new = {c: F.when(hit, F.col(f"c_{c}")).otherwise(F.col(c)) for c in PATCHED}
    new |= {"reviewed": F.col("reviewed") | hit, "status": F.when(hit, "ok").otherwise(F.col("status")), "flags": F.when(hit, F.slice("flags", 1, 0)).otherwise(F.col("flags"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in results.columns])


def attach_crops(results: DataFrame, crops: DataFrame) -> DataFrame:
    """The row's own crop, else the stored one, else null."""
    stored = crops.select(F.col("id").alias("s_id"), F.col("crop").alias("s_crop"))
    both = results.join(stored, F.col("id") == F.col("s_id"), "left")
    return both.withColumn("crop", F.coalesce("crop_ref", "s_crop")).drop("s_id", "s_crop")



def _order(collation: str | None) -> list[Column]:
    return [F.collate("pdf_id", collation) if collation else F.col("pdf_id"), *map(F.col, ORDER[1:])]


def order_results(results: DataFrame, collation: str | None = None) -> DataFrame:
    """In the order of display. Files come by the bytes of their names or, with a collation such as 'UNICODE', as a reader expects: letters before their
    accents, accents before upper case."""
    return results.orderBy(*_order(collation))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their number in the order, from 1, as column `name`. Rows are dealt by sampled ranges of the order and sorted within their range; what
    is summed up in order is one count for each range. So it is no matter how many rows share the first of the order's columns; only rows that are
    alike in all of them meet. They are written out, so that which row is in which range is settled."""
    at = F.monotonically_increasing_id()  # the range, and from the 33rd bit down the place within it
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    place, part = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))  # as many as there are ranges
    return ranged.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + place + 1).drop("_at", "_part", "_start")


def display_rank(results: DataFrame, collation: str | None = None) -> DataFrame:
    """results with `rank`, 1-based in the global order. A file of very many rows is ranked by many tasks."""
    return numbered(results, "rank", *_order(collation))


def summary(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("total"), n("ok").alias("ok"), n("review").alias("review"), n("error").alias("error"), F.coalesce(C.half_up(F.avg("confidence")), F.lit(0)).cast("long").alias("avg_confidence"))


def progress(pages: DataFrame, results: DataFrame, by: str = "pdf_id") -> DataFrame:
    """Per file: pages done, pages, cheques found, percent done."""
    p = pages.groupBy(by).agg(F.count_if("done").alias("pages_done"), F.count("*").alias("total_pages"))
    r = results.groupBy(by).agg(F.count("*").alias("n"))
    both = p.join(r, by, "left")
    percent = F.when(F.col("total_pages") > 0, C.half_up(100 * F.col("pages_done") / F.col("total_pages"))).otherwise(0)
    return both.select(by, "pages_done", "total_pages", F.coalesce("n", F.lit(0)).alias("cheques_found"), percent.cast("long").alias("percent"))


def csv_lines(results: DataFrame) -> DataFrame:
    """results with `line`, its line of the export."""
    return results.withColumn("line", F.concat_ws(",", *[C.csv_cell(F.col(c)) for _, c in CSV_FIELDS], C.csv_cell(C.flags_text(F.col("flags")))))


def export_csv(results: DataFrame, path: str, parts: int | None = None) -> None:
    """Part files by range of the global order, `parts` of them if it is given; the first begins with the byte-order mark and the header."""
    header = results.sparkSession.range(1).select(F.lit("\ufeff" + ",".join([n for n, _ in CSV_FIELDS] + ["flags"])).alias("line"), F.lit(0).alias("kind"), F.lit("").alias("pdf_id"), F.lit(0).alias("page_index"), F.lit(0).alias("cheque_on_page"))
    lines = header.unionByName(csv_lines(results).select("line", F.lit(1).alias("kind"), *ORDER))
    dealt = lines.repartitionByRange(parts, "kind", *ORDER) if parts else lines.repartitionByRange("kind", *ORDER)
    dealt.sortWithinPartitions("kind", *ORDER).select("line").write.mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(n, part, line): the lines of an export in the order of its part files, numbered from 1. Files may be read in splits and in any order: a line's
    place is its file, the start of its split, and its place within that. Spark's reader takes the byte-order mark off; a cell with line ends has as many
    lines."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("part"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_row"))
    return numbered(lines, "n", F.col("part"), F.col("_from"), F.col("_row")).select("n", "part", "line")


def save_results(results: DataFrame, path: str) -> None:
    """A fresh run replaces what is there; crops are not kept."""
    results.drop("crop", "crop_ref").write.mode("overwrite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """The saved results, or none where nothing is saved."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return spark.createDataFrame([], RESULT)
    return spark.read.parquet(path)


def field_reasons(results: DataFrame) -> DataFrame:
    """(id, field, reason): one row for each field with a flag, the last flag's reason."""
    return results.select("id", F.explode(C.field_flags(F.col("flags"))).alias("field", "reason"))
