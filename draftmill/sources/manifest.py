"""Files and pages to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECT_EDGE, CROP_EDGE, PREVIEW_EDGE = 1500, 1568, 1100


def pdf_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(pdf_id, source_file, size, modified_ms) of the PDF files below path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    d = files.select(name.alias("source_file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms")).filter(F.lower("source_file").endswith(".pdf"))
    return d.select(F.concat_ws(":", "source_file", "size", "modified_ms").alias("pdf_id"), "source_file", "size", "modified_ms")


def page_geometry(pages: DataFrame, long_edge: int) -> DataFrame:
    """pages (width, height, rotate) with rotation, out_width and out_height of their rendering: portrait pages are turned by a quarter, the
    longer edge is `long_edge`."""
    portrait = F.col("height") > 1.3 * F.col("width")
    rotation = F.when(portrait, F.pmod(F.col("rotate") + 90, F.lit(360))).otherwise(F.col("rotate"))
    d = pages.withColumn("rotation", rotation)
    turned = F.pmod(F.col("rotation"), F.lit(180)) == 90
    w, h = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    scale = F.lit(float(long_edge)) / F.greatest(w, h)
    return d.withColumns({"out_width": F.ceil(w * scale).cast("int"), "out_height": F.ceil(h * scale).cast("int")})
