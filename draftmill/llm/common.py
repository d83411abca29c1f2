"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions.shared import written as staged  # noqa: F401

#: ASCII white space, `[\x20\x09-\x0D]` in the contracts.
WHITE = " \t\n\x0b\x0c\r"
#: Rows of one slice while Python works through an Arrow batch; bounds the memory of long texts.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty); all other columns, whatever their names, are left behind."""
    return docs.select("doc_id", text_of().alias("text"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


def map_texts(docs: DataFrame, per_task: Callable[[], Callable[[list, list], dict]], schema: str) -> DataFrame:
    """mapInArrow over (doc_id, text), a slice of rows at a time. per_task() runs once in each task and returns the function
    that turns lists of ids and texts into columns; `schema` names the columns after doc_id, which keeps its own type."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = f"doc_id {kind}, {schema}"
    arrow = to_arrow(docs.sparkSession, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = per_task()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = part.column(0)
                out = work(ids.to_pylist(), part.column(1).to_pylist())
                if out is None:
                    continue
                columns = [out.get("doc_id", ids)] + [out[f.name] for f in list(arrow)[1:]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, full)


def to_arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """The rows of (word, c) with the highest counts, head of them at most; those that tie at the border stay out. The border comes from
    a histogram of counts (exact below 65,536, finer than a thousandth beyond), so no task sends more rows than are kept."""
    exact = 1 << 16
    level = F.when(F.col("c") < exact, F.col("c")).otherwise(exact + F.floor(F.log2("c") * 1024)).cast("long")
    total, border = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r.n
        if total > head:
            break
        border = r.level
    return counts.select("word", "c").filter(level >= border if border is not None else F.lit(False))
