"""Streams of reads, results and corrections. Sinks are tables by key (`store.KeyedTable`): a batch that is repeated changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from draftmill.functions import columns as C
from draftmill.functions.tables import RAW
from draftmill.operators.exemplars import KEEP, SALTS
from draftmill.operators.results import ORDER, order_results
from draftmill.operators.validate import with_error_rows
from draftmill.sources.responses import is_json
from draftmill.streaming.store import KeyedTable

READ = f"id string, pass int, model string, error string, {RAW}"
#: What a stream holds of a correction, and how it hands its newest ones on.
EXEMPLAR = "seq long, amount string, date string, currency string, cheque_number string"
SLOT = f"slot string, bank_key string, {EXEMPLAR}"


def raw_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Reads as they land in JSON, one object a line; `files`: how many new files a batch takes at most. A line that is no JSON object becomes a read
    with nothing but an error; blank lines are no reads."""
    source = spark.readStream
    lines = (source.option("maxFilesPerTrigger", files) if files else source).text(path).filter(F.trim("value") != "")
    good = F.coalesce(is_json(F.col("value")) & F.trim("value").startswith("{"), F.lit(False))
    d = lines.withColumn("r", F.from_json(F.when(good, F.col("value")), READ)).withColumn("good", good)
    return d.select("r.*", "good").withColumn("error", F.when(F.col("good"), F.col("error")).otherwise("Invalid JSON")).drop("good")


def stream_validate(reads: DataFrame) -> DataFrame:
    """Each read validated as it arrives; stateless."""
    return with_error_rows(reads)


def read_table(spark: SparkSession, path: str, key: str = "id", seq: tuple[str, ...] = ("seq",)) -> DataFrame | None:
    """An upserted table; results come in the order of display."""
    table = KeyedTable(spark, path, key, seq).read()
    return table if table is None or not set(ORDER) <= set(table.columns) else order_results(table)


def upsert_batch(batch: DataFrame, batch_id: int, path: str, key: str = "id", seq: tuple[str, ...] = ("seq",)) -> None:
    """One micro-batch into the table at path: the last result of a key wins, by `seq` or, without it, by arrival."""
    KeyedTable(batch.sparkSession, path, key, seq).put(batch, batch_id)


def stream_upsert(results: DataFrame, path: str, checkpoint: str, key: str = "id", seq: tuple[str, ...] = ("seq",), mode: str = "append"):
    """A writer that keeps the table at path up to date; start it by .start(). With mode 'update' and no `seq` it is the sink of a running
    aggregate: of each key the newest value counts."""
    return results.writeStream.foreachBatch(lambda b, i: upsert_batch(b, i, path, key, seq)).option("checkpointLocation", checkpoint).outputMode(mode)


def stream_progress(pages: DataFrame) -> DataFrame:
    """Running pages done and cheques found per file (update mode). pages: file, cheques, one row per finished page."""
    return pages.groupBy("file").agg(F.count("*").alias("pages_done"), F.sum("cheques").alias("cheques_found"))


class Newest(StatefulProcessor):
    """The newest `keep` corrections of a key that differ in amount and date, whatever the order in which they arrive."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", EXEMPLAR)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        items = list(self.held.get()) if self.held.exists() else []
        for frame in rows:
            fresh = frame[["seq", "amount", "date", "currency", "cheque_number"]]
            items += [tuple(None if pd.isna(x) else x for x in r) for r in fresh.itertuples(index=False, name=None)]
            items.sort(key=lambda x: (-x[0], x[1], x[2] is not None, x[2] or ""))
            seen: dict[tuple, tuple] = {}
            for x in items:
                if len(seen) < self.keep:
                    seen.setdefault((x[1], x[2]), x)
            items = list(seen.values())
        items = [(int(x[0]), *x[1:]) for x in items]
        self.held.put(items)
        bank, salt = key
        yield pd.DataFrame([(f"{salt}:{pos}:{bank}", bank, *x) for pos, x in enumerate(items)], columns=["slot", "bank_key", "seq", "amount", "date", "currency", "cheque_number"])

    def close(self) -> None:
        pass


def stream_exemplars(corrections: DataFrame, keep: int = KEEP, salts: int = SALTS) -> DataFrame:
    """The newest distinct corrections of each bank as they arrive (update mode), a row for each slot. A bank may hold most of the corrections: they are
    dealt by a hash of amount and date over `salts` keys, each with a state of `keep` entries of its own; `exemplars_of` merges them. A slot, once
    filled, is only overwritten, so a table by slot is the sink. Rows without seq are left out. The state is a list, which only the RocksDB state
    store holds: the session is set to it."""
    corrections.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = corrections.withColumn("bank_key", C.exemplar_key(F.col("bank"))).filter("bank_key <> '' and amount is not null and amount <> '' and seq is not null")
    keyed = keyed.select("bank_key", F.pmod(F.xxhash64("amount", "date"), F.lit(salts)).alias("salt"), F.col("seq").cast("long").alias("seq"), "amount", "date", "currency", "cheque_number")
    return keyed.groupBy("bank_key", "salt").transformWithStateInPandas(Newest(keep), SLOT, "update", "none")


def exemplars_of(slots: DataFrame, keep: int = KEEP) -> DataFrame:
    """(bank_key, pos, amount, date, currency, cheque_number, seq) from a table of slots, as `learn_exemplars` gives them: a few dozen rows a bank meet."""
    order = Window.partitionBy("bank_key").orderBy(F.col("seq").desc(), "amount", "date")
    return slots.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= keep).select("bank_key", "pos", "amount", "date", "currency", "cheque_number", "seq")
