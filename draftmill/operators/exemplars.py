"""Learning from corrections: newest exemplars per bank, and hints built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmill.functions import columns as C
from draftmill.functions.tables import EXAMPLES

KEEP, SHOWN, SALTS = 3, 2, 16
_FIELDS = ("amount", "date", "currency", "cheque_number", "seq")


def learn_exemplars(corrections: DataFrame, keep: int = KEEP) -> DataFrame:
    """(bank_key, pos, amount, date, currency, cheque_number, seq): the newest corrections of each bank, newest first; of those equal in amount and date
    the newest counts. A bank may hold most of the rows: they are reduced by (bank, amount, date), then by (bank, salt), before they
    meet."""
    keyed = corrections.withColumn("bank_key", C.exemplar_key(F.col("bank"))).filter("bank_key <> '' and amount is not null and amount <> ''")
    newest = keyed.groupBy("bank_key", "amount", "date").agg(F.max_by(F.struct(*_FIELDS), "seq").alias("e")).select("bank_key", "e.*")
    salted = newest.withColumn("salt", F.pmod(F.xxhash64("amount", "date"), F.lit(SALTS)))
    order = [F.col("seq").desc(), F.col("amount"), F.col("date")]
    some = salted.withColumn("pos", F.row_number().over(Window.partitionBy("bank_key", "salt").orderBy(*order))).filter(F.col("pos") <= keep)
    out = some.withColumn("pos", F.row_number().over(Window.partitionBy("bank_key").orderBy(*order))).filter(F.col("pos") <= keep)
    return out.select("bank_key", "pos", *_FIELDS)


def top_exemplars(exemplars: DataFrame, n: int = SHOWN) -> DataFrame:
    return exemplars.filter(F.col("pos") <= n)


def build_hints(cheques: DataFrame, exemplars: DataFrame, n: int = SHOWN) -> DataFrame:
    """cheques with `hint`: guidance for a known bank and its newest exemplars, or null."""
    line = F.concat(F.lit("  - amount="), F.col("amount"), F.lit(" "), C.or_empty(F.col("currency")), F.lit(", date="), C.or_empty(F.col("date")), F.lit(", cheque#="), C.or_empty(F.col("cheque_number")))
    lines = top_exemplars(exemplars, n).groupBy("bank_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    both = cheques.withColumn("bank_key", C.exemplar_key(F.col("bank"))).join(lines, "bank_key", "left")
    examples = F.when(F.col("lines").isNotNull(), F.concat(F.lit(EXAMPLES), F.col("lines")))
    hint = F.concat_ws("\n\n", C.bank_hint(F.col("bank")), examples)
    return both.withColumn("hint", F.when(hint != "", hint)).drop("bank_key", "lines")
