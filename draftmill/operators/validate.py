"""Validation of one read: typed values, reconciliation of digits and words, flags, confidence, status. Row-local, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import columns as C
from draftmill.functions.tables import FLAG, HANDOVER

# Digits of a cheque number, weights of the fields in the confidence, and, below, the reasons of the flags.
DIGITS = 8
WEIGHTS = {"amount": 3.0, "date": 3.0, "payer": 1.0, "bank": 1.5, "cheque_number": 1.5}
VALIDATED = (
    "amount", "amount_words", "amount_numeric_value", "amount_words_value", "amount_reconciled", "currency", "date", "payer", "bank",
    "cheque_number", "has_handwriting", "flags", "confidence", "status",
)


def _flag(when: Column, field: str, severity: str, reason: Column | str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), reason.alias("reason")))


def validate_extraction(reads: DataFrame) -> DataFrame:
    """The read's own columns (id, pass, model, error and what else there is) with the raw fields replaced by validated ones."""
    raw_fields = ("amount_numeric", "amount_words", "amount_words_value", "currency", "date", "payer", "bank", "cheque_number", "has_handwriting", "field_confidence")
    rest = [c for c in reads.columns if c not in raw_fields]
    given = F.col("amount_words_value")
    d = reads.select(
        *rest,
        C.parse_amount(F.col("amount_numeric")).alias("num"),
        F.when(given.isNotNull() & ~F.isnan(given) & (F.abs(given) != float("inf")), given).otherwise(C.words_to_number(F.col("amount_words"))).alias("words"),
        C.or_empty(C.trim_all(F.col("amount_words"))).alias("amount_words"),
        C.or_empty(C.trim_all(F.col("date"))).alias("raw_date"),
        C.normalize_cheque_number(F.col("cheque_number"), DIGITS).alias("cheque_number"),
        C.or_empty(C.trim_all(F.col("payer"))).alias("payer"),
        C.or_empty(C.trim_all(F.col("bank"))).alias("bank"),
        C.or_empty(C.trim_all(F.col("currency"))).alias("raw_currency"),
        F.coalesce("has_handwriting", F.lit(False)).alias("has_handwriting"),
        F.coalesce("field_confidence.amount", F.lit(1.0)).alias("amount_conf"),
        F.coalesce("field_confidence.payer", F.lit(1.0)).alias("payer_conf"),
    )
    num, words = F.col("num"), F.col("words")
    both, neither = num.isNotNull() & words.isNotNull(), num.isNull() & words.isNull()
    d = d.withColumns({"both": both, "amount_reconciled": F.coalesce(C.approx_equal(num, words), F.lit(False)), "iso": C.parse_date(F.col("raw_date"))})
    ok = F.col("amount_reconciled")
    d = d.withColumns({
        "amount": C.format_amount(F.when(ok, num).otherwise(F.coalesce(words, num))),
        "date": F.when(F.col("raw_date") == "", HANDOVER).otherwise(F.coalesce("iso", "raw_date")),
        "currency": F.when(F.col("raw_currency") != "", F.col("raw_currency")).otherwise(C.infer_currency(F.col("bank"))),
    })
    n = F.length("cheque_number")
    disagree = F.concat(F.lit("Digits ("), C.format_amount(num), F.lit(") and words ("), C.format_amount(words), F.lit(") disagree"))
    flags = F.array(
        _flag(F.col("both") & ~ok, "amount", "high", disagree),
        _flag(neither, "amount", "high", "No amount detected"),
        _flag(num.isNull() != words.isNull(), "amount", "low", "Only one of digits/words present; cannot cross-check"),
        _flag((F.col("amount") != "") & ok & (F.col("amount_conf") < 0.7), "amount", "low", "Model low confidence on amount"),
        _flag((F.col("raw_date") != "") & F.col("iso").isNull(), "date", "high", "Date does not parse to a valid calendar date"),
        _flag(n == 0, "chequeNumber", "high", "No cheque number detected"),
        _flag((n > 0) & (n != DIGITS), "chequeNumber", "high", F.concat(F.lit(f"Expected {DIGITS} digits, got "), n)),
        _flag(F.col("payer") == "", "payer", "low", "Payer not detected"),
        _flag((F.col("payer") != "") & (F.col("payer_conf") < 0.6), "payer", "low", "Model low confidence on payer"),
        _flag(F.col("bank") == "", "bank", "low", "Bank not detected"),
    )
    d = d.withColumn("flags", F.filter(flags, lambda f: f.isNotNull()).cast(f"array<{FLAG}>"))
    present = {"amount": F.col("amount") != "", "date": F.col("date") != HANDOVER, "payer": F.col("payer") != "", "bank": F.col("bank") != "", "cheque_number": n == DIGITS}
    found = reduce(lambda a, b: a + b, [F.when(present[k], w).otherwise(0.0) for k, w in WEIGHTS.items()])
    found = F.greatest(F.lit(0.0), found - F.when(F.col("both") & ~ok, 2.0).otherwise(0.0))
    d = d.withColumns({"high": C.high_flags(F.col("flags")), "found": found})
    confidence = C.half_up(F.greatest(F.lit(0.0), F.col("found") - 0.5 * F.col("high")) / sum(WEIGHTS.values()) * 100)
    d = d.withColumns({"confidence": confidence.cast("int"), "status": F.when(F.col("high") > 0, "review").otherwise("ok"), "amount_numeric_value": num, "amount_words_value": words})
    return d.select(*rest, *VALIDATED)


def with_error_rows(reads: DataFrame) -> DataFrame:
    """Reads with an error are validated as empty reads; their status is 'error' and the message stays."""
    failed = F.col("error").isNotNull()
    raw = [c for c in reads.columns if c in ("amount_numeric", "amount_words", "amount_words_value", "currency", "date", "payer", "bank", "cheque_number", "has_handwriting", "field_confidence")]
    emptied = reads.withColumns({c: F.when(~failed, F.col(c)) for c in raw})
    return validate_extraction(emptied).withColumn("status", F.when(failed, "error").otherwise(F.col("status")))
