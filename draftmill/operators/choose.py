"""Choosing among several reads of a cheque: best read, escalation, majority vote. One shuffle by id serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions import columns as C
from draftmill.functions.tables import MODELS
from draftmill.operators.validate import VALIDATED


def pick_best_read(validated: DataFrame) -> DataFrame:
    """One row per id: the read with the highest score; of equal ones the earliest pass. A later read that failed is no read: it never takes the place
    of another. A partial aggregate: no sort of the reads."""
    cols = [c for c in validated.columns if c != "id"]
    failed = F.col("error").isNotNull() & (F.col("pass") > 1)
    order = F.struct(~failed, C.score(F.col("flags"), F.col("amount_reconciled"), F.col("confidence")), -F.col("pass"))
    return validated.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("id", "r.*")


def needs_escalation(escalate_model: str, enabled: bool = True) -> Column:
    return F.lit(enabled) & (F.col("status") == "review") & (F.col("model") != escalate_model)


def needs_vote(enabled: bool = True) -> Column:
    return F.lit(enabled) & (F.col("status") == "review")


def escalation_worklist(best: DataFrame, reads: DataFrame, escalate_model: str) -> DataFrame:
    """Ids under review that no read of the escalation model has looked at yet."""
    done = reads.filter(F.col("model") == escalate_model).select("id")
    return best.filter(needs_escalation(escalate_model)).select("id", "bank", "status", "confidence").join(done, "id", "left_anti")


def escalation_target(reads: DataFrame, configured: str) -> DataFrame:
    """The model for a second read: the configured one if it is of the same provider as the read's, else that provider's strongest. The
    catalogue has five rows."""
    strongest = {provider: model for model, provider in MODELS}  # the last of a provider
    own = C.provider_of(F.col("model"))
    other = F.when(own == "google", strongest["google"]).otherwise(strongest["anthropic"])
    return reads.withColumn("target", F.when(own == C.provider_of(F.lit(configured)), configured).otherwise(other))


def majority_amount(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(id, amount, votes) where at least three samples agree on two decimals; of equally frequent amounts the one seen first. Samples: the
    base read's two values, then for each extra read, by pass, its digits and its words value. base: id and the two values; extra: raw
    reads, of which those that failed or that base doesn't ask for have no say."""
    if "error" in extra.columns:
        extra = extra.filter("error is null")
    extra = extra.join(base.select("id"), "id", "left_semi")
    first = base.select("id", F.posexplode(F.array("amount_numeric_value", "amount_words_value")).alias("k", "v")).withColumn("pos", F.col("k").cast("long"))
    pair = F.array(C.parse_amount(F.col("amount_numeric")), F.col("amount_words_value"))
    more = extra.select("id", "pass", F.posexplode(pair).alias("k", "v")).withColumn("pos", F.col("pass") * 2 + F.col("k") + 10)
    samples = first.select("id", "pos", "v").unionByName(more.select("id", "pos", "v")).filter("v is not null")
    counts = samples.groupBy("id", C.format_amount(F.col("v")).alias("amount")).agg(F.count("*").alias("votes"), F.min("pos").alias("pos"))
    best = counts.groupBy("id").agg(F.max_by(F.struct("amount", "votes"), F.struct(F.col("votes"), -F.col("pos"))).alias("b")).select("id", "b.*")
    return best.filter("votes >= 3")


def apply_vote(best: DataFrame, votes: DataFrame, escalate_model: str) -> DataFrame:
    """Rows under review get the amount on which votes agree, lose their amount flags, and are under review still only if another high flag
    stands. The model becomes the escalation model whether or not the vote agreed. Confidence stays."""
    v = votes.select(F.col("id").alias("v_id"), F.col("amount").alias("v_amount"))
    both = best.join(v, F.col("id") == F.col("v_id"), "left")
    asked = F.col("status") == "review"
    won = asked & F.col("v_id").isNotNull()
    left = F.filter("flags", lambda f: f["field"] != "amount")
    new = {
        "amount": F.when(won, F.col("v_amount")).otherwise(F.col("amount")),
        "amount_reconciled": F.col("amount_reconciled") | won,
        "flags": F.when(won, left).otherwise(F.col("flags")),
        "status": F.when(won, F.when(C.high_flags(left) > 0, "review").otherwise("ok")).otherwise(F.col("status")),
        "model": F.when(asked, escalate_model).otherwise(F.col("model")),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in best.columns])


def result_rows(chosen: DataFrame) -> DataFrame:
    """Columns of a result from a chosen read with its place (pdf_id, page_index, cheque_on_page)."""
    return chosen.select("id", "pdf_id", "page_index", "cheque_on_page", *VALIDATED, F.lit(False).alias("reviewed"), "model", "error")
