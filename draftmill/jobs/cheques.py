"""The three jobs as a whole: pages to cheques, reads to results, review to report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions.shared import written
from draftmill.operators import choose, exemplars, layout, results
from draftmill.operators.validate import with_error_rows
from draftmill.sources import responses
from draftmill.streaming.store import KeyedTable


@dataclass(frozen=True)
class Options:
    """What a job does beyond one read a cheque."""

    escalate: bool = True  # a second read, by escalate_model, of what the first leaves under review
    escalate_model: str = "gemini-2.5-pro"
    voting: bool = True  # further reads of what is still under review vote on the amount
    vote_from: int = 3  # their first pass
    samples: int = 2  # how many they are
    few_shot: bool = True  # second reads and votes get a hint: what is known of the bank, and corrected examples
    examples: int = exemplars.SHOWN


def find_cheques(runs: DataFrame, pages: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, page_key, ordinal, cheques_on_page, box, flag): every page's cheques in order, by layout or, where that is unsure, by proposals."""
    regions = layout.resolve_page_regions(layout.detect_regions(runs, pages), proposals)
    return layout.region_ordinals(regions).select("id", "page_key", "ordinal", "cheques_on_page", *layout.BOX, "flag")


def _second(reads: DataFrame, options: Options) -> DataFrame:
    return reads.filter(F.col("pass").between(2, options.vote_from - 1))


def _votes(reads: DataFrame, options: Options) -> DataFrame:
    return reads.filter(F.col("pass").between(options.vote_from, options.vote_from + options.samples - 1))


#: What a choice among reads, and what follows from it, goes by.
CHOICE = ("id", "pass", "model", "error", "bank", "flags", "amount_reconciled", "confidence", "status")


def _chosen(reads: DataFrame, options: Options, columns: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first read of each id, and the best: the first, or the second where the first calls for it and it didn't fail; of all columns or of some. Written
    out, so that no read is validated twice."""
    valid = lambda d: with_error_rows(d).select(*columns or "*")
    first = written(valid(reads.filter("pass = 1")), "first-reads")
    if not options.escalate:
        return first, first
    asked = first.filter(choose.needs_escalation(options.escalate_model)).select("id")
    second = valid(_second(reads, options).join(asked, "id", "left_semi"))
    return first, written(choose.pick_best_read(first.unionByName(second)), "best-reads")


def read_cheques(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """One result row per id from raw reads of all passes: the better of the first and, where it is called for, the second, and where that is still under
    review the votes of the next `samples` reads. Further reads have no say."""
    _, best = _chosen(reads, options)
    if options.voting:
        asked = best.filter(choose.needs_vote())
        best = choose.apply_vote(best, choose.majority_amount(asked, _votes(reads, options)), options.escalate_model)
    return choose.result_rows(best)


def read_responses(landed: DataFrame, options: Options = Options()) -> DataFrame:
    """Result rows from what models answered (`responses.reads_of`), failures and answers that can't be read included."""
    return read_cheques(written(responses.reads_of(landed), "reads"), options)


def request_reads(reads: DataFrame, corrections: DataFrame, options: Options = Options()) -> DataFrame:
    """(id, pass, model, prompt): what is still to be asked, given the reads so far: second reads of what the first leaves under review, and, where no second
    read is due, the votes on what is under review still. Prompts carry a hint about the bank that was read."""
    done = reads.filter(F.col("pass") >= min(2, options.vote_from)).select("id", "pass")
    first, best = _chosen(reads, options, CHOICE)
    parts = []
    second_due = best.filter(F.lit(False)).select("id")
    if options.escalate:
        due = first.filter(choose.needs_escalation(options.escalate_model)).join(_second(done, options).select("id"), "id", "left_anti")
        second_due = written(due.select("id", "bank"), "second-reads-due")
        parts.append(second_due.select("id", "bank", F.lit(2).alias("pass")))
    if options.voting:
        asked = best.filter(choose.needs_vote()).select("id", "bank").join(second_due.select("id"), "id", "left_anti")
        each = asked.withColumn("pass", F.explode(F.sequence(F.lit(options.vote_from), F.lit(options.vote_from + options.samples - 1))))
        parts.append(each.join(done, ["id", "pass"], "left_anti").select("id", "bank", "pass"))
    due = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else best.filter(F.lit(False)).select("id", "bank", F.lit(2).alias("pass"))
    asked = hints_for(due, corrections, options).withColumn("mode", F.lit("extract"))
    return responses.build_requests(asked).select("id", "pass", F.lit(options.escalate_model).alias("model"), "prompt")


def review_cheques(found: DataFrame, corrections: DataFrame) -> DataFrame:
    """Result rows after their corrections, with their rank in the order of display and their line of the export."""
    return results.csv_lines(results.display_rank(results.apply_corrections(found, corrections)))


def review_stored(spark: SparkSession, path: str, corrections: DataFrame) -> DataFrame:
    """The same for results that are stored as a table by id: rows that a correction changes are put back, in proportion to the corrections; what is
    ranked and exported is the table as it is then."""
    table = KeyedTable(spark, path)
    hit = table.read().join(corrections.select("id").distinct(), "id", "left_semi")
    table.put(results.apply_corrections(hit, corrections))
    return results.csv_lines(results.display_rank(table.read()))


def hints_for(cheques: DataFrame, corrections: DataFrame, options: Options = Options()) -> DataFrame:
    """cheques (with a bank) with the hint that a request for them carries; without few_shot there is none."""
    if not options.few_shot:
        return cheques.withColumn("hint", F.lit(None).cast("string"))
    return exemplars.build_hints(cheques, exemplars.learn_exemplars(corrections), options.examples)
