"""Quality rules as a learned decision list. DataFrame functions only.

Statistics of every text are computed in one pass. Rules that reject a document are learned from the labelled ones by
sequential covering: a rule grows, condition by condition, by the threshold with the highest information gain; it is pruned on labelled
rows that it was not grown on; the rows that it covers are set aside, and the next rule is learned on the rest, until no rule is
precise enough. The list becomes one conditional expression.

Every step of the learning is one aggregate over the labelled rows, cut into bins, and sends `statistics x bins` counts to
the driver, however many rows there are.

Defined results: null text has no words and fails the base rule, as does any of under 50 words. Without labels of both kinds
no rule is learned and the base rule decides. Labels without a document, null labels and further labels of one doc_id (the highest
counts) do no harm. Repeated rows get equal results, a null doc_id stays null. Only doc_id and text are read, whatever other columns
there are; no rows in, no rows out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftmill.functions.columns import let

from .common import WHITE, id_and_text, staged

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "mark_share", "digit_share", "line_words")
BINS, MAX_RULES, MAX_CONDITIONS, MIN_PRECISION, MIN_COVER = 24, 8, 4, 0.95, 5


def _count(column: str, chars: str) -> Column:
    return (F.length(column) - F.length(F.translate(column, chars, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the array holds twice or more."""

    def keys(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def covered(k: Column) -> Column:
        by_key = F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        twice = let(by_key, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, 0).otherwise(let(let(hashed, keys), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k)))).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base columns, and FEATURES."""
    words = F.array_remove(F.split(F.translate("text", WHITE, " " * len(WHITE)), " "), "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.translate(line, WHITE, "") != "")
    base = id_and_text(docs).select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        _count("text", SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        _count("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        _count("text", "!?").alias("marks"),
        _count("text", "0123456789").alias("digits"),
    )
    n, chars, lines_ = F.greatest("w.n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("l.n", F.lit(1))
    return base.select(
        "doc_id", "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words",
        ((F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))).alias("base_failed"),
        (F.col("word_chars") / n).alias("word_length"), (F.col("n_symbols") / chars).alias("symbol_share"), (F.col("w.n_repeat_words") / n).alias("repeat_share"),
        (F.col("l.dup") / lines_).alias("dup_line_share"), (F.col("upper") / chars).alias("upper_share"), (F.col("marks") / n).alias("mark_share"),
        (F.col("digits") / chars).alias("digit_share"), (F.col("w.n_words") / lines_).alias("line_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def on(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.feature)
        return (c > self.threshold) if self.above else (c <= self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _all(conditions: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [c.on() for c in conditions], F.lit(True))


def _any(rules: list[list[Condition]]) -> Column:
    return reduce(lambda a, b: a | b, [_all(r) for r in rules], F.lit(False))


def learn_rules(labelled: DataFrame, features: tuple[str, ...] = FEATURES, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """An ordered list of conjunctions that mark rows with bad = 1. labelled: features, bad (0 or 1), grow (else prune)."""
    cuts_row = labelled.agg(*[F.percentile_approx(f, F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), 10_000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in features}

    def step(rules: list[list[Condition]], grown: list[Condition]) -> dict:
        """Bad and good rows, of both parts, by feature and bin, among those that no rule covers and the grown conditions do."""
        bin_of = lambda f: reduce(lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0))
        rows = labelled.filter(~_any(rules) & _all(grown)).select("bad", "grow", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in features])).alias("x"))
        out: dict = {}
        for r in rows.groupBy("x.f", "x.b", "grow", "bad").count().collect():
            out.setdefault((r.f, bool(r.grow)), {}).setdefault(r.b, [0, 0])[0 if r.bad else 1] += r["count"]
        return out

    def split(found: dict, c_feature: str, above: bool, at: int, part: bool) -> tuple[int, int]:
        own = [v for b, v in found.get((c_feature, part), {}).items() if (b > at) == above]
        return sum(v[0] for v in own), sum(v[1] for v in own)

    def whole(found: dict, part: bool) -> tuple[int, int]:
        own = found.get((features[0], part), {}).values()
        return sum(v[0] for v in own), sum(v[1] for v in own)

    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        grown: list[Condition] = []
        marks: list[tuple[int, int]] = []  # bad and good rows to prune on, for each prefix of the rule
        found = step(rules, grown)
        p0, n0 = whole(found, True)
        while p0 and n0 and len(grown) < MAX_CONDITIONS:
            best = None
            for f in features:
                for at, threshold in enumerate(cuts[f]):
                    for above in (True, False):
                        p, n = split(found, f, above, at, True)
                        if p >= MIN_COVER and (p, n) != (p0, n0):
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > 1e-9 and (best is None or gain > best[0]):
                                best = (gain, Condition(f, above, threshold, at), (p, n), split(found, f, above, at, False))
            if best is None:
                break
            grown.append(best[1])
            (p0, n0), mark = best[2], best[3]
            marks.append(mark)
            if n0:
                found = step(rules, grown)
        if not grown:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in marks]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i))
        p, n = marks[k]
        if p + n == 0 or p / (p + n) < min_precision:
            break
        rules.append(grown[: k + 1])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The text of the first rule that rejects the row, 'base' for the base rule, null for rows that are kept."""
    out = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        out = out.when(_all(r), F.lit(" and ".join(map(str, r))))
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule."""
    stats = staged(text_statistics(docs), "text-statistics")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    bad = (F.col("q") == 0).cast("int").alias("bad")
    labelled = staged(stats.filter("not base_failed").join(marks, "doc_id").select(*FEATURES, bad, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")), "labelled-statistics")
    rule = verdict(learn_rules(labelled))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rule.isNull().alias("kept"), rule.alias("rule"))
