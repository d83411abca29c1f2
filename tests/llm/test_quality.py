import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.llm import exact, rules, trees
from draftmill.llm.common import crc_mod
from draftmill.llm.queries import op2_quality_classifier, op5_quality_rules

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_forest_learns_a_rule_of_two_statistics():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = trees.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert trees.fit(np.zeros((0, 4)), np.zeros(0)).score(x[:3]).tolist() == [0.5] * 3


def test_classifier_is_right_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op2_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(r.held_out for r in rows) > 100


def test_classifier_never_sees_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(crc_mod("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in trees.quality_scores(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_classifier_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 0), (3, None, 0), (99, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    assert trees.quality_scores(odd, labels).count() == odd.count()
    kept = trees.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert {r.score for r in trees.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert trees.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert trees.quality_scores(none, labels).count() == 0


def plain_statistics(text):
    """The classifier's statistics, one by one, by their definitions."""
    b = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", b) if w]
    lines = [x for x in b.split(b"\n") if x]
    n, size = len(words), len(b)
    share = lambda chars: sum(c in chars for c in b) / max(size, 1)
    pairs = [(words[i], words[i + 1]) for i in range(n - 1)]
    return [
        math.log(1 + n), sum(len(w) for w in words) / max(n, 1), max([len(w) for w in words] or [0]), len(set(words)) / max(n, 1), len(set(pairs)) / max(n - 1, 1),
        sum(a == c for a, c in pairs) / max(n - 1, 1), share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#*$%&<>=@_{}[]^~"), share(b"|"), share(b"!?"), share(b".,:;"),
        sum(c > 127 for c in b) / max(size, 1), math.log(1 + len(lines)), 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
    ]


def test_statistics_against_their_definitions(odd):
    for r in odd.collect():
        if len(r.text or "") < 10_000:
            assert np.allclose(trees.statistics(r.text or ""), plain_statistics(r.text or "")), r


def test_array_walk_against_a_walk_by_hand():
    rng = np.random.default_rng(2)
    x = rng.random((500, 5))
    forest = trees.fit(x, (x[:, 1] + x[:, 3] > 1).astype(float), trees=12, depth=3)
    want = []
    for row in x:
        total = forest.start
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - 7]
        want.append(1 / (1 + math.exp(-total)))
    assert np.allclose(forest.score(x), want)


def test_rows_leave_by_id_and_text(spark):
    rows = [(1, "a good text", 0), (1, "!!! $$$ ### 111", 1), (None, "!!! $$$ ### 111", 2), (None, None, 3), (2, "a good text", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumns({"th": F.lit("x"), "k": F.lit(1), "doc": F.lit(2), "all": F.lit(3)})
    named = docs.filter("text like '!%'").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.lit(True).alias("all"))
    for small in (exact.SMALL, 0):
        exact.SMALL, was = small, exact.SMALL
        left = exact.drop_rows(docs, named)
        assert left.columns == docs.columns and sorted(r["a.b"] for r in left.collect()) == [0, 3, 4]
        exact.SMALL = was


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), None if covered is None else len(covered)


@pytest.mark.parametrize("whole", [True, False])
def test_rules_against_brute_force(spark, odd, whole):
    if whole:
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
        rows = op5_quality_rules(spark, SMALL).collect()
    else:
        docs = {r.doc_id: r.text for r in odd.collect()}
        rows = rules.quality_rules(odd, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        n, chars, symbols, dup, repeat = slow_statistics(docs[r.doc_id])
        repeat = 30_000 if repeat is None else repeat
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), r.doc_id
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and (not r.kept or not r.base_failed) and r.kept == (r.rule is None)


def test_rules_reject_bad_rows_and_keep_good_ones(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r, labels[r.doc_id]) for r in op5_quality_rules(spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    bad, good = [r for r, q in rows if q == 0], [r for r, q in rows if q == 1]
    assert sum(not r.kept for r in bad) / len(bad) > 0.6
    assert sum(r.kept for r in good) / len(good) > 0.97


def test_rules_grow_and_prune(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(a > 0.7 and b < 0.4), bool(i % 3)) for i, (a, b) in enumerate(rng.random((1500, 2)))]
    learned = rules.learn_rules(spark.createDataFrame(rows, "x double, y double, bad int, grow boolean"), ("x", "y"))
    hit = lambda r: any(all((dict(x=r[0], y=r[1])[c.feature] > c.threshold) == c.above for c in rule) for rule in learned)
    assert learned and sum(hit(r) == bool(r[2]) for r in rows) / len(rows) > 0.95


def test_rules_without_labels_or_rows(spark, odd, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert all(r.kept != r.base_failed for r in rules.quality_rules(odd, labels.limit(0)).collect())
    assert rules.quality_rules(none, labels).count() == 0
