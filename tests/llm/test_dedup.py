import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from draftmill.llm import exact, simhash
from draftmill.llm.components import components
from draftmill.llm.exact import drop_exact_copies, exact_dedup
from draftmill.llm.queries import op7_simhash

SF = "/root/testdata/sf0.001"


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(docs):
    prints = [slow_print(t) for _, t in docs]
    a = np.array(prints, np.uint64)
    low = [d for d, _ in docs]
    while True:
        new = [min((low[j] for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4) if low[j] is not None), default=None) for i in range(len(docs))]
        if new == low:
            return sorted(((d or 0), f"{p:016x}", c) for (d, _), p, c in zip(docs, prints, low))
        low = new


def test_simhash_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in op7_simhash(spark, SF).collect()) == slow_components(docs)


def test_simhash_of_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.near_duplicates(odd).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("p"), "component_id").collect()
    assert sorted((r.doc_id or 0, r.p, r.component_id) for r in got) == slow_components(docs)
    assert simhash.near_duplicates(none).count() == 0
    stay = simhash.drop_near_copies(odd)
    assert stay.columns == odd.columns and sorted(r.doc_id or 0 for r in stay.collect()) == [0, 1, 3, 6, 7, 7, 9, 10, 11, 12]


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(3)
    each = simhash.masks(4)
    assert len(each) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in each)


def test_links_are_the_same_with_every_kind_of_bucket(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    a = np.array(sorted(fps), np.uint64).view(np.int64)
    label = {int(x): int(x) for x in a}
    while True:
        new = {int(x): min(label[int(y)] for y in a[np.bitwise_count((a ^ x).view(np.uint64)) <= 4]) for x in a}
        if new == label:
            break
        label = new
    for limit in (4096, 2):
        got = {r.node: r.root for r in components(simhash.links(df, 4, limit)).collect()}
        assert {k: got.get(k, k) for k in label} == label


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 1000 for i in range(1001, 1300)}
    assert components(edges.limit(0)).count() == 0


def test_exact_dedup_of_odd_rows(odd, none):
    rows = exact_dedup(odd).collect()
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows)
    assert got == sorted([(1, 2, 2, False), (2, 2, 2, True), (3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True), (6, 6, 1, True), (7, 7, 2, False), (7, 7, 2, True), (0, 0, 1, True), (9, 9, 1, True), (10, 10, 1, True), (11, 11, 1, True), (12, 12, 1, True)])
    stay = drop_exact_copies(odd)
    assert stay.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in stay.collect()) == [0, 2, 5, 6, 7, 9, 10, 11, 12]
    assert exact_dedup(none).count() == 0 and drop_exact_copies(none).count() == 0


def test_many_rows_have_a_filter_for_each_range(spark, monkeypatch):
    """At ten times the rows that one filter is meant for, unrepeated rows still pass it, and every repeated one is caught."""
    monkeypatch.setattr(exact, "MAX_CELLS", 1 << 16)
    n = 10 * (1 << 16) // exact.PER_ROW
    keys = spark.range(n).select(F.xxhash64(F.when(F.col("id") % 20 == 0, F.col("id") % 100).otherwise(F.col("id"))).alias("h"), F.col("id"))
    one = keys.withColumn("maybe", exact.possibly_in(keys, exact.hit_cells(keys), "h"))
    wrong = lambda d: d.filter("maybe and id % 20 > 0").count() / (0.95 * n)
    assert wrong(one) > 0.5  # a single filter of that size is full
    rows = exact.marked(keys)
    assert wrong(rows) < 0.02 and rows.filter("not maybe and id % 20 = 0").count() == 0 and rows.count() == n and rows.select("id").distinct().count() == n
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id % 90) AS text")
    monkeypatch.setattr(exact, "PER_ROW", 1 << 11)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(docs).collect()}
    assert got == {i: (i % 90, 4 if i % 90 < 30 else 3) for i in range(300)}
    assert sorted(r.doc_id for r in exact.drop_exact_copies(docs).collect()) == list(range(90))
