import re
from collections import Counter
from itertools import combinations

import numpy as np

import corpus_pipeline
from draftmill.llm import mixing, trees
from tests.llm.test_packing_counts import check
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i}"))
    rows = [[r.asDict() for r in s.collect()] for s in seen[:5]]
    assert all(s.columns == docs.columns for s in seen[:5])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # 1: what the classifier scores under 0.3 goes.
    score = {r.doc_id: r.score for r in trees.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r in rows[0] if score[r["doc_id"]] >= 0.3}
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([d in {r["doc_id"] for r in rows[1]} for d in good]) > 0.97
    # 2: of equal texts the longest, then the first.
    best = {}
    for r in rows[1]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert {r["doc_id"] for r in rows[2]} == {d for _, d in best.values()}
    # 3: of each component of texts with a similarity of 0.8 or more the smallest id.
    assert sorted(r["doc_id"] for r in rows[3]) == lows_of_similar({r["doc_id"]: r["text"] for r in rows[2]}) and len(rows[3]) < len(rows[2])
    # 4: all of them.
    assert sorted(map(str, rows[4])) == sorted(map(str, rows[3]))
    # 5: every token once.
    check(seen[5].select("*", F.crc32("ids").alias("ids_crc32")).collect(), [(r["doc_id"], r["text"]) for r in rows[4]])
    # run() is the same stages one after the other.
    piece = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", F.crc32("ids")).collect()))
    assert piece(corpus_pipeline.run(spark, SF)) == piece(seen[5])


def lows_of_similar(texts):
    """The least id of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        if root[a] != root[b]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return sorted({d for d in root if root[d] == d})


def test_stages_on_odd_rows_and_clashing_names(spark, odd, none):
    names = ("span", "piece", "ids", "k", "doc", "h", "th", "slot", "part", "score", "sha", "maybe", "node", "low")
    for given in (odd, none):
        docs = given.drop("kept").withColumns({c: F.lit(f"own {c}") for c in names})
        seen = docs
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, seen, SF)
            if i < 4:
                assert now.columns == docs.columns
                kept = {str(r) for r in seen.collect()}
                rows = now.collect()
                assert {str(r) for r in rows} <= kept and all(r[c] == f"own {c}" for r in rows for c in names)
                seen = spark.createDataFrame(rows, docs.schema)
        want = [(r.doc_id, r.text) for r in seen.collect()]
        if want:
            check(now.select("*", F.crc32("ids").alias("ids_crc32")).collect(), want)
        assert bool(want) == (given is odd) and now.count() >= len(want)


def test_sequences_follow_the_mix(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * (i % 90), "abc"[min(i % 7, 2)]) for i in range(9000)], "doc_id long, text string, source string")
    slot = {r.doc_id: (r.slot, r.source) for r in mixing.mix(docs).collect()}
    # Files of the mix come back in another order: the rows alone must tell it.
    first = {}
    for r in corpus_pipeline.packed(spark, mixing.mix_rows(docs).repartition(5, "doc_id"), SF).select("doc_id", "sequence_id").collect():
        first[r.doc_id] = min(first.get(r.doc_id, r.sequence_id), r.sequence_id)
    assert len(first) == 9000
    order = sorted(first, key=lambda d: first[d])
    spans = [slot[d][0] // mixing.SPAN for d in order]
    assert spans == sorted(spans) and spans[-1] >= 8
    # Shares of the sources over the first sequences: those of the weights, give or take a block, as long as no source has ended.
    sizes = Counter(s for _, s in slot.values())
    ended = min(max(t for t, s in slot.values() if s == x) for x in sizes)
    quota = mixing.quotas({s: n**0.5 for s, n in sizes.items()}, mixing.PERIOD)
    for k in range(1, ended // mixing.SPAN + 1):
        got = Counter(slot[d][1] for d, at in zip(order, spans, strict=True) if at < k)
        assert all(abs(got[s] / mixing.BLOCK - k * mixing.SPAN * q / mixing.PERIOD) < 1 for s, q in quota.items())
