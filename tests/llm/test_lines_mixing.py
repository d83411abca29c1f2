import math
import random

import pytest
from pyspark.sql import functions as F

from draftmill.llm import mixing
from draftmill.llm.lines import dedup_lines
from draftmill.llm.queries import op6_line_dedup, op8_mixing

SF = "/root/testdata/sf0.001"


def slow_lines(docs):
    """doc_id, text -> text after the removal, number of lines removed."""
    seen, out = {}, {}
    docs = [(d, (t or "").split("\n")) for d, t in docs]
    for d, lines in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        gone = set()
        key = [x if x.strip(" \t\n\x0b\x0c\r") else "" for x in lines]
        for i in range(len(lines) - 2):
            w = tuple(key[i : i + 3])
            if any(w) and seen.setdefault(w, (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        out[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in op6_line_dedup(spark, SF).collect()} == slow_lines(docs)


def test_line_dedup_of_odd_rows(spark, odd, none):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(odd).collect()}
    assert got == slow_lines(list(dict.fromkeys((r.doc_id, r.text) for r in odd.collect())))
    assert got[7] == ("zero", 5, 4) and dedup_lines(odd).count() == odd.count() and dedup_lines(none).count() == 0
    rows = [(1, "a\nb\nc\na\nb\nc\nd"), (2, "\n \n\t\n\n"), (3, "\n\n\n\n"), (4, "x\na\nb\nc\n"), (5, "a\nb")]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == slow_lines(rows)


def test_pfair_deviates_by_less_than_one_block():
    rng = random.Random(4)
    for _ in range(30):
        weights = {f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.randint(1, 20))}
        quota = mixing.quotas(weights, 200)
        assert sum(quota.values()) == 200 and min(quota.values()) >= 1
        slots = mixing.one_period(quota)
        assert sorted(t for s in slots.values() for t in s) == list(range(200))
        for s, q in quota.items():
            had = 0
            own = set(slots[s])
            for t in range(200):
                had += t in own
                assert abs(had - (t + 1) * q / 200) < 1


def test_plan_gives_every_block_its_own_slot():
    blocks = {"a": 700, "b": 90, "c": 3, "d": 0, "e": 41}
    phases = mixing.plan(blocks, {"a": 1, "b": 1, "c": 2, "d": 5}, 100)
    slots = []
    for s, n in blocks.items():
        own = [p["start"] + (b - p["low"]) // p["quota"] * p["size"] + p["slots"][(b - p["low"]) % p["quota"]] for p in phases.get(s, []) for b in range(p["low"], p["high"])]
        assert len(own) == n and own == sorted(own)
        slots += own
    assert len(set(slots)) == len(slots)


def test_mixing_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    rows = op8_mixing(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    source = {r.doc_id: r.source for r in docs}
    at, filled = {}, {}
    for r in rows:
        assert source[r.doc_id] == r.source and at.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
        filled.setdefault(r.slot, []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= mixing.BLOCK for p in filled.values())


def test_mixing_of_odd_rows(spark, odd, none):
    rows = mixing.mix(odd, {"a": 2.0, "b": 1.0}, block=1, period=12).collect()
    assert len({r.slot for r in rows}) == len(rows) == odd.count()
    order = [r.source for r in sorted(rows, key=lambda r: r.slot)]
    # While all go on: two of a for each b. Then the rest of a; then sources without a weight.
    assert order[:3].count("a") == 2 and order[-2:].count("c") == 1 and order[-2:].count("") == 1
    whole = mixing.mix_rows(odd, block=2)
    assert whole.columns == odd.columns and sorted(map(str, whole.collect())) == sorted(map(str, odd.collect()))
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0


def slow_mix(blocks, weights, period):
    """The mix slot by slot: in each, of the released blocks the one with the earliest deadline goes; when a source ends, a new phase begins with
    the next period."""
    left, done, start, out = dict(blocks), dict.fromkeys(blocks, 0), 0, {}
    while any(left.values()):
        active = {s: weights[s] for s, n in left.items() if n}
        quota = mixing.quotas(active, max(period, 4 * len(active)))
        size, stop = sum(quota.values()), False
        while not stop:
            placed = dict.fromkeys(quota, 0)
            for t in range(size):
                due = [(-(-(placed[s] + 1) * size // q), s) for s, q in quota.items() if placed[s] < q and placed[s] * size // q <= t]
                s = min(due)[1]
                placed[s] += 1
                if left[s]:
                    out[s, done[s]] = start + t
                    done[s] += 1
                    left[s] -= 1
                    stop = stop or not left[s]
            start += size
    return out


def test_plan_against_a_mix_slot_by_slot():
    blocks, weights = {"a": 130, "b": 37, "c": 3, "e": 61}, {"a": 1.0, "b": 1.0, "c": 2.0, "e": 0.3}
    got = {}
    for s, phases in mixing.plan(blocks, weights, 40).items():
        for p in phases:
            for b in range(p["low"], p["high"]):
                turn, j = divmod(b - p["low"], p["quota"])
                got[s, b] = p["start"] + turn * p["size"] + p["slots"][j]
    assert got == slow_mix(blocks, weights, 40)


def test_order_of_the_mix(spark):
    docs = spark.createDataFrame([(i if i % 50 else None, f"t{i}", "abc"[min(i % 7, 2)], i, i, i) for i in range(3000)], "doc_id long, text string, source string, `a.b` int, slot int, key int")
    at = {(r.doc_id, r.source): [] for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        at[r.doc_id, r.source].append((r.slot, r.place))
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns
    whole = [r for r in rows.collect()]
    assert sorted(r["a.b"] for r in whole) == list(range(3000))
    order = [at[r.doc_id, r.source][0] for r in whole if r.doc_id is not None]
    assert order == sorted(order)
    spans = mixing.mix_spans(docs, span=4)
    got = spans.withColumn("part", F.spark_partition_id()).collect()
    assert all(len({r.part for r in got if r.span == s}) == 1 for s in {r.span for r in got})
    assert all(r.span == at[r.doc_id, next(x for d, x in at if d == r.doc_id)][0][0] // 4 for r in got if r.doc_id is not None)


def placed(phases):
    """Of each block of the plan its slot."""
    out = {}
    for s, own in phases.items():
        for p in own:
            for b in range(p["low"], p["high"]):
                turn, j = divmod(b - p["low"], p["quota"])
                out[s, b] = p["start"] + turn * p["size"] + p["slots"][j]
    return out


def test_two_thousand_sources_keep_their_targets():
    """At the default parameters: in each phase every source that goes on is less than one block from its share after any slot, and no two blocks share a
    slot."""
    rng = random.Random(4)
    blocks = {f"s{i}": max(1, int(rng.paretovariate(0.8))) for i in range(2000)}
    weights = {s: math.sqrt(n) for s, n in blocks.items()}
    phases = mixing.plan(blocks, weights)
    got = placed(phases)
    assert len(got) == sum(blocks.values()) == len(set(got.values()))
    assert len({p["start"] for own in phases.values() for p in own}) < mixing.SINGLY + 10
    for s, own in phases.items():
        assert [p["low"] for p in own] == [0, *[p["high"] for p in own[:-1]]] and own[-1]["high"] == blocks[s]
        for p in own:
            for i, slot in enumerate(got[s, b] - p["start"] for b in range(p["low"], p["high"])):
                # After `slot` slots i blocks are placed, after the next i + 1: each less than one from the share.
                share = p["quota"] / p["size"]
                assert abs(slot * share - i) < 1 and abs((slot + 1) * share - i - 1) < 1
    # Quotas follow the weights to within a slot of the period, while sources are many enough for it to say so.
    first = {s: own[0] for s, own in phases.items()}
    total = sum(weights.values())
    assert all(abs(p["quota"] - weights[s] / total * p["size"]) < 1.5 or p["quota"] == 1 or p["quota"] > 50 for s, p in first.items())


def test_the_schedule_of_many_sources_is_joined_by_source(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 700}" if i % 2 else "big") for i in range(6000)], "doc_id long, source string")
    one = {(r.doc_id, r.slot, r.place) for r in mixing.mix(docs, block=2, period=50).collect()}
    monkeypatch.setattr(mixing, "BROADCAST", 10)
    assert {(r.doc_id, r.slot, r.place) for r in mixing.mix(docs, block=2, period=50).collect()} == one
    assert len({x[1:] for x in one}) == 6000 and len({x[0] for x in one}) == 6000
    assert sorted(r.doc_id for r in mixing.mix_rows(docs, block=2, period=50).collect()) == list(range(6000))
    given = {(r.source, r.slot) for r in mixing.mix(docs, {"big": 1.0, "s1": 1.0}, block=1, period=50).collect()}
    early = sorted(given, key=lambda x: x[1])[:8]
    assert {s for s, _ in early} == {"big", "s1"} and abs(sum(s == "s1" for s, _ in early) - 4) <= 1  # a small source has its own weight
    monkeypatch.setattr(mixing, "MOST", 5)
    with pytest.raises(ValueError, match="5 sources"):
        mixing.mix(docs)


def test_quotas_give_way_as_one_by_one():
    rng = random.Random(8)
    for _ in range(30):
        weights = {f"s{i}": rng.random() ** 6 + 1e-9 for i in range(rng.randint(2, 60))}
        period = len(weights) + rng.randint(0, 30)
        got = mixing.quotas(weights, period)
        assert sum(got.values()) == period and min(got.values()) >= 1
