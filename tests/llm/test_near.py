import itertools
import random

import numpy as np

from draftmill.llm import near
from pyspark.sql import functions as F

from draftmill.llm.exact import text_hash

WORDS = [f"w{i}x" for i in range(3000)]


def jaccard(a, b):
    s = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = rng.choice(WORDS)
    return " ".join(w)


def test_prints_meet_as_promised():
    # Any 3 differing places of a print miss one of its tables.
    for diff in itertools.combinations(range(near.PLACES), 3):
        assert any(not set(diff) & set(map(int, b)) for b in near._BLOCKS)
    rng = random.Random(2)
    met = 0
    for _ in range(300):
        a = [rng.getrandbits(64) for _ in range(900)]
        x, y = (near.bucket_keys(np.array(s, np.uint64)) for s in (a[:800] + a[800:], a[100:] + a[:0] + [rng.getrandbits(64) for _ in range(100)]))
        met += bool((x == y).any())
    assert met == 300  # similarity 0.8; one in ten thousand may be missed
    assert len(near.bucket_keys(near.hashes(" "))) == 0 and len(near.bucket_keys(near.hashes("A b"))) == 31 + 42


def test_light_edits_are_found_and_other_texts_left_alone(spark, odd, none):
    rng = random.Random(3)
    rows, group = [], {}
    for g in range(40):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.randint(150, 500)))
        for k in range(rng.choice([1, 1, 2, 5])):
            group[len(rows)] = g
            rows.append((len(rows), base if k == 0 else edited(rng, base, 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lows = {g: min(d for d, x in group.items() if x == g) for g in group.values()}
    for limit in (near.LIMIT, 2):
        got = {r.doc_id: r.component_id for r in near.near_copies(docs, limit=limit).collect()}
        assert all(group[c] == group[d] for d, c in got.items())
        assert sum(got[d] == lows[g] for d, g in group.items()) >= len(rows) - 2
    stay = near.drop_near_copies(odd)
    # 1 and 2 hold the same words, 3 to 5 none; 6 and 7 share too few shingles.
    assert stay.columns == odd.columns and sorted(r.doc_id or 0 for r in stay.collect()) == [0, 1, 3, 6, 7, 7, 9, 10, 11, 12]
    assert near.near_copies(none).count() == 0


def test_text_hash_is_the_one_of_spark(spark, odd):
    rows = odd.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    assert all(text_hash(r.text or "") == r.h for r in rows)


def test_every_pair_of_the_promised_similarity_is_found(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    while len(pairs) < 160:
        a = " ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 400)))
        n = len(a.split())
        if len(pairs) % 2:
            b = edited(rng, a, max(1, round(n * rng.uniform(0.01, 0.025))))
        else:
            b = a + " " + " ".join(rng.choice(WORDS) for _ in range(round(n * rng.uniform(0.17, 0.25))))
        if 0.8 <= jaccard(a, b) <= 0.85:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    low = len(rows)
    for _ in range(40):  # just under the promise: these stay apart
        a = " ".join(rng.choice(WORDS) for _ in range(200))
        b = a + " " + " ".join(rng.choice(WORDS) for _ in range(55))
        assert 0.77 < jaccard(a, b) < 0.8
        rows += [(len(rows), a), (len(rows) + 1, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_copies(docs).collect()}
    assert all(got[a] == got[b] == a for a, b in pairs)
    assert all(got[d] == d for d in range(low, len(rows)))


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    texts = []
    common = " ".join(rng.choice(WORDS) for _ in range(30))  # a passage of many texts
    for _ in range(12):
        base = " ".join(rng.choice(WORDS) for _ in range(120)) + " " + common
        texts += [base] + [edited(rng, base, rng.randint(1, 4)) for _ in range(8)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (near.LIMIT, 2):
        assert {r.doc_id: r.component_id for r in near.near_copies(docs, limit=limit).collect()} == dict(enumerate(root))


def templated(n, seed):
    """Texts that share a template without being linked, and for every eighth a copy with a few words changed, which is."""
    rng = random.Random(seed)
    template = " ".join(rng.choice(WORDS) for _ in range(150))
    texts = []
    for i in range(n):
        own = " ".join(f"u{seed}x{i}x{j}" for j in range(55))
        texts.append(f"{template} {own}")
        if i % 8 == 0:
            texts.append(edited(rng, texts[-1], 2))
    return texts


def test_templated_texts_take_as_many_steps_whatever_their_number(spark, monkeypatch):
    write, found = near.staged, {}
    for n in (64, 128, 256):
        texts, seen = templated(n, n), {}

        def staged(df, name, seen=seen):
            out = write(df, name)
            seen.setdefault(name, []).append(out.count() if name in ("prefixes", "dealt", "step-links") else 0)
            return out

        monkeypatch.setattr(near, "staged", staged)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in near.near_copies(docs, limit=8).collect()}
        want = {}
        for i, t in enumerate(texts):
            copy = i and "u" in t and t.split()[-1].split("x")[1] == texts[i - 1].split()[-1].split("x")[1]
            want[i] = i - 1 if copy or (i and jaccard(t, texts[i - 1]) >= 0.8) else i
        assert got == want
        found[n] = (len(seen["step-links"]), sum(seen["dealt"]), sum(seen.get("prefixes", [0])))
    steps, dealt, prefixes = zip(*found.values(), strict=True)
    assert "prefixes" in seen and max(steps) <= 3, found  # the larger buckets are dealt anew
    assert dealt[2] < 5 * dealt[0] and prefixes[2] < 5 * max(prefixes[0], n), found


def test_prefixes_meet_every_linked_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.choice(1 << 20, 400, replace=False).astype(np.uint32)
    sets = [np.unique(np.r_[base[: rng.integers(200, 400)], rng.integers(1 << 20, 1 << 30, rng.integers(0, 90))]).astype(np.uint32) for _ in range(60)]
    d = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, s binary")
    prefix = {}
    for r in near.by_prefix(d, 0.8).collect():
        prefix.setdefault(r.node, set()).add(r.h)
    linked = 0
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                assert prefix[i] & prefix[j]
    assert linked > 100
