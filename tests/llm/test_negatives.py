import numpy as np
import pytest

from draftmill.llm import negatives

KIND = "vec_id long, embedding array<float>, label int, rank string, slab int"


def brute(rows, every=100, positives=5, negatives_=10):
    """Anchors' hard negatives by their definitions, in Python's whole numbers."""
    clean = {}
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        v = tuple(int(np.floor(256 * float(np.float32(c)))) for c in x)
        clean[i] = min(clean.get(i, (label, v)), (label, v))
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in (i for i in clean if i % every == 0):
        label, v = clean[a]
        near = sorted((-score(v, w), i) for i, (other, w) in clean.items() if other == label and i != a)[:positives]
        far = sorted((-score(v, w), i) for i, (other, w) in clean.items() if other != label)
        for p, i in near:
            fits = [(n, j) for n, j in far if 30 * -p <= 100 * -n <= 90 * -p][:negatives_]
            out |= {(a, i, at, j, -p, -n) for at, (n, j) in enumerate(fits, 1)}
    return out


def got(spark, rows, **options):
    found = [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame([(*r, "x", 1)[:5] for r in rows], KIND), **options).collect()]
    assert len(set(found)) == len(found)
    return set(found)


def vectors(seed, n, d=16, labels=4, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    x = [(i, (centres[i % labels] * 0.6 + rng.normal(size=d)).tolist(), int(i % labels)) for i in range(n)]
    return x + [(n + i, x[3][1], int(rng.integers(labels))) for i in range(copies)]


@pytest.mark.parametrize("options", [{}, {"block": 3, "slab": 50, "per": 2}])
def test_against_brute_force(spark, options):
    rows = vectors(1, 700, copies=300)  # a vector that many rows share: ties of scores everywhere
    want = brute(rows, every=50)
    assert len(want) > 300
    assert got(spark, rows, every=50, **options) == want


def test_large_components_and_small_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * (1e4 if i % 3 else 1e-3)).tolist(), int(i % 2)) for i in range(120)]
    assert got(spark, rows, every=10) == brute(rows, every=10)
    with pytest.raises(Exception, match="62 bits"):
        got(spark, [(0, [3e38], 1), (1, [3e38], 1), (2, [3e38], 2)])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.1], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 1), (5, None, 1), (6, [0.1, None], 1), (7, [0.3, 0.3], None), (None, [0.3, 0.3], 2)]
    rows += [(8, [], 1), (9, [], 2), (100, [0.5], 3), (200, [], 2), (10, [-0.2, 0.4, 0.3], 2), (300, [0.0, 0.0], 1), (1, [0.1, 0.1], 7)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == set()
    assert got(spark, [(1, [0.5], 1)]) == set()
    assert got(spark, [(100, [0.5], 1)]) == set()


def test_every_plane_narrows_the_interval_and_no_pair_is_lost():
    rng = np.random.default_rng(3)
    a, v = rng.integers(-90, 90, (40, 24)), rng.integers(-90, 90, (300, 24))
    exact, wanted = a @ v.T, rng.random((40, 300)) < 0.8
    lo, hi = np.tile([[500, -9000]], (40, 1)), np.tile([[9000, -1]], (40, 1))
    q, r, score = negatives.qualifying(a, negatives.planes(v), wanted, lo, hi, np.full(lo.shape, negatives._LOW), 10)
    assert (exact[q, r] == score).all() and len(q) < wanted.sum() / 3
    for j in range(2):
        for i in range(40):
            right = sorted(exact[i][wanted[i] & (exact[i] >= lo[i, j]) & (exact[i] <= hi[i, j])], reverse=True)[:10]
            assert sorted(score[(q == i) & (score >= lo[i, j]) & (score <= hi[i, j])], reverse=True)[:10] == right
