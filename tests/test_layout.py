import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.operators import layout, raster

#: name: width, height, rectangles (x0, y0, x1, y1), number of regions, flag
PAGES = {
    "three": (900, 600, [(50, 20, 850, 160), (50, 220, 850, 360), (50, 420, 850, 560)], 3, "ok"),
    "single": (900, 600, [(40, 30, 860, 570)], 1, "single"),
    "blank": (400, 300, [], 1, "single"),
    "two": (900, 600, [(50, 40, 850, 260), (50, 340, 850, 560)], 2, "ok"),
    "side": (900, 600, [(20, 100, 420, 400), (480, 100, 880, 400)], 2, "ambiguous"),
    "fourteen": (900, 700, [(x, 20 + 100 * i, x + 400, 80 + 100 * i) for i in range(7) for x in (20, 480)], 1, "ambiguous"),
    "merged": (900, 2600, [(50, 200 * i + 10, 850, 200 * i + 170) for i in range(13)], 1, "single"),
    "small": (120, 90, [(6, 3 + 30 * i, 112, 24 + 30 * i) for i in range(3)], 3, "ok"),
    "tiny": (9, 200, [(0, 0, 9, 200)], 1, "single"),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for name, (w, h, boxes, _, _) in PAGES.items():
        a = np.full((h, w), 255, np.uint8)
        for x0, y0, x1, y1 in boxes:
            a[y0:y1, x0:x1] = 40
        rows.append((name, w, h, bytearray(a.tobytes())))
    return spark.createDataFrame(rows, "page_key string, width int, height int, pixels binary")


@pytest.fixture(scope="module")
def runs(pages):
    return raster.pages_to_ink_runs(pages).cache()


def test_runs_cover_the_rectangles(runs):
    got = {r.page_key: r.n for r in runs.groupBy("page_key").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()}
    for name, (_, _, boxes, _, _) in PAGES.items():
        assert got.get(name, 0) == sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in boxes) or name in ("single", "tiny", "fourteen")


def test_regions_and_flags(pages, runs):
    found = {}
    for r in layout.detect_regions(runs, pages).orderBy("page_key", "ordinal").collect():
        found.setdefault(r.page_key, []).append(r)
    for name, (_, _, _, n, flag) in PAGES.items():
        assert (len(found[name]), {r.flag for r in found[name]}) == (n, {flag}), name
        assert [r.ordinal for r in found[name]] == list(range(1, n + 1))
    assert [r.y0 for r in found["three"]] == sorted(r.y0 for r in found["three"])
    assert tuple(found["single"][0])[2:6] == (0.0, 0.0, 1.0, 1.0)
    boxes = [tuple(round(v, 2) for v in (r.x0, r.x1)) for r in found["side"]]
    assert boxes == [(0.01, 0.48), (0.52, 0.99)]


def test_every_page_has_a_region_after_proposals(spark, pages, runs):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), v, strict=True))
    props = spark.createDataFrame([("side", [box(55.0, 10.0, 95.0, 90.0), box(5.0, 10.0, 45.0, 90.0)]), ("fourteen", [box(0.0, 0.0, 1.0, 1.0)]), ("two", [box(0.0, 0.0, 0.5, 0.5)] * 2)], "page_key string, boxes array<struct<x0: double, y0: double, x1: double, y1: double>>")
    got = {}
    for r in layout.region_ordinals(layout.resolve_page_regions(layout.detect_regions(runs, pages), props)).orderBy("page_key", "ordinal").collect():
        got.setdefault(r.page_key, []).append((r.x0, r.cheques_on_page, r.id))
    assert set(got) == set(PAGES)
    assert [x for x, _, _ in got["side"]] == [0.05, 0.55] and len(got["fourteen"]) == 1 and len(got["two"]) == 2 and got["side"][1][1:] == (2, "side:2")


def test_raster_helpers():
    a = np.full((10, 10), 255, np.uint8)
    a[:, :5] = 0
    assert raster.percentile(a, 95) == 255 and raster.gray_of(a.tobytes(), 10, 10).shape == (10, 10)
    rgba = np.stack([a, a, a, a], axis=2)
    assert (raster.gray_of(rgba.tobytes(), 10, 10) == a).all()
    y, x0, x1 = raster.runs_of(a)
    assert list(y) == list(range(10)) and set(x0) == {0} and set(x1) == {5}


def test_smoothing_widths(spark):
    rows = [("a", 10, 20, y, y % 7) for y in range(20)] + [("b", 10, 300, y, y % 11) for y in range(300)]
    d = spark.createDataFrame(rows, "page_key string, width int, height int, y int, ink long")
    got = {(r.page_key, r.y): r.smooth for r in layout.box_smooth(d, layout.smooth_window(F.col("height"))).collect()}
    b = [y % 11 for y in range(300)]
    for y in range(300):  # a window of 3: one on either side
        part = b[max(0, y - 1) : y + 2]
        assert abs(got["b", y] - sum(part) / len(part)) < 1e-12
    assert all(got["a", y] == y % 7 for y in range(20))


def test_crops_start_at_their_corner(spark):
    pages = spark.createDataFrame([("p", 10, 10)], "page_key string, width int, height int")
    runs = spark.createDataFrame([("p", y, 0, 5) for y in range(10)], "page_key string, y int, x0 int, x1 int")
    regions = spark.createDataFrame([("p", 1, 0.2, 0.5, 1.0, 1.0), ("p", 2, 0.0, 0.0, 1.0, 1.0)], "page_key string, ordinal int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r)[1:] for r in layout.crop_runs(runs, regions, pages).collect())
    assert got == [(1, y, 0, 3) for y in range(5)] + [(2, y, 0, 5) for y in range(10)]


def test_ties_keep_their_order(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    given = [(0.200, 0.101, 0.4, 0.3), (0.199, 0.104, 0.4, 0.3), (0.6, 0.1, 0.9, 0.3)]
    rows = spark.createDataFrame([("p", i, *b) for i, b in enumerate(given)], "page_key string, i int, x0 double, y0 double, x1 double, y1 double")
    assert [r.i for r in layout.order_regions(rows).orderBy("ordinal").collect()] == [0, 1, 2]  # 0 and 1 are equal to a hundredth
    single = spark.createDataFrame([("p", 1, 0.0, 0.0, 1.0, 1.0, "ambiguous")], "page_key string, ordinal int, x0 double, y0 double, x1 double, y1 double, flag string")
    props = spark.createDataFrame([("p", [dict(zip(("x0", "y0", "x1", "y1"), b, strict=True)) for b in given])], f"page_key string, boxes array<{box}>")
    got = [(r.x0, r.y0) for r in layout.resolve_page_regions(single, props).orderBy("ordinal").collect()]
    assert got == [b[:2] for b in given]


def test_pages_without_a_size_or_pixels_have_no_runs(spark):
    rows = [("a", None, 3, bytearray(9)), ("b", 3, None, bytearray(9)), ("c", 3, 3, None), ("d", 3, 3, bytearray(5)), ("e", 0, 0, bytearray(0)), ("f", 3, 2, bytearray([255, 0, 255] * 2)), ("g", 2, 1, bytearray([0, 9, 255, 9]))]
    got = raster.pages_to_ink_runs(spark.createDataFrame(rows, "page_key string, width int, height int, pixels binary")).collect()
    assert sorted((r.page_key, r.y, r.x0, r.x1) for r in got) == [("f", 0, 1, 2), ("f", 1, 1, 2), ("g", 0, 0, 1)]


def test_bands_are_those_of_the_single_steps(spark, pages, runs):
    profile = layout.row_profile(runs, pages)
    assert profile.count() == sum(h for _, h, _, _, _ in PAGES.values())
    smooth = layout.box_smooth(profile, layout.smooth_window(F.col("height"))).withColumn("share", F.col("smooth") / F.col("width"))
    steps = layout.merge_runs(layout.bool_runs(layout.page_max_threshold(smooth, "share", layout.PAGE).filter("on"), layout.PAGE), layout.PAGE, F.greatest(F.lit(2), F.floor(F.col("height") * 0.012)))
    tall = F.col("end") - F.col("start") >= F.greatest(F.lit(4), F.floor(F.col("height") * 0.06))
    want = sorted((r.page_key, r.start, r.end) for r in steps.filter(tall).collect())
    assert sorted((r.page_key, r.y0, r.y1) for r in layout.bands(runs, pages).collect()) == want and len(want) > 10


def test_repeated_lines_are_looked_into_once(monkeypatch):
    rng, looked, gray_of = np.random.default_rng(5), [], raster.gray_of
    monkeypatch.setattr(raster, "gray_of", lambda pixels, width, height: looked.append(height) or gray_of(pixels, width, height))
    for depth in (1, 2, 3, 4):
        few = rng.choice([40, 150, 230, 255], (5, 31 * depth)).astype(np.uint8)
        for lines in (few[np.sort(rng.integers(0, 5, 200))], few[rng.integers(0, 5, 200)], rng.integers(0, 256, (40, 31 * depth)).astype(np.uint8), few[:1]):
            got, want = raster.page_runs(lines.tobytes() + b"x", 31, len(lines)), raster.runs_of(gray_of(lines.tobytes(), 31, len(lines)))
            assert [list(c) for c in got] == [list(c) for c in want]
    assert looked[::4] == [5] * 4 and looked[2::4] == [40] * 4 and looked[3::4] == [1] * 4
