import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.jobs.queries import QUERIES
from draftmill.operators import layout, lines

SMALL = "/root/testdata/sf0.001"
RUN, PAGE = "page_key string, y int, y1 int, x0 int, x1 int", "page_key string, width int, height int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def drawn(spark):
    """pages, runs that span lines, and the same line by line."""
    rng, sizes, runs = np.random.default_rng(3), [], []
    for k in range(60):
        w, h = int(rng.integers(20, 400)), int(rng.choice([1, 3, 40, 90, 200, 700]))
        sizes.append((f"p{k}", w, h))
        y = 0
        while k % 12 and y < h:  # every twelfth page is blank
            y += int(rng.integers(0, 1 + h // 8))
            y1 = min(h, y + int(rng.integers(1, 2 + h // 6)))
            cut = sorted(int(x) for x in rng.choice(w + 1, 4, replace=False))
            runs += [(f"p{k}", y, y1, a, b) for a, b in (cut[:2], cut[2:]) if y < y1]
            y = y1
    runs = spark.createDataFrame(runs, RUN).cache()
    return spark.createDataFrame(sizes, PAGE).cache(), runs, runs.select("page_key", F.explode(F.sequence("y", F.col("y1") - 1)).alias("y"), "x0", "x1").cache()


def smooth_of(drawn):
    pages, _, single = drawn
    return layout.box_smooth(layout.row_profile(single, pages), layout.smooth_window(F.col("height")))


def lit_of(drawn):
    return layout.page_max_threshold(smooth_of(drawn).withColumn("share", F.col("smooth") / F.col("width")), "share", layout.PAGE)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def same(make, want, drawn):
    pages, spanning, single = drawn
    assert rows(make(spanning, pages), *want.columns) == rows(make(single, pages), *want.columns) == rows(want, *want.columns) and want.count() > 60
    assert "Window" not in plan(make(spanning, pages))


def test_boxes_are_those_of_the_single_steps(drawn):
    pages, _, single = drawn
    names = ("page_key", "y0", "y1", "x0", "x1", "odd")
    want = layout.split_band_columns(layout.band_column_profile(single, layout.bands(single, pages)))
    want = want.select("page_key", F.col("band_y0").alias("y0"), F.col("band_y1").alias("y1"), "x0", "x1", F.col("ambiguous").alias("odd"))
    same(lambda r, p: lines.page_boxes(r, p).select("page_key", F.inline("boxes")).select(*names), want, drawn)


def test_every_page_has_a_region_whatever_its_size(spark, drawn):
    pages, spanning, _ = drawn
    odd = pages.union(spark.createDataFrame([("none", None, None), ("flat", 50, 0), ("thin", 0, 50)], PAGE))
    more = spanning.union(spark.createDataFrame([("none", 0, 3, 0, 3), ("thin", 0, 50, 0, 0), ("flat", 0, 3, 0, 9), ("p0", -5, -2, 0, 9), ("nobody", 0, 1, 0, 1)], RUN))
    found = layout.detect_regions(more, odd)
    assert {r.page_key for r in found.collect()} == {r.page_key for r in odd.collect()}
    assert {r.flag for r in found.filter("page_key in ('none', 'flat', 'thin')").collect()} == {"single"}


def test_many_slices_of_a_batch_are_as_one(monkeypatch, drawn):
    import pyarrow as pa

    table = pa.table({"page_key": ["a", "b", "c"], "width": [9, 9, 9], "height": [20, 30, 10], "own": [[{"y": i, "y1": i + 4, "x0": 0, "x1": 5}] for i in (3, 8, 2)]}).to_batches()[0]
    one = lines.Lines(table).bands()
    parts = [lines.Lines(table.slice(i, 1)).bands() for i in range(3)]
    assert [list(np.concatenate([p[j] for p in parts])) for j in (1, 2)] == [list(c) for c in one[1:]]


def test_smooth_lines_are_not_sorted(drawn):
    same(lines.smooth_lines, smooth_of(drawn).select("page_key", "y", "smooth"), drawn)


def test_lit_lines_are_not_sorted(drawn):
    same(lines.lit_lines, lit_of(drawn).select("page_key", "y", F.col("on").alias("lit")), drawn)


def test_merged_runs_are_not_sorted(drawn):
    runs = layout.bool_runs(lit_of(drawn).filter("on"), layout.PAGE)
    same(lines.lit_runs, layout.merge_runs(runs, layout.PAGE, F.greatest(F.lit(2), F.floor(F.col("height") * 0.012))).select("page_key", "start", "end"), drawn)


def test_runs_of_lit_lines_are_not_sorted(drawn):
    same(lambda r, p: lines.lit_runs(r, p, merge=False), layout.bool_runs(lit_of(drawn).filter("on"), layout.PAGE).select("page_key", "start", "end"), drawn)


def test_crops_of_runs_that_span_lines(drawn):
    pages, spanning, single = drawn
    regions = layout.detect_regions(spanning, pages).withColumn("y1", F.col("y1") * 0.9)
    names = ("page_key", "ordinal", "y", "x0", "x1")
    assert rows(layout.crop_runs(spanning, regions, pages), *names) == rows(layout.crop_runs(single, regions, pages, 7), *names) != []


@pytest.mark.parametrize(("name", "windows"), [("j10_resolve_page_regions", 0), ("job_find_cheques", 1), ("p3_is_full_page", 0), ("p4_region_to_pixels", 0)])
def test_regions_are_found_without_windows_over_lines(spark, name, windows):
    assert plan(QUERIES[name](spark, SMALL)).split("Initial Plan")[0].count("Window ") == windows
