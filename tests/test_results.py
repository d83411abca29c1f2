import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.operators import layout, raster, results
from draftmill.sources import manifest

PLACE = "pdf_id string, page_index int, cheque_on_page int"


@pytest.fixture
def spread(spark):
    """Small tables stay in as many partitions as there are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    kept = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield spark
    spark.conf.set(key, kept)


def test_a_file_with_most_rows_is_ranked_by_many_tasks(spread, monkeypatch):
    kept, write = [], results.written
    monkeypatch.setattr(results, "written", lambda df, name: kept.append(write(df, name)) or kept[-1])
    rows = [("big", i // 3, i % 3 + 1) for i in range(3000)] + [(f"d{i % 40}", i // 40, 1) for i in range(1500)] + [(None, 0, 1), ("a", None, 1)]
    random.Random(1).shuffle(rows)
    ranked = results.display_rank(spread.createDataFrame(rows, PLACE).repartition(6))
    got = ranked.orderBy("rank").collect()
    key = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1)) and [tuple(r)[:3] for r in got] == sorted(rows, key=key)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window [row_number" not in plan
    assert kept[0].filter("pdf_id = 'big'").select(F.shiftright("_at", 33)).distinct().count() >= 4


def test_numbers_of_ties_and_of_no_rows(spread):
    d = spread.createDataFrame([("x", 1)] * 50 + [("w", 1)], "a string, b int")
    got = results.numbered(d, "n", F.col("a"), F.col("b")).collect()
    assert sorted(r.n for r in got) == list(range(1, 52)) and {r.a for r in got if r.n == 1} == {"w"}
    assert results.numbered(d.limit(0), "n", F.col("a")).count() == 0


def test_order_by_collation(spark):
    names = ["zeta", "Étude", "etude", "Zeta", "Etude", "étude"]
    d = spark.createDataFrame([(n, 0, 1) for n in names], PLACE)
    assert [r.pdf_id for r in results.order_results(d).collect()] == sorted(names)
    assert [r.pdf_id for r in results.order_results(d, "UNICODE").collect()] == ["etude", "Etude", "étude", "Étude", "zeta", "Zeta"]
    assert [r.pdf_id for r in results.display_rank(d, "UNICODE").orderBy("rank").collect()] == ["etude", "Etude", "étude", "Étude", "zeta", "Zeta"]


def test_export_in_several_files_comes_back_in_order(spark, tmp_path):
    names = [c for _, c in results.CSV_FIELDS if c not in ("page_index", "cheque_on_page")]
    rows = spark.range(200).select(F.format_string("d%02d", F.col("id") % 7).alias("pdf_id"), F.col("id").cast("int").alias("page_index"), F.lit(1).alias("cheque_on_page"), *[F.lit(c).alias(c) for c in names], F.array().cast("array<struct<field: string, severity: string, reason: string>>").alias("flags"))
    results.export_csv(rows, f"{tmp_path}/csv", 5)
    files = sorted((tmp_path / "csv").glob("part-*"))
    assert len(files) == 5 and files[0].read_bytes().startswith(b"\xef\xbb\xbfsourceFile,") and not any(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in files[1:])
    want = [x for f in files for x in f.read_text(encoding="utf-8-sig").splitlines()]
    back = results.read_export(spark, f"{tmp_path}/csv").orderBy("n").collect()
    assert [r.line for r in back] == want and [r.n for r in back] == list(range(1, 202)) and len({r.part for r in back}) == 5
    order = [tuple(r) for r in rows.select(*results.ORDER).collect()]
    assert [x.split(",")[1] for x in want[1:]] == [str(p) for _, p, _ in sorted(order)]


def test_crops_are_compared_in_proportion_to_what_they_hit(spark):
    """Pages with many regions, one above the other, and one that is wide: a run meets those near its own scan line."""
    size = [(p, 100, 960) for p in range(3)]
    regions = [(p, i, 0.0, i / 24, 1.0, (i + 1) / 24) for p in range(2) for i in range(24)] + [(2, 1, 0.0, 0.0, 1.0, 1.0)]
    runs = [(p, y, x, x + 10) for p in range(3) for y in range(960) for x in (5, 50)]
    d = spark.createDataFrame(regions, "page_key int, ordinal int, x0 double, y0 double, x1 double, y1 double")
    r, pages = spark.createDataFrame(runs, "page_key int, y int, x0 int, x1 int"), spark.createDataFrame(size, "page_key int, width int, height int")
    hits = layout.crop_runs(r, d, pages)
    n = hits.count()
    assert n == len(runs)  # the regions tile their pages
    assert layout._met(r, d, pages, layout.MEETING).count() < 2.5 * n
    for band in (1, 7, 5000):
        assert sorted(map(tuple, layout.crop_runs(r, d, pages, band).collect())) == sorted(map(tuple, hits.collect()))
    plain = {(p, o, y - int(y0 * 960 + 0.5), a, b) for p, o, _, y0, _, y1 in regions for q, y, a, b in runs if p == q and int(y0 * 960 + 0.5) <= y < int(y1 * 960 + 0.5)}
    assert set(map(tuple, hits.collect())) == plain


def test_colours_count_by_luma_against_the_ground_of_the_page():
    ground, ink, stain = (230, 224, 210), (200, 160, 150), (215, 190, 185)
    for depth in (3, 4):
        a = np.zeros((20, 30, depth), np.uint8)
        a[:, :, :3] = ground
        a[5:8, 4:12, :3] = ink
        a[12, 3:9, :3] = stain
        y, x0, x1 = raster.runs_of(raster.gray_of(a.tobytes(), 30, 20))
        assert list(zip(y, x0, x1, strict=True)) == [(5, 4, 12), (6, 4, 12), (7, 4, 12)]


def test_the_manifest_opens_no_file(spark, tmp_path):
    for name in ("a.pdf", "b.txt"):
        (tmp_path / name).write_bytes(b"123")
    found = manifest.pdf_manifest(spark, str(tmp_path))
    assert [(r.source_file, r.size) for r in found.collect()] == [("a.pdf", 3)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    assert manifest.pdf_manifest(spark, str(tmp_path)).columns == ["pdf_id", "source_file", "size", "modified_ms"]
