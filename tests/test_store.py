import random
from pathlib import Path

import pytest

from draftmill.functions.shared import delete
from draftmill.operators import crops
from draftmill.streaming.store import KeyedTable, Segment

KIND = "id string, v int, pad string"


def rows(spark, items):
    return spark.createDataFrame([(k, v, f"{k} {v} " * 20) for k, v in items], KIND).coalesce(1)


def held(table):
    found = table.read()
    return None if found is None else {r.id: r.v for r in found.select("id", "v").collect()}


@pytest.mark.parametrize("seed", range(2))
def test_puts_and_deletes_against_a_dict(spark, tmp_path, seed):
    rng, table, want = random.Random(seed), KeyedTable(spark, f"{tmp_path}/t"), {}
    for step in range(12):
        keys = [f"k{rng.randrange(12)}" for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.35:
            table.delete(rows(spark, [(k, 0) for k in keys]))
            for k in keys:
                want.pop(k, None)
        else:
            put = {k: 100 * step + i for i, k in enumerate(keys)}
            table.put(rows(spark, list(put.items())))
            want |= put
        if step == 8:
            table.compact()
            assert len(table.live()) == 1
        assert (held(table) or {}) == want
    assert len(table.live()) < 6


def test_what_a_batch_writes_is_in_proportion_to_the_batch(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t")
    table.put(rows(spark, [(f"k{i}", i) for i in range(30_000)]))
    base = table.live()[0].size
    sizes = lambda: {p: p.stat().st_size for p in Path(f"{tmp_path}/t").rglob("part-*")}
    before, written = sizes(), []
    for batch in range(1, 9):
        table.put(rows(spark, [(f"k{(i * 7919 + batch) % 31_000}", -batch) for i in range(40)]))
        now = sizes()
        written.append(sum(n for p, n in now.items() if p not in before))
        before |= now
    assert max(written) < base / 20 and sum(written) < base / 8
    assert len(table.live()) <= 5 and table.live()[0].size == base  # the base was not rewritten
    got = held(table)
    want = {f"k{i}": i for i in range(30_000)}
    for batch in range(1, 9):
        want |= {f"k{(i * 7919 + batch) % 31_000}": -batch for i in range(40)}
    assert got == want


def test_a_large_batch_merges_what_is_smaller(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t")
    for _ in range(3):
        table.put(rows(spark, [("a", 1)]))
    table.put(rows(spark, [(f"k{i}", i) for i in range(2000)]))
    assert [s.first for s in table.live()] == [0]


def test_a_repeated_version_changes_nothing(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t")
    for version in range(4):
        table.put(rows(spark, [("a", version), (f"b{version}", version)]), version)
    want = held(table)
    for version in (3, 0, 2):
        table.put(rows(spark, [("a", 99), ("c", 99)]), version)
        assert held(table) == want == {"a": 3, "b0": 0, "b1": 1, "b2": 2, "b3": 3}


def test_unfinished_segments_are_passed_over_and_removed(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t")
    table.put(rows(spark, [(f"k{i}", i) for i in range(500)]))
    table.put(rows(spark, [("a", 1)]))
    broken = Path(f"{tmp_path}/t/{Segment(0, 1).name}")
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half")
    assert len(held(table)) == 501
    table.put(rows(spark, [("a", 2)]))
    assert held(table)["a"] == 2 and not broken.exists()


def test_readers_keep_their_segments_for_one_more_version(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t")
    table.put(rows(spark, [("a", 1)]))
    planned = table.read()
    table.put(rows(spark, [("a", 2)]))  # merges the two
    assert [r.v for r in planned.collect()] == [1] and len(table.live()) == 1 and len(table.complete()) == 3
    table.put(rows(spark, [("a", 3)]))
    assert held(table) == {"a": 3} and Segment(0, 0) not in [Segment(s.first, s.last) for s in table.complete()]


def test_seq_decides_whatever_the_order_of_arrival(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "id", ("v",))
    table.put(rows(spark, [("a", 5), ("a", 4), ("b", 1)]))
    table.delete(rows(spark, [("b", 7), ("c", 2)]))
    table.put(rows(spark, [("a", 3), ("b", 6), ("c", 1), ("d", 1), ("d", 1)]))
    table.compact()
    table.put(rows(spark, [("c", 2), ("b", 2), ("c", 0)]))
    assert held(table) == {"a": 5, "d": 1, "c": 2}


def test_odd_rows(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t")
    assert held(table) is None and table.delete(rows(spark, [("a", 1)])) == 0 and held(table) is None
    table.put(rows(spark, [(None, 1), ("", 2), ("x", 3)]))
    table.put(rows(spark, [("y", 1)]).limit(0))
    assert held(table) == {"": 2, "x": 3}
    table.delete(rows(spark, [("x", 0), ("x", 0), (None, 0), ("nobody", 0)]))
    assert held(table) == {"": 2}
    table.clear()
    assert held(table) is None
    table.put(rows(spark, [("z", 1)]))
    assert held(table) == {"z": 1}


def test_crop_store(spark, tmp_path):
    path, kind = f"{tmp_path}/crops", "id string, crop string"
    crop = lambda *items: spark.createDataFrame(list(items), kind)
    look = lambda: {r.id: r.crop for r in crops.load_crops(spark, path).collect()}
    assert look() == {}
    crops.save_crops(crop(("a", "1"), ("b", "2"), ("c", ""), (None, "x"), ("d", None)), path)
    crops.save_crops(crop(("a", "3"), ("b", "")), path)
    assert look() == {"a": "3", "b": "2"}
    crops.drop_crops(crop(("a", None), ("z", None)), path)
    assert look() == {"b": "2"}
    crops.save_crops(crop(("a", "4")), path)
    assert look() == {"a": "4", "b": "2"}
    crops.clear_crops(spark, path)
    assert look() == {}
    delete(spark, path)
