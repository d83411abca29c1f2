import json

from draftmill.operators.exemplars import learn_exemplars
from draftmill.operators.results import keep_last
from draftmill.operators.validate import with_error_rows
from draftmill.streaming import streams

CORR = "id string, amount string, currency string, date string, payer string, bank string, cheque_number string, seq long"


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_validated_stream_equals_batch_and_cut_lines_become_errors(spark, tmp_path):
    put(tmp_path / "in", "1.json", [{"id": "a", "pass": 1, "amount_numeric": "5", "amount_words": "five"}, {"id": "b", "pass": 1, "error": "x"}, {"id": "n", "amount_words_value": "not a number"}])
    put(tmp_path / "in", "2.json", [{"id": "c", "pass": 2, "field_confidence": {"amount": 0.5}}])
    whole = spark.read.schema(streams.READ).json(f"{tmp_path}/in").filter("id <> 'n'")
    (tmp_path / "in" / "3.json").write_text('{"id": "d", "pass": 1\n\n[1, 2]\n7\n   \n{"id": "e", "pass": 1}\nnull')
    batches = []
    out = streams.stream_validate(streams.raw_stream(spark, f"{tmp_path}/in", 1))
    run(out.writeStream.foreachBatch(lambda b, i: batches.append(b.collect())).outputMode("append"))
    assert len(batches) == 3
    rows = [r for b in batches for r in b]
    e = spark.createDataFrame([("e", 1)], "id string, pass int")
    want = with_error_rows(whole.unionByName(e, allowMissingColumns=True))
    by_id = {r.id: r for r in rows if r.id}
    assert set(by_id) == {"a", "b", "c", "e", "n"} and by_id["n"].error is None
    for r in want.select(*out.columns).collect():
        assert by_id[r.id] == r
    bad = [r for r in rows if r.id is None]
    assert len(bad) == 4 and {(r.error, r.status) for r in bad} == {("Invalid JSON", "error")}


def test_upserted_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    source, table = tmp_path / "in", f"{tmp_path}/table"
    kind = "id string, v int, seq long"
    assert streams.read_table(spark, table) is None
    for i in range(3):
        put(source, f"{i}.json", [{"id": f"k{j % 7}", "v": 10 * i + j, "seq": 100 * i + j} for j in range(10)])
        run(streams.stream_upsert(spark.readStream.schema(kind).json(str(source)), table, f"{tmp_path}/cp"))
    want = sorted(map(tuple, keep_last(spark.read.schema(kind).json(str(source)), "id", "seq").select("id", "v").collect()))
    assert sorted(map(tuple, streams.read_table(spark, table).select("id", "v").collect())) == want
    last = spark.read.schema(kind).json(f"{source}/2.json")
    streams.upsert_batch(last, 2, table, "id", ("seq",))
    assert sorted(map(tuple, streams.read_table(spark, table).select("id", "v").collect())) == want


def test_progress_stream_in_update_mode_by_file(spark, tmp_path):
    source, table = tmp_path / "in", f"{tmp_path}/table"
    batches = [[("a", 2), ("b", 1), ("a", 3)], [("b", 4)], [("c", 1), ("a", 1)]]
    changed = []
    for i, rows in enumerate(batches):
        put(source, f"{i}.json", [{"file": f, "cheques": n} for f, n in rows])
        running = streams.stream_progress(spark.readStream.schema("file string, cheques int").json(str(source)))

        def sink(batch, number):
            changed.append({r.file for r in batch.collect()})
            streams.upsert_batch(batch, number, table, "file", ())
            streams.upsert_batch(batch, number, table, "file", ())  # a batch that comes twice

        run(running.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp"))
    assert changed == [{"a", "b"}, {"b"}, {"a", "c"}]  # only what a batch changed is handed on
    assert sorted(map(tuple, streams.read_table(spark, table, "file", ()).collect())) == [("a", 3, 6), ("b", 2, 5), ("c", 1, 1)]


def test_exemplar_stream_equals_batch_whatever_the_order(spark, tmp_path):
    source, table = tmp_path / "in", f"{tmp_path}/table"
    name = ("id", "amount", "currency", "date", "payer", "bank", "cheque_number", "seq")
    rows = [dict(zip(name, (str(i), f"{i * 7 % 11}.00", "QAR", None if i % 4 == 0 else f"2024-01-0{i % 3 + 1}", "p", ("CBQ", "CBQ", "My Bank", "", "CBQ")[i % 5], "1", i * 37 % 100), strict=True)) for i in range(60)]
    rows += [dict(rows[0], amount=""), dict(rows[1], amount=None)]
    for i in range(4):
        put(source, f"{i}.json", rows[i::4])
        out = streams.stream_exemplars(spark.readStream.schema(CORR).json(str(source)), salts=3)
        run(streams.stream_upsert(out, table, f"{tmp_path}/cp", "slot", (), "update"))
        landed = spark.read.schema(CORR).json(str(source))
        got = streams.exemplars_of(streams.read_table(spark, table, "slot", ()))
        assert sorted(map(str, got.collect())) == sorted(map(str, learn_exemplars(landed).select(*got.columns).collect()))
    # The bank with most rows is held by several keys, each with a few entries.
    slots = streams.read_table(spark, table, "slot", ()).filter("bank_key = 'cbq'").collect()
    assert {r.slot.split(":")[0] for r in slots} == {"0", "1", "2"} and len(slots) <= 9


def test_upserted_results_come_in_the_order_of_display(spark, tmp_path):
    table, kind = f"{tmp_path}/table", "id string, pdf_id string, page_index int, cheque_on_page int, seq long"
    rows = [(f"k{i}", f"d{i % 3}", i, 1, i) for i in range(40)]
    streams.upsert_batch(spark.createDataFrame(rows, kind), 0, table)
    for batch in (1, 2, 3):
        streams.upsert_batch(spark.createDataFrame([("k5", "d2", 5, 1, 100 + batch)], kind), batch, table)
    streams.upsert_batch(spark.createDataFrame([], kind), 4, table)
    got = streams.read_table(spark, table).collect()
    assert len(got) == 40 and [(r.pdf_id, r.page_index) for r in got] == sorted((r.pdf_id, r.page_index) for r in got)
    assert {r.seq for r in got if r.id == "k5"} == {103}
