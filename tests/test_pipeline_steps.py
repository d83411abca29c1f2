import time

import pytest
from pyspark.sql import functions as F

from draftmill.functions.tables import RAW, RESULT
from draftmill.jobs import cheques
from draftmill.jobs.hooks import map_bounded
from draftmill.operators import choose, exemplars, results
from draftmill.operators.validate import validate_extraction, with_error_rows
from draftmill.sources import manifest, responses

READ = f"id string, pass int, model string, error string, {RAW}"
FLASH, PRO = "gemini-2.5-flash-lite", "gemini-2.5-pro"


def read(id_, numeric, words, value, date="01/01/2026", payer="ACME LLC", bank="CBQ", number="12345678", pass_=1, model=FLASH, error=None, conf=None):
    return (id_, pass_, model, error, numeric, words, value, None, date, payer, bank, number, None, conf)


READS = [
    read("good", "1000.00", "one thousand", 1000.0, bank="Qatar National Bank"),
    read("mismatch", "1000.00", "nine hundred", 900.0),
    read("handover", "50.00", "fifty", 50.0, date="", payer="X", bank="Doha Bank", number="123"),
    (("empty",) + (1, FLASH, None) + (None,) * 10),
    read("broken", "5", "five", 5.0, error="timeout"),
    read("unsure", "10", "ten", None, conf={"amount": 0.5, "payer": 0.2}),
]


@pytest.fixture(scope="module")
def valid(spark):
    return {r.id: r for r in with_error_rows(spark.createDataFrame(READS, READ)).collect()}


def reasons(r):
    return [(f.field, f.severity) for f in r.flags]


def test_validation_of_the_fixtures(valid):
    good, mismatch, hand, empty, broken, unsure = (valid[k] for k in ("good", "mismatch", "handover", "empty", "broken", "unsure"))
    assert (good.status, good.confidence, good.currency, good.amount_reconciled, good.amount, reasons(good)) == ("ok", 100, "QAR", True, "1000.00", [])
    assert (mismatch.status, mismatch.confidence, mismatch.amount, reasons(mismatch)) == ("review", 75, "900.00", [("amount", "high")])
    assert mismatch.flags[0].reason == "Digits (1000.00) and words (900.00) disagree"
    assert (hand.date, hand.status, hand.confidence, reasons(hand)) == ("HANDOVER PAYMENT", "review", 50, [("chequeNumber", "high")])
    assert hand.flags[0].reason == "Expected 8 digits, got 3"
    assert (empty.confidence, reasons(empty)) == (0, [("amount", "high"), ("chequeNumber", "high"), ("payer", "low"), ("bank", "low")])
    assert (broken.status, broken.error, broken.amount) == ("error", "timeout", "")
    assert reasons(unsure) == [("amount", "low"), ("payer", "low")] and unsure.amount_words_value == 10.0 and unsure.status == "ok"


def test_best_read_keeps_the_earlier_of_equals(spark):
    rows = [read("a", "5", "", 6.0), read("a", "6", "", 6.0, pass_=2, model=PRO), read("b", "1", "", 1.0), read("b", "1", "", 1.0, pass_=2, model=PRO), read("c", "1", "", 1.0), read("c", "x", "", None, pass_=2, model=PRO)]
    got = {r.id: r["pass"] for r in choose.pick_best_read(validate_extraction(spark.createDataFrame(rows, READ))).collect()}
    assert got == {"a": 2, "b": 1, "c": 1}


def test_a_failed_later_read_never_wins(spark):
    bad = read("a", "5", "nine hundred", 900.0, date="31/02/2020", number="1")
    rows = [bad, read("a", None, None, None, pass_=2, model=PRO, error="HTTP 500"), read("b", "1", "", 1.0, error="timeout")]
    got = {r.id: (r["pass"], r.status) for r in choose.pick_best_read(with_error_rows(spark.createDataFrame(rows, READ))).collect()}
    assert got == {"a": (1, "review"), "b": (1, "error")}
    votes = choose.majority_amount(with_error_rows(spark.createDataFrame([bad], READ)), spark.createDataFrame([read("a", "900", "", 900.0, pass_=3, error="x"), read("a", "900", "", 900.0, pass_=4)], READ))
    assert [(r.amount, r.votes) for r in votes.collect()] == [("900.00", 3)]


def test_the_job_asks_for_second_reads_and_votes_as_its_options_say(spark):
    rows = [read("a", "5", "", 6.0), read("a", "7", "", 7.0, pass_=2, model=PRO), read("b", "5", "", 6.0), read("b", "x", "", None, pass_=2, model=PRO, error="HTTP 500"), read("b", "6", "", 6.0, pass_=3), read("b", "9", "", 6.0, pass_=4), read("c", "1", "", 1.0), read("c", "2", "", 3.0, pass_=2, model=PRO)]
    place = {"pdf_id": F.lit("d"), "page_index": F.lit(0), "cheque_on_page": F.ascii("id")}
    d = spark.createDataFrame(rows, READ).withColumns(place)
    got = {r.id: (r.amount, r.status, r.model) for r in cheques.read_cheques(d).collect()}
    assert got == {"a": ("7.00", "ok", PRO), "b": ("6.00", "ok", PRO), "c": ("1.00", "ok", FLASH)}
    plain = {r.id: (r.amount, r.status) for r in cheques.read_cheques(d, cheques.Options(escalate=False, voting=False)).collect()}
    assert plain == {"a": ("6.00", "review"), "b": ("6.00", "review"), "c": ("1.00", "ok")}


def test_votes(spark):
    base = validate_extraction(spark.createDataFrame([read("a", "5", "", 6.0), read("b", "1", "", 2.0), read("c", "7", "", 8.0, number="1")], READ))
    extra = spark.createDataFrame([read("a", "6.00", "", 6.0, pass_=2), read("a", "9", "", 9.0, pass_=3), read("b", "1", "", 2.0, pass_=2), read("c", "8", "", 8.0, pass_=2), read("c", "7", "", 7.0, pass_=3)], READ)
    votes = choose.majority_amount(base, extra)
    assert {r.id: (r.amount, r.votes) for r in votes.collect()} == {"a": ("6.00", 3), "c": ("7.00", 3)}  # of 7 and 8, three each, 7 came first
    after = {r.id: r for r in choose.apply_vote(base, votes, PRO).collect()}
    assert (after["a"].status, after["a"].amount, after["a"].flags, after["a"].model, after["a"].amount_reconciled) == ("ok", "6.00", [], PRO, True)
    assert (after["b"].status, after["b"].amount, after["b"].model) == ("review", "2.00", PRO)
    assert (after["c"].status, reasons(after["c"])) == ("review", [("chequeNumber", "high")])


def test_escalation(spark):
    reads = validate_extraction(spark.createDataFrame([read("a", "5", "", 6.0), read("b", "5", "", 6.0), read("b", "5", "", 6.0, pass_=2, model=PRO), read("c", "1", "", 1.0)], READ))
    assert [r.id for r in choose.escalation_worklist(choose.pick_best_read(reads), reads, PRO).collect()] == ["a"]
    d = spark.createDataFrame([(FLASH,), ("claude-haiku-4-5-20251001",)], "model string")
    assert [r.target for r in choose.escalation_target(d, PRO).collect()] == [PRO, "claude-opus-4-8"]
    assert [r.target for r in choose.escalation_target(d, "claude-sonnet-4-6").collect()] == [PRO, "claude-sonnet-4-6"]


CORR = "id string, amount string, currency string, date string, payer string, bank string, cheque_number string, seq long"


def test_corrections_and_exemplars(spark):
    rows = [("1", "10.00", "QAR", "2024-01-01", "p", "CBQ", "1", 1), ("1", "", "QAR", "", "", "", "", 2)] + [(str(i), f"{i % 4}.00", "QAR", "2024-01-01", "p", " CBQ ", "1", i) for i in range(3, 13)] + [("9", "7.00", "", "x", "p", "My Bank", "2", 20)]
    corr = spark.createDataFrame(rows, CORR)
    got = {}
    for r in exemplars.learn_exemplars(corr).orderBy("bank_key", "pos").collect():
        got.setdefault(r.bank_key, []).append((r.amount, r.seq))
    assert got == {"cbq": [("0.00", 12), ("3.00", 11), ("2.00", 10)], "my bank": [("7.00", 20)]}
    hints = {r.bank: r.hint for r in exemplars.build_hints(spark.createDataFrame([("CBQ",), ("My Bank",), ("Else",), ("HSBC",)], "bank string"), exemplars.learn_exemplars(corr)).collect()}
    assert hints["CBQ"].count("  - amount=") == 2 and hints["CBQ"].startswith("Bank-specific guidance for Commercial Bank") and "\n\nRecently" in hints["CBQ"]
    assert hints["My Bank"].startswith("Recently") and hints["Else"] is None and "  - " not in hints["HSBC"]
    res = spark.createDataFrame([("1", "d:0", 0, 1, "5.00", "QAR", "d", "p", "b", "n", False, "review", [("amount", "high", "r")], 75), ("zz", "d:0", 0, 2, "5.00", "QAR", "d", "p", "b", "n", False, "review", [("amount", "high", "r")], 75)], "id string, pdf_id string, page_index int, cheque_on_page int, amount string, currency string, date string, payer string, bank string, cheque_number string, reviewed boolean, status string, flags array<struct<field: string, severity: string, reason: string>>, confidence int")
    out = {r.id: r for r in results.apply_corrections(res, corr).collect()}
    assert (out["1"].amount, out["1"].status, out["1"].flags, out["1"].reviewed, out["1"].confidence) == ("", "ok", [], True, 75)
    assert (out["zz"].amount, out["zz"].status, out["zz"].reviewed) == ("5.00", "review", False)


def test_results_table(spark, tmp_path):
    v = choose.result_rows(with_error_rows(spark.createDataFrame(READS, READ)).withColumns({"pdf_id": F.lit("d"), "page_index": F.lit(0), "cheque_on_page": F.length("id")}))
    r = v.withColumns({"source_file": F.lit('a,"b".pdf'), "cheques_on_page": F.lit(6)})
    s = results.summary(r).first()
    assert (s.total, s.ok, s.review, s.error, s.avg_confidence) == (6, 2, 3, 1, 54)
    assert tuple(results.summary(r.limit(0)).first()) == (0, 0, 0, 0, 0)
    results.export_csv(r, f"{tmp_path}/csv")
    lines = [x for p in sorted((tmp_path / "csv").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(lines) == 7 and lines[0].startswith("\ufeffsourceFile,pageIndex") and any('"a,""b"".pdf",0,4,6,1000.00,QAR,true' in x for x in lines)
    results.save_results(r, f"{tmp_path}/t")
    assert results.load_results(spark, f"{tmp_path}/t").count() == 6
    none = results.load_results(spark, f"{tmp_path}/none")
    assert none.count() == 0 and len(none.columns) == len(RESULT.split(": ")) * 0 + 25
    first = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    more = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "id string, v int, seq int")
    assert sorted(map(tuple, results.upsert(first, more, "id", "seq").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    ranked = spark.createDataFrame([(f"d{i % 5}", i // 5, 1) for i in range(50)], "pdf_id string, page_index int, cheque_on_page int")
    rows = results.display_rank(ranked).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, 51)) and [(r.pdf_id, r.page_index) for r in rows] == sorted((r.pdf_id, r.page_index) for r in rows)
    crops = results.attach_crops(spark.createDataFrame([("a", "own"), ("b", None), ("c", None)], "id string, crop_ref string"), spark.createDataFrame([("a", "s"), ("b", "s")], "id string, crop string"))
    assert {r.id: r.crop for r in crops.collect()} == {"a": "own", "b": "s", "c": None}


def test_responses(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"amount_numeric": "5", "field_confidence": {"amount": 0.5}}\n{bad\n{"amount_numeric": "6", "amount_words_value": "x"}\n')
    got = [(r.amount_numeric, r.amount_words_value, r.error) for r in responses.read_raw(spark, f"{tmp_path}/r.json").collect()]
    assert got == [("5", None, None), (None, None, "Invalid JSON"), ("6", None, None)]
    d = spark.createDataFrame([("", FLASH), ("x", "gpt"), ("x", PRO), (None, PRO)], "image string, model string")
    assert [r.error is None for r in responses.validate_requests(d).collect()] == [False, False, True, False]
    a = spark.createDataFrame([(1, 0, 429, False, 1), (1, 1, 200, True, 2), (2, 2, 503, False, 1), (3, 4, 503, False, 1), (4, 0, 400, False, 1), (5, 1, 200, False, 1)], "request_id int, attempt int, http_status int, has_payload boolean, seq long")
    assert {r.request_id: (r.action, r.wait_ms) for r in responses.retry_plan(a).collect()} == {1: ("done", None), 2: ("retry", 6000), 3: ("fail", None), 4: ("fail", None), 5: ("retry", 3000)}
    p = responses.build_requests(spark.createDataFrame([("extract", " h "), ("regions", " ")], "mode string, hint string")).collect()
    assert p[0].prompt.endswith("per field.\n\nh") and p[1].prompt.endswith("[0,0,1,1].")


def test_manifest_and_geometry(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/B b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    rows = manifest.pdf_manifest(spark, str(tmp_path)).collect()
    assert sorted(r.source_file for r in rows) == ["B b.PDF", "a.pdf"] and all(r.pdf_id == f"{r.source_file}:5:{r.modified_ms}" for r in rows)
    g = manifest.page_geometry(spark.createDataFrame([(600, 800, 0), (800, 600, 90), (600, 700, 0)], "width int, height int, rotate int"), 1500).collect()
    assert [(r.rotation, r.out_width, r.out_height) for r in g] == [(90, 1500, 1125), (90, 1125, 1500), (0, 1286, 1500)]


def test_bounded_map_keeps_order_and_bound(spark, tmp_path):
    def double(row):
        import os
        import threading

        mark = f"{tmp_path}/{threading.get_ident()}-{row['x']}"
        open(mark, "w").close()
        time.sleep(0.05)
        n = len(os.listdir(tmp_path))
        os.remove(mark)
        return {"x": row["x"] * 2, "n": n}

    got = map_bounded(spark.createDataFrame([(i,) for i in range(1, 8)], "x int").coalesce(1), double, 3, "x int, n int").collect()
    assert [r.x for r in got] == [2, 4, 6, 8, 10, 12, 14] and max(r.n for r in got) <= 3


def test_bounded_map_keeps_types(spark):
    rows = [(1, None), (None, "x"), (2**60 + 1, "y")]
    got = map_bounded(spark.createDataFrame(rows, "n long, s string").coalesce(1), lambda r: {"n": r["n"], "kind": type(r["n"]).__name__}, 2, "n long, kind string").collect()
    assert [tuple(r) for r in got] == [(1, "int"), (None, "NoneType"), (2**60 + 1, "int")]
