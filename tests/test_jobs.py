import json

from pyspark.sql import functions as F

from draftmill.functions.tables import EXTRACT_PROMPT, RAW
from draftmill.jobs import cheques
from draftmill.operators import results
from draftmill.operators.validate import VALIDATED, with_error_rows
from draftmill.sources import responses
from draftmill.streaming.store import KeyedTable

READ = f"id string, pass int, model string, error string, {RAW}"
FLASH, PRO, HAIKU = "gemini-2.5-flash-lite", "gemini-2.5-pro", "claude-haiku-4-5-20251001"
CORR = "id string, amount string, currency string, date string, payer string, bank string, cheque_number string, seq long"
LANDED = "id string, pdf_id string, page_index int, cheque_on_page int, pass int, attempt int, model string, http_status int, body string"


def read(id_, numeric, value, pass_=1, model=FLASH, error=None, bank="CBQ", number="12345678"):
    return (id_, pass_, model, error, numeric, "", value, None, "01/01/2026", "ACME", bank, number, None, None)


def placed(spark, rows):
    return spark.createDataFrame(rows, READ).withColumns({"pdf_id": F.lit("d"), "page_index": F.lit(0), "cheque_on_page": F.ascii("id")})


def test_two_samples_vote_and_no_more(spark):
    base = [read("a", "5", 6.0), read("a", "7", 8.0, 2, PRO)]
    rows = [*base, read("a", "9", 7.0, 3, PRO), read("a", "x", None, 4, PRO), read("a", "7", 7.0, 5, PRO)]
    first = {r.id: (r.amount, r.status) for r in cheques.read_cheques(placed(spark, rows)).collect()}
    assert first == {"a": ("6.00", "review")}  # the base's 5 and 6, with 9 and 7: no three agree
    more = {r.id: r.amount for r in cheques.read_cheques(placed(spark, rows), cheques.Options(samples=3)).collect()}
    assert more == {"a": "7.00"}  # with the fifth pass 7 has three of seven


def test_requests_carry_hints_when_asked_to(spark):
    rows = [read("a", "5", 6.0), read("b", "5", 5.0), read("c", "5", 6.0, bank="My Bank"), read("c", "5", 6.0, 2, PRO, bank="My Bank"), read("c", "5", 6.0, 3, PRO), read("d", "5", 6.0, model=PRO, bank="Nobody"), read("e", "1", 1.0, error="HTTP 500")]
    fixed = spark.createDataFrame([("x", "10.00", "QAR", "2024-01-01", "p", "CBQ", "1", 1), ("y", "9.00", "QAR", "2024-01-02", "p", "my bank", "2", 2)], CORR)
    ask = lambda **o: {(r.id, r["pass"]): r.prompt for r in cheques.request_reads(placed(spark, rows), fixed, cheques.Options(**o)).collect()}
    got = ask()
    assert set(got) == {("a", 2), ("c", 4), ("d", 3), ("d", 4)}
    assert got["a", 2].startswith(EXTRACT_PROMPT + "\n\nBank-specific guidance for Commercial Bank") and "amount=10.00" in got["a", 2]
    assert "guidance" not in got["c", 4] and "amount=9.00" in got["c", 4] and got["d", 3] == EXTRACT_PROMPT
    assert set(ask(few_shot=False).values()) == {EXTRACT_PROMPT} and "amount=" not in ask(examples=0)["a", 2]
    assert set(ask(escalate=False)) == {("a", 3), ("a", 4), ("c", 4), ("d", 3), ("d", 4)} and set(ask(voting=False)) == {("a", 2)} and ask(voting=False, escalate=False) == {}


def test_reads_of_responses(spark):
    fields = {"amount_numeric": "5", "amount_words_value": 5.0, "bank": "CBQ"}
    use = lambda name, given: json.dumps({"content": [{"type": "text"}, {"type": "tool_use", "name": name, "input": given}]})
    call = lambda text: json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"arguments": text}}]}}]})
    landed = [
        ("a", 1, 0, HAIKU, 529, None), ("a", 1, 1, HAIKU, 200, use("record_cheque", fields)), ("b", 1, 0, HAIKU, 200, use("other", fields)), ("c", 1, 0, FLASH, 200, call(json.dumps(fields))),
        ("d", 1, 0, FLASH, 200, call("{bad")), ("e", 1, 0, FLASH, 429, "busy"), ("f", 1, 0, HAIKU, None, None), ("g", 1, 0, FLASH, 200, '{"choices": [{"message": {"content": "```json\\n{\\"bank\\": \\"CBQ\\"}\\n```"}}]}'), ("h", 1, 0, FLASH, 200, None), ("i", 1, 0, HAIKU, 200, "not json"),
    ]
    d = spark.createDataFrame([(i, "d", 0, n, *rest) for n, (i, *rest) in enumerate(landed)], LANDED)
    reads = responses.reads_of(d)
    got = {r.id: (r.amount_numeric, r.bank, r.error) for r in reads.collect()}
    none = "Model returned no tool_use block"
    assert got == {
        "a": ("5", "CBQ", None), "b": (None, None, none), "c": ("5", "CBQ", None), "d": (None, None, "Could not parse model JSON"), "e": (None, None, "Gemini HTTP 429"), "f": (None, None, "Anthropic HTTP ?"),
        "g": (None, "CBQ", None), "h": (None, None, "Model returned no structured output"), "i": (None, None, none),
    }
    rows = {r.id: (r.amount, r.status) for r in cheques.read_responses(d).collect()}
    assert rows["a"] == ("5.00", "review") and {rows[k] for k in "bdefhi"} == {("", "error")} and len(rows) == 9


def test_stored_results_are_reviewed_in_proportion_to_the_corrections(spark, tmp_path):
    valid = with_error_rows(placed(spark, [read(f"{i:04}", "5", 6.0) for i in range(3000)]).withColumns({"cheque_on_page": F.col("id").cast("int"), "payer": F.sha2("id", 256)}))
    found = valid.select("id", "pdf_id", "page_index", "cheque_on_page", *VALIDATED, F.lit(False).alias("reviewed"), "model", "error").withColumns({"source_file": F.lit("d.pdf"), "cheques_on_page": F.lit(600)})
    table = KeyedTable(spark, f"{tmp_path}/t")
    table.put(found.coalesce(1))
    fixed = spark.createDataFrame([("0003", "7.00", "QAR", "2024-01-01", "p", "CBQ", "1", 1), ("0003", "8.00", "QAR", "2024-01-01", "p", "CBQ", "1", 2), ("nobody", "1.00", "", "", "", "", "", 3)], CORR)
    lines = {r.id: r.line for r in cheques.review_stored(spark, f"{tmp_path}/t", fixed).collect()}
    want = {r.id: r.line for r in results.csv_lines(results.apply_corrections(found, fixed)).collect()}
    assert lines == want and ",8.00,QAR," in lines["0003"] and len(lines) == 3000
    assert table.live()[-1].size < table.live()[0].size and spark.read.parquet(f"{tmp_path}/t/{table.live()[-1].name}").count() == 1


def test_requests_validate_each_read_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cheques, "with_error_rows", lambda d: seen.append(d) or with_error_rows(d))
    rows = [read("a", "5", 6.0), read("b", "5", 6.0), read("b", "5", 6.0, 2, PRO), read("b", "5", 7.0, 2, PRO), read("c", "5", 5.0)]
    fixed = spark.createDataFrame([], CORR)
    got = sorted((r.id, r["pass"]) for r in cheques.request_reads(placed(spark, rows), fixed).collect())
    assert got == [("a", 2), ("b", 3), ("b", 4)] and len(seen) == 2
    reads = [r for d in seen for r in d.select("id", "pass").collect()]
    assert sorted((r.id, r["pass"]) for r in reads) == [("a", 1), ("b", 1), ("b", 2), ("b", 2), ("c", 1)]
