from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from draftmill.functions import columns as C


def values(spark, f, *inputs, kind="string"):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in d.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_parse_amount(spark):
    given = {
        "1,234.56": 1234.56, "1.234,56": 1234.56, "١٢٣٤٫٥٦": 1234.56, "abc": None, "1,000": 1.0, "1,234,567": 1.234567, "QR. 500.00": None, "Rs.500": 0.5,
        "5-": None, "-5": -5.0, "5.": 5.0, "": None, None: None, "9" * 400: None, "1٬000": 1.0, "1.2.3": None, "12 345": 12345.0, "--5": None, ".": None, "0": 0.0,
    }
    assert values(spark, C.parse_amount, *given) == list(given.values())


def test_format_amount(spark):
    assert values(spark, C.format_amount, 1234.5, None, 0.0, float("nan"), float("inf"), kind="double") == ["1234.50", "", "0.00", "", ""]
    given = [1.005, 0.125, 1234.5, -1.005, -0.125, 2.675, 8.345, 0.005, 1e15, 35.855, 1.015, 1000000.005, 0.0049999999, 5e-324]
    want = [format(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP), "f").replace("-0.00", "0.00") for v in given]
    assert values(spark, C.format_amount, *given, kind="double") == want


def test_words_to_number(spark):
    given = {
        "one thousand two hundred thirty four and 50/100": 1234.5, "five hundred": 500.0, "qwerty": None, "zero thousand": 1000.0, "zero": 0.0, "hundred": 100.0,
        "Two Million, three-hundred": 2000300.0, "": None, None: None, "12 only": None, "constructor five": 5.0, "ninety nine riyals only": 99.0, "one billion": 1e9,
    }
    assert values(spark, C.words_to_number, *given) == list(given.values())


def test_parse_date(spark):
    given = {
        "25/12/2026": "2026-12-25", "2026-03-09": "2026-03-09", "31/02/2026": None, "12 mar 20261": "2001-03-12", "99-01-02": None, "1.2.69": "2069-02-01", "1.2.70": "1970-02-01",
        "Mar 12 2026": "2026-03-12", "12 xyz 2026": None, "": None, None: None, "٢٥/١٢/٢٠٢٦": "2026-12-25", " 5 June 2020 ": "2020-06-05", "29/02/2023": None, "29/02/2024": "2024-02-29", "2300-01-01": None,
    }
    assert values(spark, C.parse_date, *given) == list(given.values())


def test_cheque_number(spark):
    assert values(spark, C.normalize_cheque_number, "123456789012", "00 12 34 56 78", "abc", None, "١٢٣") == ["12345678", "00123456", "", "", "123"]


def test_trim_and_fences(spark):
    assert values(spark, C.trim_all, "\t a b ﻿\n", "", None, "　x") == ["a b", "", None, "x"]
    assert values(spark, C.strip_fences, '```json\n{"a": 1}\n```', "```JSON{}```", "{}", "```{}\n```\n") == ['{"a": 1}', "{}", "{}", "{}\n```"]


def test_banks(spark):
    names = ["Qatar National Bank", "CBQ", "Some Unlisted Bank", "Doha Bank", None, "Commercial Bank of Dubai", "Banca Romania"]
    assert values(spark, C.canonical_bank, *names) == ["qnb", "cbq", "", "doha", "", "cbq", ""]
    assert values(spark, C.infer_currency, *names) == ["QAR", "QAR", "", "QAR", "", "AED", "OMR"]
    assert "Doha Bank" in values(spark, C.bank_hint, "Doha Bank")[0] and values(spark, C.bank_hint, "x") == [None]
    rois = values(spark, C.rois_for_bank, "QNB", "x")
    assert [r.amount.y1 for r in rois] == [0.36, 0.38] and [r.amount.x0 for r in rois] == [0.58, 0.56] and rois[0].micr.y0 == 0.8


def test_models_and_labels(spark):
    assert values(spark, C.provider_of, "gemini-2.5-pro", "claude-opus-4-8") == ["google", "anthropic"]
    d = spark.createDataFrame([(0, 1, 3), (4, 1, 1)], "p int, k int, n int")
    assert [r.y for r in d.select(C.page_label(F.col("p"), F.col("k"), F.col("n")).alias("y")).collect()] == ["1·1/3", "p5"]


def test_regions(spark):
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    assert values(spark, C.is_full_page, (0.0, 0.0, 1.0, 1.0), (0.0005, 0.0, 0.9995, 1.0), (0.0, 0.0, 0.5, 1.0), kind=kind) == [True, True, False]
    px = values(spark, lambda r: C.region_to_pixels(r, F.lit(10), F.lit(10)), (0.0, 0.0, 0.5, 1.0), (0.99, 0.99, 0.99, 0.99), kind=kind)
    assert [tuple(p) for p in px] == [(0, 0, 5, 10), (9, 9, 10, 10)]


def test_flags(spark):
    flags = [("amount", "high", "a"), ("amount", "low", "b"), ("date", "high", 'c, "d"')]
    kind = "array<struct<field: string, severity: string, reason: string>>"
    assert values(spark, C.field_flags, flags, [], kind=kind) == [{"amount": "b", "date": 'c, "d"'}, {}]
    assert values(spark, C.flags_text, flags, [], kind=kind) == ['amount:high:a | amount:low:b | date:high:c, "d"', ""]
    assert values(spark, C.csv_cell, 'a,"b"', None, "a\rb", "a\nb") == ['"a,""b"""', "", "a\rb", '"a\nb"']


@pytest.mark.parametrize("box, want", [((10.0, 20.0, 90.0, 80.0), (0.1, 0.2, 0.9, 0.8)), ((0.9, 0.8, 0.1, 0.2), (0.1, 0.2, 0.9, 0.8)), ((0.1, 0.1, 0.14, 0.9), None), ((None, 0.1, 0.9, 0.9), None), ((-0.5, 0.0, 1.4, 1.0), (0.0, 0.0, 1.0, 1.0))])
def test_proposals(spark, box, want):
    got = values(spark, C.normalize_proposals, [box], kind="array<struct<x0: double, y0: double, x1: double, y1: double>>")[0]
    assert [tuple(round(v, 9) for v in g) for g in got] == ([want] if want else [])
