"""Column functions: pure expressions over one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BANK_AMOUNT, BANKS, CURRENCY_HINTS, DEFAULT_ROIS, EASTERN, MAGNITUDES, MONTHS, SMALL, WESTERN

#: White space as trimming means it: all Unicode white space, the no-break space and the byte-order mark.
_SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + _SPACE, ""), _SPACE + r"\z", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_western_digits(c: Column) -> Column:
    return F.translate(c, EASTERN, WESTERN)


def amount_chars(c: Column) -> Column:
    """What may belong to a number in a written amount."""
    return F.regexp_replace(to_western_digits(c), "[^0-9.,-]", "")


def plain_number(s: Column) -> Column:
    """amount_chars with a dot as the decimal mark and no other marks: of comma and dot the one that comes last is the decimal mark."""
    bare = F.replace(s, F.lit("."), F.lit(""))
    with_dot = F.concat(F.substring_index(bare, ",", 1), F.lit("."), F.replace(F.substring(bare, F.instr(bare, ",") + 1, F.length(bare)), F.lit(","), F.lit("")))
    return F.when(s.rlike(r",[^.]*\z"), with_dot).otherwise(F.replace(s, F.lit(","), F.lit("")))


def number_value(plain: Column) -> Column:
    n = F.when(plain.rlike(r"\A-?([0-9]+\.?[0-9]*|\.[0-9]+)\z"), plain.try_cast("double"))
    return F.nullif(F.nullif(n, F.lit(float("inf"))), F.lit(float("-inf")))


def parse_amount(c: Column) -> Column:
    """A written amount as a double. Null if it is no number."""
    return let(amount_chars(c), lambda s: let(plain_number(s), number_value))


def format_amount(c: Column) -> Column:
    """Two decimals of the double's exact binary value, ties away from zero; empty for null. Java's format goes by the shortest decimal form; the two
    differ only where that form ends in a 5 in the third place. There a double's fraction, a whole number of 2 ** -60, is held against the tie."""
    return let(c, _two_decimals)


def _two_decimals(c: Column) -> Column:
    size = F.abs(c)
    thousandths = F.round(size * 1000)
    tie = (size < float(2**43)) & (F.abs(size * 1000 - thousandths) < 1e-3) & (F.pmod(thousandths, F.lit(10.0)) == 5)
    fraction = ((size - F.floor(size)) * float(2**60)).cast("long").cast("decimal(20,0)")
    at_least = fraction * 1000 >= (thousandths - F.floor(size) * 1000).cast("long").cast("decimal(10,0)") * F.lit(2**60).cast("decimal(20,0)")
    cents = F.floor(thousandths / 10) + F.when(at_least, 1).otherwise(0)
    exact = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    return F.when(c.isNull() | F.isnan(c) | (size == float("inf")), "").when(tie, exact).otherwise(F.format_string("%.2f", c))


def normalize_cheque_number(c: Column, take: int = 8) -> Column:
    return or_empty(F.substring(F.regexp_replace(to_western_digits(c), "[^0-9]", ""), 1, take))


_NUMERIC = r"([0-9]{1,4})[./-]([0-9]{1,2})[./-]([0-9]{1,4})"


def date_chars(c: Column) -> Column:
    return F.lower(trim_all(to_western_digits(c)))


def date_words(s: Column) -> Column:
    """What a date's year, month and day are read from: the written-out numbers, in their order, and the first three letters of a name."""
    numeric = F.regexp_substr(s, F.lit(_NUMERIC))
    name = F.substring(F.regexp_extract(s, "([a-z]{3,})", 1), 1, 3)
    return F.when(numeric.isNotNull(), F.struct(F.split(numeric, "[./-]").alias("n"), F.lit(None).cast("string").alias("name"))).otherwise(
        F.struct(F.regexp_extract_all(s, F.lit("([0-9]{1,4})"), 1).alias("n"), name.alias("name"))
    )


def date_parts(w: Column) -> Column:
    """(y, m, d) as numbers. Day before month, unless the first number is over 31; two-digit years from 70 on are of the last century."""
    n = lambda i: F.get(w["n"], i).try_cast("int")
    full = lambda y: F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    parts = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    month = reduce(lambda x, i: x.when(w["name"] == MONTHS[i], i + 1), range(1, 12), F.when(w["name"] == MONTHS[0], 1))
    by_name = F.when(month.isNotNull() & (F.size(w["n"]) >= 2), parts(full(n(F.size(w["n"]) - 1)), month, n(F.lit(0))))
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    return F.when(w["name"].isNotNull(), by_name).when(n(zero) > 31, parts(n(zero), n(one), n(two))).otherwise(parts(full(n(two)), n(one), n(zero)))


def iso_date(p: Column) -> Column:
    iso = F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])
    return F.when(p["y"].between(1900, 2200) & p["m"].between(1, 12) & p["d"].between(1, 31) & iso.try_cast("date").isNotNull(), iso)


def parse_date(c: Column) -> Column:
    """YYYY-MM-DD, or null if there is no valid date between 1900 and 2200."""
    return let(date_chars(c), lambda s: let(date_words(s), lambda w: let(date_parts(w), iso_date)))


def words_to_number(c: Column) -> Column:
    """The value of an amount in English words; null if no word of it is known. Words become numbers once: what is added as it is, hundred and the
    magnitudes below -1, hundredths between -1 and 0."""
    tokens = F.split(F.regexp_replace(F.lower(c), "[,-]", " "), _SPACE)
    known = {w: float(n) for w, n in SMALL.items()} | {"hundred": -100.0} | {w: -float(n) for w, n in MAGNITUDES.items()}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    part = F.lit(-0.5) / 100
    hundredths = lambda t: F.when(t.rlike(r"\A[0-9]{1,2}/100\z"), part - F.substring_index(t, "/", 1).try_cast("double") / 100)
    numbers = F.filter(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), hundredths(t))), lambda x: x.isNotNull())
    state = lambda total, now, part: F.struct(total.alias("total"), now.alias("now"), part.alias("part"))

    def step(a: Column, x: Column) -> Column:
        some = F.when(a["now"] == 0, 1.0).otherwise(a["now"])
        return (
            F.when(x >= 0, state(a["total"], a["now"] + x, a["part"]))
            .when(x > -1, state(a["total"], a["now"], F.round(-x * 100 - 0.5) / 100))
            .when(x == -100, state(a["total"], some * 100, a["part"]))
            .otherwise(state(a["total"] - some * x, F.lit(0.0), a["part"]))
        )

    def value(n: Column) -> Column:
        return F.when(F.size(n) > 0, F.aggregate(n, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda a: a["total"] + a["now"] + a["part"]))

    return let(numbers, value)


def approx_equal(a: Column, b: Column) -> Column:
    """Equal to a hundredth, or to half a percent."""
    diff = F.abs(a - b)
    return (diff < 0.01) | (diff / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) < 0.005)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def round2(c: Column) -> Column:
    return half_up(c * 100) / 100


def provider_of(model: Column) -> Column:
    return F.when(model.startswith("gemini"), "google").otherwise("anthropic")


def is_full_page(r: Column) -> Column:
    return (r["x0"] <= 0.001) & (r["y0"] <= 0.001) & (r["x1"] >= 0.999) & (r["y1"] >= 0.999)


def region_to_pixels(r: Column, w: Column, h: Column) -> Column:
    """Whole pixels within the page, at least one each way; ends exclusive."""
    edge = lambda v, size: F.greatest(F.lit(0), F.least(size - 1, half_up(v * size)))
    x0, y0 = edge(r["x0"], w), edge(r["y0"], h)
    end = lambda low, v, size: F.greatest(low + 1, F.least(size, half_up(v * size)))
    return F.struct(*[v.cast("int").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", end(x0, r["x1"], w)), ("y1", end(y0, r["y1"], h)))])


def page_label(page: Column, ordinal: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat_ws("", page + 1, F.lit("·"), ordinal, F.lit("/"), count)).otherwise(F.concat(F.lit("p"), page + 1))


def first_hint(bank: Column, rows, default: str | None) -> Column:
    """The value of the first row of (value, name parts) of which a part is in the lower-cased bank name. A chain of conditions: no join, no
    row twice."""
    b = F.lower(or_empty(bank))
    out = None
    for value, parts in rows:
        fits = reduce(lambda x, y: x | y, [b.contains(p) for p in parts])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.lit(default))


def infer_currency(bank: Column) -> Column:
    return first_hint(bank, CURRENCY_HINTS, "")


def canonical_bank(bank: Column) -> Column:
    return first_hint(bank, [(b[0], b[1]) for b in BANKS], "")


def rois_for_bank(bank: Column) -> Column:
    """The boxes of amount, date and number line on a cheque: those of the bank where it has some, else the default ones."""
    box = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)])
    low = first_hint(bank, [(b[2], b[1]) for b in BANKS], None)
    amount = F.when(low.isNull(), box(DEFAULT_ROIS["amount"])).otherwise(F.struct(*[F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1"), BANK_AMOUNT, strict=True)], low.alias("y1")))
    return F.struct(amount.alias("amount"), box(DEFAULT_ROIS["date"]).alias("date"), box(DEFAULT_ROIS["micr"]).alias("micr"))


def bank_hint(bank: Column) -> Column:
    return first_hint(bank, [(f"Bank-specific guidance for {b[3]}: {b[4]}", b[1]) for b in BANKS], None)


def exemplar_key(bank: Column) -> Column:
    key = canonical_bank(bank)
    return F.when(key != "", key).otherwise(trim_all(F.lower(or_empty(bank))))


def strip_fences(c: Column) -> Column:
    return trim_all(F.regexp_replace(F.regexp_replace(c, r"(?i)\A```(?:json)?", ""), r"```\z", ""))


def high_flags(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda f: f["severity"] == "high"))


def score(flags: Column, reconciled: Column, confidence: Column) -> Column:
    return F.when(reconciled, 1000).otherwise(0) - 100 * high_flags(flags) + confidence


def flags_text(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda f: F.concat_ws(":", f["field"], f["severity"], f["reason"])), " | ")


def csv_cell(c: Column) -> Column:
    s = or_empty(c.cast("string"))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def field_flags(flags: Column) -> Column:
    """Field -> reason; of several flags of a field the last counts."""
    last = F.filter(flags, lambda f, i: ~F.exists(F.slice(flags, i + 2, F.greatest(F.size(flags), F.lit(1))), lambda g: g["field"] == f["field"]))
    return F.map_from_entries(F.transform(last, lambda f: F.struct(f["field"], f["reason"])))


def normalize_proposals(boxes: Column) -> Column:
    """Proposed boxes as fractions of the page with ordered edges; those of percent are divided, those too small or with a missing
    edge dropped."""

    def one(b: Column) -> Column:
        scale = F.when(F.greatest(b["x0"], b["y0"], b["x1"], b["y1"]) > 1.5, 100.0).otherwise(1.0)
        x, y = [(F.greatest(F.lit(0.0), F.least(F.lit(1.0), b[p] / scale)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), b[q] / scale))) for p, q in (("x0", "x1"), ("y0", "y1"))]
        return F.struct(F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))

    whole = F.filter(boxes, lambda b: b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull())
    return F.filter(F.transform(whole, one), lambda b: (b["x1"] - b["x0"] > 0.05) & (b["y1"] - b["y0"] > 0.03))
