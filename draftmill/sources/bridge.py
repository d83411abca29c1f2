"""The library's input tables from the test tables, where no cheque data is at hand.

Each table is a chain of projections; an expression is written in the common part of Spark SQL and other dialects (whole-number
arithmetic on keys, plain string building), so the same inputs can be built elsewhere for comparison: `sql` gives a chain as one
nested SELECT.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def div(a: str, b: object) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def pick(key: str, *values: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


def text(a: str, width: int = 0) -> str:
    return f"lpad(CAST({a} AS STRING), {width}, '0')" if width else f"CAST({a} AS STRING)"


def place(k: str) -> dict[str, str]:
    """Where the cheque with the whole-number key k lies: three a page, a thousand a file."""
    pdf, page, nth = f"'doc' || {text(div(k, 1000), 7)}", div(f"({k} % 1000)", 3), f"{k} % 3 + 1"
    return {"pdf_id": pdf, "page_index": f"CAST({page} AS INT)", "cheque_on_page": f"CAST({nth} AS INT)", "id": f"{pdf} || ':' || {text(page)} || ':' || {text(nth)}"}


NAMES = ("'Qatar National Bank'", "'CBQ'", "'Some Unlisted Bank'", "' Doha Bank '", "'Commercial Bank of Dubai'", "''", "'Banca Transilvania Romania'", "'Qatar International Islamic Bank'", "'Al Rajhi'")
MODELS = ("'gemini-2.5-flash-lite'", "'gemini-2.5-pro'", "'claude-haiku-4-5-20251001'", "'claude-sonnet-4-6'", "'claude-opus-4-8'")
WORDS = ("'one'", "'Two'", "'three'", "'four'", "'five'", "'six'", "'seven'", "'eight'", "'NINE'")
_D1, _D2 = pick("k % 9", *WORDS), pick(f"{div('k', 9)} % 9", *WORDS)

#: Raw reads; from k (order), c (customer), price and p (pass, from 1).
RAW_READS = [
    {"k": "k", "c": "c", "p": "p", "cents": "CAST(round(price * 100) AS BIGINT) + CASE WHEN k % 13 = 0 AND p = 1 THEN 10000 ELSE 0 END", "true_cents": "CAST(round(price * 100) AS BIGINT)"},
    {"k": "k", "c": "c", "p": "p", "true_cents": "true_cents", "u": div("cents", 100), "f": text("cents % 100", 2)},
    {
        "k": "k", "c": "c", "p": "p", "true_cents": "true_cents", "plain": f"{text('u')} || '.' || f",
        "us": f"CASE WHEN u >= 1000 THEN {text(div('u', 1000))} || ',' || {text('u % 1000', 3)} ELSE {text('u')} END || '.' || f",
        "eu": f"CASE WHEN u >= 1000 THEN {text(div('u', 1000))} || '.' || {text('u % 1000', 3)} ELSE {text('u')} END || ',' || f",
        "dd": text("k % 28 + 1", 2), "mm": text(f"{div('k', 7)} % 12 + 1", 2), "yy": text("1995 + k % 40"), "mon": f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * ({div('k', 7)} % 12) + 1 AS INT), 3)",
    },
    {
        **place("k"), "key": "k", "pass": "CAST(p AS INT)",
        "amount_numeric": "CASE k % 5 WHEN 0 THEN us WHEN 1 THEN eu WHEN 2 THEN translate(plain, '0123456789.', '٠١٢٣٤٥٦٧٨٩٫') WHEN 3 THEN 'QAR ' || plain ELSE CASE k % 25 WHEN 4 THEN 'abc' WHEN 9 THEN NULL WHEN 14 THEN 'QR. ' || plain WHEN 19 THEN plain || '-' ELSE plain END END",
        "amount_words": f"CASE WHEN k % 33 = 0 THEN 'qwerty' WHEN k % 22 = 0 THEN '' ELSE {_D1} || ' thousand, ' || {_D2} || ' hundred twenty-' || {_D2} || ' and ' || {text('k % 100', 2)} || '/100 Riyals only' END",
        "amount_words_value": f"CASE WHEN k % 11 = 0 THEN NULL ELSE CAST({div('true_cents * CASE WHEN k % 7 = 0 AND p < 3 THEN 9 ELSE 10 END', 10)} AS DOUBLE) / 100 END",
        "currency": pick("k % 4", "'QAR '", "''", "NULL", "'  '"),
        "date": "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN dd || '/' || mm || '/' || yy WHEN 2 THEN yy || '-' || mm || '-' || dd WHEN 3 THEN dd || '.' || mm || '.' || substr(yy, 3, 2) WHEN 4 THEN dd || ' ' || mon || ' ' || yy ELSE CASE WHEN p = 1 THEN '31/02/' || yy ELSE '   ' END END",
        "payer": "CASE WHEN k % 17 = 0 THEN '' ELSE '  Payer, no. ' || CAST(c AS STRING) || ' ' END",
        "bank": pick("c % 9", *NAMES),
        "cheque_number": f"CASE WHEN k % 19 = 0 THEN '' WHEN k % 8 = 0 AND p < 3 THEN {text('k % 100000', 5)} ELSE 'No ' || {text('k', 10)} END",
        "has_handwriting": pick("k % 3", "NULL", "true", "false"),
        "conf_amount": pick("k % 6", "CAST(0.5 AS DOUBLE)", "NULL", "CAST(0.9 AS DOUBLE)"), "conf_payer": pick("k % 10", "CAST(0.3 AS DOUBLE)", "NULL", "CAST(0.8 AS DOUBLE)"),
        "model": f"CASE WHEN p = 1 THEN {pick('k % 5', *MODELS)} ELSE 'gemini-2.5-pro' END", "error": "CASE WHEN k % 29 = 0 AND p = 1 THEN 'HTTP 500, no answer' WHEN k % 4 = 3 AND p = 2 THEN 'HTTP 429, no answer' ELSE NULL END",
    },
]

CORRECTIONS = [{
    **place("user_id"), "seq": "event_id", "bank": pick("user_id % 9", *NAMES), "currency": pick("event_id % 3", "'QAR'", "''", "'AED'"),
    "amount": f"CASE WHEN event_id % 10 = 0 THEN '' ELSE {text(div('CAST(round(value * 100) AS BIGINT)', 500))} || '.00' END",
    "date": f"'2024-01-' || {text('event_id % 28 + 1', 2)}", "payer": "'Payer ' || CAST(user_id AS STRING)", "cheque_number": text("event_id % 7", 8),
}]

ATTEMPTS = [{"request_id": "user_id", "attempt": "CAST(event_id % 5 AS INT)", "http_status": "CAST(" + pick("event_id % 8", "200", "429", "200", "503", "400", "200", "529", "401") + " AS INT)", "has_payload": "event_id % 3 <> 0", "seq": "event_id"}]

#: One rectangle of ink for each line of an order, on a page for each order; some are split side by side, thin, or nearly blank.
RECTANGLES = [
    {"k": "k", "n": "n", "pk": "pk", "sk": "sk", "w": "120 + 30 * (k % 3)", "h": "70 + 35 * (k % 5)"},
    {"k": "k", "w": "w", "h": "h", "top": f"(n - 1) * {div('h', 7)} + pk % 3", "low": f"CASE WHEN k % 4 = 0 THEN (n - 1) * {div('h', 7)} + pk % 3 + 2 ELSE n * {div('h', 7)} - sk % 4 END", "x0": "(pk % 4) * 8", "x1": "CASE WHEN k % 11 = 0 THEN (pk % 4) * 8 + 1 ELSE w - (sk % 5) * 10 END"},
    {"page_key": "k", "width": "CAST(w AS INT)", "height": "CAST(h AS INT)", "top": "top", "low": "low", "x0": "CAST(x0 AS INT)", "x1": "CAST(x1 AS INT)", "mid": f"CAST({div('w', 2)} AS INT)", "halves": "CASE WHEN k % 5 = 0 AND k % 11 <> 0 THEN true ELSE false END"},
]
PAGES = [{"page_key": "k", "width": "CAST(120 + 30 * (k % 3) AS INT)", "height": "CAST(70 + 35 * (k % 5) AS INT)"}]

SOURCES = {
    "raw_reads": "SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS price FROM orders",
    "rectangles": "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "pages": "SELECT o_orderkey AS k FROM orders",
}


def chain(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr(*[f"{e} AS {n}" for n, e in stage.items()])
    return df


def sql(source: str, stages: list[dict[str, str]]) -> str:
    for stage in stages:
        source = f"SELECT {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM ({source}) AS q"
    return source


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reads(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 1, keys: DataFrame | None = None) -> DataFrame:
    """Passes first to last of every order's cheque, or of those with the `key`s."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("price"))
    o = o if keys is None else o.join(keys.select(F.col("key").alias("k")), "k", "left_semi")
    # The table is one row group: its narrow keys are spread before the long chain of strings. A number keeps small tables spread.
    o = o.repartition(spark.sparkContext.defaultParallelism, "k")
    d = chain(o.withColumn("p", F.explode(F.array(*[F.lit(p).cast("long") for p in range(first, last + 1)]))), RAW_READS)
    none = F.lit(None).cast("double")
    conf = F.struct(F.col("conf_amount").alias("amount"), none.alias("date"), F.col("conf_payer").alias("payer"), none.alias("bank"), none.alias("chequeNumber"))
    return d.withColumn("field_confidence", conf).drop("conf_amount", "conf_payer")


def responses(spark: SparkSession, sf_dir: str, first: int = 1, last: int = 1) -> DataFrame:
    """What models answered, as their providers send it: an attempt that failed before each third answer; HTTP errors; answers cut off (every 43rd) and
    answers in another tool (every 47th)."""
    r = raw_reads(spark, sf_dir, first, last)
    fields = ("amount_numeric", "amount_words", "amount_words_value", "currency", "date", "payer", "bank", "cheque_number", "has_handwriting", "field_confidence")
    payload = F.to_json(F.struct(*fields))
    cut = F.when(F.col("key") % 43 == 0, F.substring(payload, F.lit(1), F.length(payload) - 1)).otherwise(payload)
    call = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(cut.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    tool = F.when(F.col("key") % 47 == 0, "other_tool").otherwise("record_cheque")
    use = F.concat(F.lit('{"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "'), tool, F.lit('", "input": '), payload, F.lit("}]}"))
    status = F.when(F.col("error").isNotNull(), F.substring("error", 6, 3).cast("int")).otherwise(200)
    body = F.when(F.col("error").isNull(), F.when(F.col("model").startswith("gemini"), call).otherwise(use))
    answers = r.select("id", "pdf_id", "page_index", "cheque_on_page", "key", "pass", F.lit(1).alias("attempt"), "model", status.alias("http_status"), body.alias("body"))
    earlier = answers.filter("key % 3 = 0").withColumns({"attempt": F.lit(0), "http_status": F.lit(503), "body": F.lit(None).cast("string")})
    return answers.unionByName(earlier)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(table(spark, sf_dir, "events"), CORRECTIONS)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(table(spark, sf_dir, "events"), ATTEMPTS)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), PAGES)


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, width, top, low, parts): scan lines top to low of a page, that have the same stretches of ink, from left to right. Spread by page, once: what
    is grouped by page_key afterwards needs no further exchange."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), "l_partkey", "l_suppkey").repartition("k")
    r = chain(lines.groupBy("k", "n").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk")), RECTANGLES)
    part = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))
    parts = F.when(F.col("halves"), F.array(part(F.col("x0"), F.col("mid") - 8), part(F.col("mid") + 8, F.col("x1")))).otherwise(F.array(part(F.col("x0"), F.col("x1"))))
    inked = F.filter(parts, lambda p: p["x0"] < p["x1"])
    return r.select("page_key", "width", F.col("top").cast("int").alias("top"), F.col("low").cast("int").alias("low"), inked.alias("parts")).filter("top < low")


def ink_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, y, y1, x0, x1): the ink runs, those that are the same on the lines from y to y1 as one row."""
    return rectangles(spark, sf_dir).select("page_key", F.col("top").alias("y"), F.col("low").alias("y1"), F.inline("parts"))


def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rectangles(spark, sf_dir).select("page_key", F.explode(F.sequence("top", F.col("low") - 1)).alias("y"), "parts")
    return rows.select("page_key", "y", F.inline("parts"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen boxes a vector, from its numbers in fours; those of each third vector in percent."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_key"), F.transform("embedding", lambda x: F.abs(x.cast("double")) * F.when(F.col("vec_id") % 3 == 0, 300.0).otherwise(3.0)).alias("v"))
    box = lambda i: F.struct(*[F.get("v", 4 * i + j).alias(n) for j, n in enumerate(("x0", "y0", "x1", "y1"))])
    return e.select("page_key", F.transform(F.sequence(F.lit(0), F.lit(15)), box).alias("boxes"))


def gray_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("page_key"), ((F.col("l_quantity").cast("int") * 5) % 256).alias("gray")).agg(F.count("*").alias("n"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_key, width, height, pixels): the rectangles of each page drawn on a light ground, a line of pixels after the other. Pages are gray, in colour, or
    in colour with an alpha channel, by turns; ink is light enough to count as ink only against the page's own ground. Rectangles of a page
    share no scan line. A line is drawn once and repeated; pixels are bytes of strings until the page is whole."""
    shade = lambda *by: F.when(F.col("page_key") % 3 == 0, F.unhex(F.lit(by[0]))).when(F.col("page_key") % 3 == 1, F.unhex(F.lit(by[1]))).otherwise(F.unhex(F.lit(by[2]))).cast("string")
    d = rectangles(spark, sf_dir).withColumns({"white": shade("E0", "E6E0D2", "E6E0D2FF"), "dark": shade("AA", "C8A096", "C8A09680")})
    pieces = F.transform("parts", lambda r, i: F.concat(F.repeat("white", r["x0"] - F.coalesce(F.get("parts", i - 1)["x1"], F.lit(0))), F.repeat("dark", r["x1"] - r["x0"])))
    line = F.concat(F.array_join(pieces, ""), F.repeat("white", F.col("width") - F.coalesce(F.get("parts", F.size("parts") - 1)["x1"], F.lit(0))))
    own = d.select("page_key", F.struct("top", "low", line.alias("line")).alias("own")).groupBy("page_key").agg(F.array_sort(F.collect_list("own")).alias("own"))
    d = pages(spark, sf_dir).join(own, "page_key", "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<top: int, low: int, line: string>>")))
    d = d.withColumn("blank", F.repeat(shade("E0", "E6E0D2", "E6E0D2FF"), F.col("width")))
    above = lambda i: F.coalesce(F.get("own", i - 1)["low"], F.lit(0))
    pieces = F.flatten(F.transform("own", lambda x, i: F.array(F.repeat("blank", x["top"] - above(i)), F.repeat(x["line"], x["low"] - x["top"]))))
    below = F.repeat("blank", F.col("height") - above(F.size("own")))
    return d.select("page_key", "width", "height", F.array_join(F.concat(pieces, F.array(below)), "").cast("binary").alias("pixels"))


def document_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Each document's text as a file of its own in a local folder that driver and executors share: `doc <id>` with .pdf, .PDF or .txt, in seven subfolders.
    A task that runs again writes the same files."""

    def work(batches):
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                path = Path(folder, f"s{i % 7}", f"doc {i}.{('pdf', 'PDF', 'txt')[i % 3]}")
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes((text or "").encode())
            yield batch[["doc_id"]]

    table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(work, "doc_id long").write.format("noop").mode("overwrite").save()
