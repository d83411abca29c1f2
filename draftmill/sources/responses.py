"""Landed requests, responses and attempts of reading models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions import columns as C
from draftmill.functions.tables import BACKOFF_MS, EXTRACT_PROMPT, MAX_RETRIES, MODELS, RAW, REGION_PROMPT, RETRIABLE

TOOL_USE = "struct<content: array<struct<type: string, name: string, input: string>>>"
CALL = "struct<choices: array<struct<message: struct<content: string, tool_calls: array<struct<function: struct<arguments: string>>>>>>>"
RAW_STRUCT = "struct<" + ", ".join(p.strip().replace(" ", ": ", 1) for p in RAW.split(", field_confidence")[0].split(",")) + ", field_confidence:" + RAW.split("field_confidence")[1] + ">"


def is_json(c):
    """Whether the text is well-formed JSON."""
    return F.try_parse_json(c).isNotNull()


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Model answers, one JSON object a line, in the fixed schema; malformed lines become rows with an error."""
    return parse_raw(spark.read.text(path).withColumnRenamed("value", "text"), "text")


def parse_raw(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of the JSON object in `column`, and `error`. A field of a wrong type is null; the others stay."""
    good = is_json(F.col(column))
    parsed = df.withColumn("r", F.from_json(F.when(good, F.col(column)), RAW_STRUCT))
    return parsed.select("*", "r.*", F.when(~F.coalesce(good, F.lit(False)), "Invalid JSON").alias("error")).drop("r", column)


def parse_tool_use(df: DataFrame, column: str, tool: str) -> DataFrame:
    """df with `payload`, the input of the first tool_use block of the tool, as JSON, and `error`."""
    block = F.get(F.filter(F.from_json(column, TOOL_USE)["content"], lambda b: (b["type"] == "tool_use") & (b["name"] == tool)), F.lit(0))["input"]
    return df.withColumn("payload", block).withColumn("error", F.when(F.col("payload").isNull(), "Model returned no tool_use block"))


def parse_function_call(df: DataFrame, column: str) -> DataFrame:
    """df with `payload`, the arguments of the first function call, else the message's content without code fences, and `error`."""
    message = F.get(F.from_json(column, CALL)["choices"], F.lit(0))["message"]
    d = df.withColumns({"a": F.get(message["tool_calls"], F.lit(0))["function"]["arguments"], "c": message["content"]})
    args, content = F.nullif(F.col("a"), F.lit("")), F.nullif(F.col("c"), F.lit(""))
    text = F.coalesce(args, C.strip_fences(content))
    d = d.withColumn("payload", F.when(is_json(text), text))
    error = F.when(text.isNull(), "Model returned no structured output").when(F.col("payload").isNull(), "Could not parse model JSON")
    return d.withColumn("error", error).drop("a", "c")


#: Fixed texts: the tool that an extraction calls, and how providers are named in errors.
EXTRACT_TOOL = "record_cheque"
PROVIDERS = {"google": "Gemini", "anthropic": "Anthropic"}


def reads_of(responses: DataFrame) -> DataFrame:
    """Raw reads from landed responses (id, pass, attempt, model, http_status, body, and whatever columns go with an id): of each id and pass the last attempt.
    The answer is looked up as the model's provider gives it; `error` says why there is none."""
    rest = [c for c in responses.columns if c not in ("id", "pass", "attempt")]
    last = responses.groupBy("id", "pass").agg(F.max_by(F.struct(*rest), "attempt").alias("r")).select("id", "pass", "r.*")
    google = C.provider_of(F.col("model")) == "google"
    ok = F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    tool = parse_tool_use(last.filter(~google), "body", EXTRACT_TOOL)
    call = parse_function_call(last.filter(google), "body")
    both = tool.unionByName(call).drop("body")
    name = F.when(google, PROVIDERS["google"]).otherwise(PROVIDERS["anthropic"])
    failed = F.concat(name, F.lit(" HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("?")))
    both = both.withColumns({"why": F.when(ok, F.col("error")).otherwise(failed), "payload": F.when(ok, F.col("payload"))}).drop("error", "http_status")
    return parse_raw(both, "payload").withColumn("error", F.coalesce("why", "error")).drop("why")


def validate_requests(df: DataFrame) -> DataFrame:
    """df with `error` where the image is missing or the model is not one of the catalogue."""
    good = (C.or_empty(F.col("image")) != "") & F.coalesce(F.col("model").isin(*[m for m, _ in MODELS]), F.lit(False))
    return df.withColumn("error", F.when(~good, "Missing image or unsupported model"))


def build_requests(df: DataFrame) -> DataFrame:
    """df with `prompt`: by `mode`, and the trimmed `hint` after a blank line if there is one."""
    base = F.when(F.col("mode") == "regions", REGION_PROMPT).otherwise(EXTRACT_PROMPT)
    hint = C.or_empty(C.trim_all(F.col("hint")))
    return df.withColumn("prompt", F.when(hint != "", F.concat(base, F.lit("\n\n"), hint)).otherwise(base))


def retry_plan(attempts: DataFrame) -> DataFrame:
    """(request_id, attempt, action, wait_ms) by the latest attempt: done, retry after a wait that doubles, or fail."""
    last = attempts.groupBy("request_id").agg(F.max_by(F.struct("attempt", "http_status", "has_payload"), F.struct("attempt", "seq")).alias("a")).select("request_id", "a.*")
    ok = F.col("http_status").between(200, 299)
    again = (F.col("http_status").isin(*RETRIABLE) | (ok & ~F.col("has_payload"))) & (F.col("attempt") < MAX_RETRIES)
    action = F.when(ok & F.col("has_payload"), "done").when(again, "retry").otherwise("fail")
    wait = F.when(action == "retry", F.lit(BACKOFF_MS) * F.pow(F.lit(2.0), "attempt"))
    return last.select("request_id", "attempt", action.alias("action"), wait.cast("long").alias("wait_ms"))
