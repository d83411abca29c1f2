"""The registered queries: each operator over whole tables, with flat result columns."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from draftmill.functions import columns as C
from draftmill.functions.shared import file_system, new_path, written
from draftmill.functions.tables import RAW
from draftmill.jobs import cheques
from draftmill.jobs.hooks import map_bounded
from draftmill.operators import choose, crops, exemplars, layout, lines, raster, results
from draftmill.operators.validate import validate_extraction, with_error_rows
from draftmill.sources import bridge as B
from draftmill.sources import manifest, responses
from draftmill.streaming import streams
from draftmill.streaming.store import KeyedTable

ESCALATE = "gemini-2.5-pro"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return B.raw_reads(spark, sf)


def _valid(spark: SparkSession, sf: str, first: int = 1, last: int = 1) -> DataFrame:
    return with_error_rows(B.raw_reads(spark, sf, first, last))


def _flat(v: DataFrame) -> DataFrame:
    return v.withColumn("flags", C.flags_text(F.col("flags")))


def _r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return layout.detect_regions(B.ink_blocks(spark, sf), B.pages(spark, sf))


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return layout.resolve_page_regions(_regions(spark, sf), B.proposals(spark, sf))


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    return layout.bands(B.ink_runs(spark, sf), B.pages(spark, sf))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return layout.split_band_columns(layout.band_column_profile(B.ink_runs(spark, sf), _bands(spark, sf)))


def _exemplars(spark: SparkSession, sf: str) -> DataFrame:
    return exemplars.learn_exemplars(B.corrections(spark, sf))


FIELDS = ("id", "pass", "amount", "amount_words", "amount_numeric_value", "amount_words_value", "amount_reconciled", "currency", "date", "payer", "bank", "cheque_number", "has_handwriting", "flags", "confidence", "status")


@query
def n1_western_digits(spark, sf):
    return _raw(spark, sf).select("id", C.to_western_digits(F.col("amount_numeric")).alias("digits"))


@query
def n2_parse_amount(spark, sf):
    return _raw(spark, sf).select("id", C.parse_amount(F.col("amount_numeric")).alias("amount"))


@query
def n3_format_amount(spark, sf):
    amounts = n2_parse_amount(spark, sf)
    return amounts.select("id", C.format_amount(F.col("amount")).alias("amount"), C.format_amount(F.col("amount") / 1000).alias("thousandth"))


@query
def n4_cheque_number(spark, sf):
    return _raw(spark, sf).select("id", C.normalize_cheque_number(F.col("cheque_number")).alias("cheque_number"))


@query
def n5_parse_date(spark, sf):
    return _raw(spark, sf).select("id", C.parse_date(F.col("date")).alias("iso"))


@query
def n6_words_to_number(spark, sf):
    return _raw(spark, sf).select("id", F.round(C.words_to_number(F.col("amount_words")), 6).alias("value"))


@query
def n7_approx_equal(spark, sf):
    d = _raw(spark, sf).select("id", C.parse_amount(F.col("amount_numeric")).alias("a"), "amount_words_value")
    return d.select("id", C.approx_equal(F.col("a"), F.col("amount_words_value")).alias("same"))


@query
def n8_trim(spark, sf):
    return _raw(spark, sf).select("id", C.trim_all(F.col("payer")).alias("payer"), C.trim_all(F.col("bank")).alias("bank"))


@query
def n9_validate_extraction(spark, sf):
    return _flat(validate_extraction(_raw(spark, sf))).select(*FIELDS)


@query
def n10_score(spark, sf):
    return _valid(spark, sf).select("id", C.score(F.col("flags"), F.col("amount_reconciled"), F.col("confidence")).alias("score"))


@query
def n11_normalize_proposals(spark, sf):
    return B.proposals(spark, sf).select("page_key", F.inline(C.normalize_proposals(F.col("boxes")))).select("page_key", *_r6(*layout.BOX))


@query
def n12_pad_boxes(spark, sf):
    boxes = _split(spark, sf).withColumns({"y0": F.col("band_y0"), "y1": F.col("band_y1")})
    return layout.pad_and_filter_boxes(boxes).select("page_key", *_r6(*layout.BOX), "wide")


@query
def n13_field_flags(spark, sf):
    return results.field_reasons(_valid(spark, sf))


@query
def n14_flags_text(spark, sf):
    t = C.flags_text(F.col("flags"))
    return _valid(spark, sf).select("id", t.alias("flags"), C.csv_cell(t).alias("cell"))


@query
def n15_strip_fences(spark, sf):
    body = C.or_empty(F.col("amount_numeric"))
    fenced = F.when(F.col("key") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("key") % 3 == 1, F.concat(F.lit("```JSON"), body, F.lit("```"))).otherwise(F.concat(F.lit("```\t"), body, F.lit(" \n")))
    return _raw(spark, sf).select("id", C.strip_fences(fenced).alias("body"))


@query
def n16_split_band_columns(spark, sf):
    return _split(spark, sf).select("page_key", F.col("band_y0").alias("y0"), F.col("band_y1").alias("y1"), "x0", "x1", "ambiguous")


@query
def n17_detect_regions(spark, sf):
    return _regions(spark, sf).select("page_key", "ordinal", *_r6(*layout.BOX), "flag")


def _json(c: str) -> Column:
    return F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"')))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


@query
def s2_read_raw(spark, sf):
    d = _raw(spark, sf).withColumn("conf", F.col("field_confidence.amount"))
    body = F.concat(F.lit('{"amount_numeric": '), _json("amount_numeric"), F.lit(', "amount_words_value": '), _number("amount_words_value"), F.lit(', "bank": '), _json("bank"), F.lit(', "field_confidence": {"amount": '), _number("conf"), F.lit("}}"))
    d = d.select("id", F.when(F.col("key") % 37 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("text"))
    return responses.parse_raw(d, "text").select("id", "amount_numeric", "amount_words_value", "bank", F.col("field_confidence.amount").alias("conf_amount"), "error")


@query
def s3_tool_use(spark, sf):
    name = F.when(F.col("key") % 4 == 0, "other_tool").otherwise("record_cheque")
    body = F.concat(F.lit('{"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "name": "'), name, F.lit('", "input": {"bank": '), _json("bank"), F.lit("}}]}"))
    d = responses.parse_tool_use(_raw(spark, sf).select("id", body.alias("body")), "body", "record_cheque")
    return d.select("id", F.get_json_object("payload", "$.bank").alias("bank"), "error")


@query
def s4_function_call(spark, sf):
    k = F.col("key") % 5
    inner = F.concat(F.lit('{\\"bank\\": \\"'), F.col("bank"), F.lit('\\"}'))
    call = lambda args: F.concat(F.lit('{"choices": [{"message": {"content": "ignored", "tool_calls": [{"function": {"arguments": "'), args, F.lit('"}}]}}]}'))
    say = lambda text: F.concat(F.lit('{"choices": [{"message": {"content": "'), text, F.lit('"}}]}'))
    body = F.when(k == 0, call(inner)).when(k == 1, say(inner)).when(k == 2, say(F.concat(F.lit("```json\\n"), inner, F.lit("\\n```")))).when(k == 3, call(F.lit("{bad"))).otherwise(F.lit('{"choices": []}'))
    d = responses.parse_function_call(_raw(spark, sf).select("id", body.alias("body")), "body")
    return d.select("id", F.get_json_object("payload", "$.bank").alias("bank"), "error")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("pdf_id", "page_index")).cast("int")
    return choose.result_rows(_valid(spark, sf)).withColumns({"source_file": F.concat(F.col("pdf_id"), F.lit(".pdf")), "cheques_on_page": n})


@query
def s1_pdf_manifest(spark, sf):
    """Names and sizes of the PDF files among some that are made of the documents; no file is opened."""
    folder = urlparse(new_path(spark, "files")).path
    B.document_files(spark, sf, folder)
    return manifest.pdf_manifest(spark, folder).select("source_file", "size")


@query
def s5_export_csv(spark, sf):
    """The exported files, read again in order: header and lines by number; and whether there were several files."""
    path = new_path(spark, "export")
    results.export_csv(_results(spark, sf), path, spark.sparkContext.defaultParallelism)
    lines = results.read_export(spark, path)
    several = lines.agg((F.count_distinct("part") > 1).alias("several"))
    return lines.select("n", "line").join(F.broadcast(several))


@query
def s7_crops(spark, sf):
    """A store of crops after several calls: puts, deletes, puts of what was deleted, empty crops, and an earlier store that was cleared."""
    path = new_path(spark, "crops")
    events = B.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 5).alias("call"), F.when(F.col("event_id") % 11 != 0, F.concat("event_type", F.lit(" "), F.lpad(F.col("event_id").cast("string"), 12, "0"))).otherwise("").alias("crop"), "event_id")
    crops.save_crops(events, path)
    crops.clear_crops(spark, path)
    for call in range(5):
        now = events.filter(F.col("call") == call)
        crops.save_crops(now, path)
        crops.drop_crops(now.filter("event_id % 29 = 0"), path)
    return crops.load_crops(spark, path)


@query
def p1_validate_requests(spark, sf):
    d = _raw(spark, sf).select("id", F.when(F.col("key") % 7 == 0, "").otherwise("image").alias("image"), F.when(F.col("key") % 6 == 5, "another-model").otherwise(F.col("model")).alias("model"))
    return responses.validate_requests(d).select("id", "error")


@query
def p2_provider_of(spark, sf):
    return _raw(spark, sf).select("id", C.provider_of(F.col("model")).alias("provider"))


@query
def p3_is_full_page(spark, sf):
    return _regions(spark, sf).select("page_key", "ordinal", C.is_full_page(F.struct(*layout.BOX)).alias("whole"))


@query
def p4_region_to_pixels(spark, sf):
    r = _regions(spark, sf).join(B.pages(spark, sf), "page_key")
    return r.select("page_key", "ordinal", C.region_to_pixels(F.struct(*layout.BOX), F.col("width"), F.col("height")).alias("r")).select("page_key", "ordinal", "r.*")


@query
def p5_page_label(spark, sf):
    n = F.count("*").over(Window.partitionBy("pdf_id", "page_index"))
    return _raw(spark, sf).withColumn("n", n).select("id", C.page_label(F.col("page_index"), F.col("cheque_on_page"), F.col("n")).alias("label"))


@query
def p6_needs_escalation(spark, sf):
    return _valid(spark, sf).filter(choose.needs_escalation(ESCALATE)).select("id")


@query
def p7_needs_vote(spark, sf):
    return choose.pick_best_read(_valid(spark, sf, 1, 2)).filter(choose.needs_vote()).select("id")


@query
def p8_page_geometry(spark, sf):
    p = B.table(spark, sf, "part").select(F.col("p_partkey").alias("page_key"), (600 + F.col("p_partkey") % 300).alias("width"), (500 + F.col("p_size") * 13).alias("height"), (90 * (F.col("p_partkey") % 4)).cast("int").alias("rotate"))
    return manifest.page_geometry(p, manifest.DETECT_EDGE).select("page_key", F.col("rotation").cast("int").alias("rotation"), "out_width", "out_height")


@query
def p9_build_requests(spark, sf):
    d = _raw(spark, sf).select("id", F.when(F.col("key") % 3 == 0, "regions").otherwise("extract").alias("mode"), F.col("bank").alias("hint"))
    return responses.build_requests(d).select("id", F.md5("prompt").alias("prompt_md5"))


@query
def p10_retry_plan(spark, sf):
    return responses.retry_plan(B.attempts(spark, sf))


@query
def j1_infer_currency(spark, sf):
    return _raw(spark, sf).select("id", C.infer_currency(F.col("bank")).alias("currency"))


@query
def j2_canonical_bank(spark, sf):
    return _raw(spark, sf).select("id", C.canonical_bank(F.col("bank")).alias("bank_key"))


@query
def j3_rois_for_bank(spark, sf):
    d = _raw(spark, sf).select("id", C.rois_for_bank(F.col("bank")).alias("r"))
    return d.select("id", F.col("r.amount.x0").alias("amount_x0"), F.col("r.amount.y1").alias("amount_y1"), F.col("r.date.x0").alias("date_x0"), F.col("r.micr.y0").alias("micr_y0"))


@query
def j4_apply_corrections(spark, sf):
    fixed = results.apply_corrections(_results(spark, sf), B.corrections(spark, sf))
    return _flat(fixed).select("id", "amount", "bank", "cheque_number", "reviewed", "status", "flags", "confidence")


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised proposals, one row each, with their place in the answer."""
    d = B.proposals(spark, sf).select("page_key", F.posexplode(F.transform("boxes", lambda b: C.normalize_proposals(F.array(b)))).alias("i", "b"))
    return d.select("page_key", "i", F.inline("b"))


@query
def j5_regions_overlap_badly(spark, sf):
    numbered = _proposed(spark, sf).withColumn("ordinal", F.row_number().over(Window.partitionBy("page_key").orderBy("i")))
    return layout.regions_overlap_badly(numbered)


@query
def j6_crop_runs(spark, sf):
    return layout.crop_runs(B.ink_blocks(spark, sf), _regions(spark, sf), B.pages(spark, sf))


@query
def j7_attach_crops(spark, sf):
    own = _raw(spark, sf).select("id", F.when(F.col("key") % 3 == 0, "own").alias("crop_ref"))
    stored = B.corrections(spark, sf).select("id").distinct().withColumn("crop", F.concat(F.lit("stored "), F.col("id")))
    return results.attach_crops(own, stored).select("id", "crop")


@query
def j8_escalation_worklist(spark, sf):
    reads = _valid(spark, sf, 1, 2)
    return choose.escalation_worklist(choose.pick_best_read(reads), reads.filter("pass = 1 or key % 4 <> 0"), ESCALATE)


@query
def j9_build_hints(spark, sf):
    return exemplars.build_hints(_valid(spark, sf).select("id", "bank"), _exemplars(spark, sf)).select("id", F.md5("hint").alias("hint_md5"))


@query
def j10_resolve_page_regions(spark, sf):
    return _resolved(spark, sf).select("page_key", "ordinal", *_r6(*layout.BOX))


@query
def j11_escalation_target(spark, sf):
    return choose.escalation_target(_raw(spark, sf), ESCALATE).select("id", "target")


@query
def a1_summary(spark, sf):
    return results.summary(_valid(spark, sf))


@query
def a2_cheques_per_page(spark, sf):
    return layout.region_ordinals(_regions(spark, sf)).select("page_key", "ordinal", "cheques_on_page")


@query
def a3_row_profile(spark, sf):
    return layout.row_profile(B.ink_runs(spark, sf), B.pages(spark, sf)).select("page_key", "y", "ink")


@query
def a4_band_column_profile(spark, sf):
    p = layout.band_column_profile(B.ink_runs(spark, sf), _bands(spark, sf)).filter("ink > 0").withColumn("n", F.col("end") - F.col("start"))
    return p.groupBy("page_key", F.col("band_y0").alias("y0")).agg(F.sum(F.col("ink") * F.col("n")).alias("ink"), F.max("ink").alias("top"), F.sum("n").alias("columns"))


@query
def a5_ink_fraction(spark, sf):
    return layout.ink_fraction(B.ink_runs(spark, sf), B.pages(spark, sf)).select("page_key", *_r6("fraction"))


@query
def a6_gray_percentile(spark, sf):
    return layout.gray_percentile(B.gray_histogram(spark, sf), 95)


@query
def a7_majority_amount(spark, sf):
    return choose.majority_amount(_valid(spark, sf), B.raw_reads(spark, sf, 2, 3))


@query
def a8_apply_vote(spark, sf):
    best = written(choose.pick_best_read(_valid(spark, sf, 1, 2)), "best-reads")
    asked = best.filter(choose.needs_vote())
    voted = choose.apply_vote(best, choose.majority_amount(asked, B.raw_reads(spark, sf, 3, 4, asked)), ESCALATE)
    return _flat(voted).select("id", "amount", "amount_reconciled", "flags", "status", "model")


@query
def a9_progress(spark, sf):
    raw = _raw(spark, sf).select("pdf_id", "page_index", "key")
    pages = raw.groupBy("pdf_id", "page_index").agg((F.min("key") % 5 != 0).alias("done"))
    return results.progress(pages, raw)


@query
def w1_box_smooth(spark, sf):
    # The same as rounding to six places, without decimals: there is a row for every scan line.
    smooth = F.floor(F.col("smooth") * 1e6 + 0.5) / 1e6
    return lines.smooth_lines(B.ink_blocks(spark, sf), B.pages(spark, sf)).select("page_key", "y", smooth.alias("smooth"))


@query
def w2_bool_runs(spark, sf):
    return lines.lit_runs(B.ink_blocks(spark, sf), B.pages(spark, sf), merge=False)


@query
def w3_merge_runs(spark, sf):
    return lines.lit_runs(B.ink_blocks(spark, sf), B.pages(spark, sf))


@query
def w4_page_max_threshold(spark, sf):
    return lines.lit_lines(B.ink_blocks(spark, sf), B.pages(spark, sf))


@query
def w5_pick_best_read(spark, sf):
    return choose.pick_best_read(_valid(spark, sf, 1, 4)).select("id", "pass", "amount", "status", "confidence", "model")


@query
def w6_keep_last(spark, sf):
    return results.keep_last(B.table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query
def w7_learn_exemplars(spark, sf):
    return _exemplars(spark, sf).select("bank_key", "pos", "amount", "date", "currency", "cheque_number", "seq")


@query
def w8_region_ordinals(spark, sf):
    return layout.region_ordinals(_resolved(spark, sf)).select("id", "page_key", "ordinal", "cheques_on_page")


@query
def w9_display_rank(spark, sf):
    return results.display_rank(_raw(spark, sf).select("id", *results.ORDER)).select("id", "rank")


@query
def o1_order_regions(spark, sf):
    return layout.order_regions(_proposed(spark, sf), ties=("i",)).select("page_key", "ordinal", *_r6(*layout.BOX))


@query
def o2_order_results(spark, sf):
    return results.order_results(_raw(spark, sf).select("id", *results.ORDER))


@query
def o2_locale_order(spark, sf):
    """Ranks under a collation, with file names of mixed case and with accents."""
    names = F.array(*[F.lit(n) for n in ("etude", "Étude", "zeta", "Etude", "alpha", "étude", "Zeta", "Alpha")])
    named = _raw(spark, sf).select("id", F.concat(F.element_at(names, (F.col("key") % 8 + 1).cast("int")), F.lit(" "), F.col("pdf_id")).alias("pdf_id"), "page_index", "cheque_on_page")
    return results.display_rank(named, "UNICODE").select("id", "pdf_id", "rank")


@query
def o3_top_exemplars(spark, sf):
    return exemplars.top_exemplars(_exemplars(spark, sf)).select("bank_key", "pos", "amount", "seq")


@query
def o4_cap_regions(spark, sf):
    numbered = _proposed(spark, sf).withColumn("ordinal", F.row_number().over(Window.partitionBy("page_key").orderBy("i"))).withColumn("flag", F.lit("ok"))
    return layout.cap_regions(numbered).select("page_key", "ordinal", *_r6(*layout.BOX), "flag")


@query
def u1_union_outcomes(spark, sf):
    """How pages came by their regions: pages and regions by flag."""
    pages = _resolved(spark, sf).groupBy("page_key", "flag").agg(F.count("*").alias("n"))
    return pages.groupBy("flag").agg(F.count("*").alias("pages"), F.sum("n").alias("regions"))


@query
def u2_with_error_rows(spark, sf):
    return _flat(_valid(spark, sf)).select(*FIELDS, "model", "error")


@query
def job_find_cheques(spark, sf):
    return cheques.find_cheques(B.ink_blocks(spark, sf), B.pages(spark, sf), B.proposals(spark, sf)).select("id", "page_key", "ordinal", "cheques_on_page", *_r6(*layout.BOX), "flag")


def _read(spark: SparkSession, sf: str) -> DataFrame:
    return cheques.read_cheques(B.raw_reads(spark, sf, 1, 4))


@query
def job_read_cheques(spark, sf):
    return _flat(_read(spark, sf)).select("id", "amount", "amount_reconciled", "currency", "date", "payer", "bank", "cheque_number", "flags", "confidence", "status", "reviewed", "model", "error")


@query
def job_read_responses(spark, sf):
    """From responses of five passes, of which the last is one too many."""
    return _flat(cheques.read_responses(B.responses(spark, sf, 1, 5))).select("id", "amount", "amount_reconciled", "currency", "date", "payer", "bank", "cheque_number", "flags", "confidence", "status", "reviewed", "model", "error")


@query
def job_request_reads(spark, sf):
    """What is to be asked next, where second reads are there for some cheques and one vote for some of those."""
    reads = B.raw_reads(spark, sf, 1, 3).filter("pass = 1 or (pass = 2 and key % 2 = 0) or (pass = 3 and key % 4 = 0)")
    return cheques.request_reads(reads, B.corrections(spark, sf)).select("id", "pass", "model", F.md5("prompt").alias("prompt_md5"))


@query
def job_review_cheques(spark, sf):
    return cheques.review_cheques(_results(spark, sf), B.corrections(spark, sf)).select("id", "rank", "line")


@query
def job_review_stored(spark, sf):
    """The same, from a stored table of results that corrections of two sessions change."""
    path = new_path(spark, "stored-results")
    KeyedTable(spark, path).put(_results(spark, sf))
    fixed = B.corrections(spark, sf)
    middle = fixed.agg(F.expr("percentile_approx(seq, 0.5)").alias("middle")).first().middle or 0
    cheques.review_stored(spark, path, fixed.filter(F.col("seq") <= middle))
    return cheques.review_stored(spark, path, fixed.filter(F.col("seq") > middle)).select("id", "rank", "line")


@query
def s6_save_load(spark, sf):
    path = new_path(spark, "results")
    results.save_results(_results(spark, sf).withColumn("crop", F.lit("x")), path)
    return results.load_results(spark, path).select("id", "amount", "status", "confidence")


@query
def s8_pages_to_ink_runs(spark, sf):
    return raster.pages_to_ink_runs(B.rasters(spark, sf))


#: Batches, at least, that a registered stream takes its rows in.
BATCHES = 6


def _finished(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _landed(df: DataFrame, name: str, kind: str = "parquet") -> tuple[DataFrame, str]:
    """df as a stream of its rows that takes BATCHES batches, and a new folder for what comes of it. Rows are dealt over the files as they come."""
    spark = df.sparkSession
    path, tasks = new_path(spark, name), spark.sparkContext.defaultParallelism
    df.repartition(BATCHES * tasks).write.format(kind).save(f"{path}/in")
    if kind == "text":
        return streams.raw_stream(spark, f"{path}/in", tasks), path
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", tasks).parquet(f"{path}/in"), path


def _repeat_last(spark: SparkSession, checkpoint: str) -> None:
    """Forgets that a stream's last batch was committed, as after a crash: a restarted stream runs it again."""
    fs, at = file_system(spark, checkpoint)
    last = max(int(s.getPath().getName()) for s in fs.listStatus(at(f"{checkpoint}/commits")) if s.getPath().getName().isdigit())
    for name in (f"{last}", f".{last}.crc"):
        fs.delete(at(f"{checkpoint}/commits/{name}"), False)


@query
def t1_stream_validate(spark, sf):
    """Reads land as lines of JSON, every 41st cut off, some files a batch."""
    reads = _raw(spark, sf).select("key", "id", "pass", "model", "error", *[f.name for f in StructType.fromDDL(RAW)])
    line = F.to_json(F.struct(*[c for c in reads.columns if c != "key"]))
    lines = reads.select(F.when(F.col("key") % 41 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line).alias("value"))
    found, path = _landed(lines, "validated-stream", "text")
    _finished(streams.stream_validate(found).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").option("path", f"{path}/out"))
    return _flat(spark.read.parquet(f"{path}/out")).select(*FIELDS, "model", "error")


@query
def t2_stream_upsert(spark, sf):
    """Corrections of the same ids come in all batches, in any order of seq; the last batch comes twice."""
    fixed, path = _landed(B.corrections(spark, sf), "upserted-stream")
    for again in (False, True):
        if again:
            _repeat_last(spark, f"{path}/cp")
        _finished(streams.stream_upsert(fixed, f"{path}/table", f"{path}/cp"))
    return streams.read_table(spark, f"{path}/table").select("id", "seq", "amount", "bank", "cheque_number")


@query
def t3_stream_progress(spark, sf):
    """Update mode: each batch hands on the files that it changed; the last batch comes twice."""
    done = _raw(spark, sf).groupBy(F.col("pdf_id").alias("file"), "page_index").agg(F.count("*").alias("cheques"))
    pages, path = _landed(done, "progress-stream")
    for again in (False, True):
        if again:
            _repeat_last(spark, f"{path}/cp")
        _finished(streams.stream_upsert(streams.stream_progress(pages), f"{path}/table", f"{path}/cp", "file", (), "update"))
    return streams.read_table(spark, f"{path}/table", "file", ())


@query
def t4_stream_exemplars(spark, sf):
    """Corrections in any order of seq, over several batches; equal to w7_learn_exemplars."""
    fixed, path = _landed(B.corrections(spark, sf), "exemplar-stream")
    _finished(streams.stream_upsert(streams.stream_exemplars(fixed), f"{path}/table", f"{path}/cp", "slot", (), "update"))
    slots = streams.read_table(spark, f"{path}/table", "slot", ())
    return streams.exemplars_of(slots).select("bank_key", "pos", "amount", "date", "currency", "cheque_number", "seq")


@query
def f1_map_bounded(spark, sf):
    kind = "key long, twice long, bank string"
    return map_bounded(_raw(spark, sf).select("key", "bank"), lambda r: {"key": r["key"], "twice": 2 * r["key"], "bank": r["bank"].upper()}, 4, kind)
