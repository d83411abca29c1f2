"""Finding cheques on pages: ink runs -> row profile -> bands -> column profile -> boxes.

Pixels are never exploded: a page is a table of ink runs (page_key, y, x0, x1), disjoint within a scan line, beside
pages (page_key, width, height). All steps are grouped or windowed by keys that begin with page_key, so one exchange by page_key serves the
whole cascade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from draftmill.functions import columns as C
from draftmill.functions.tables import MAX_CHEQUES
from draftmill.operators import lines

PAGE = ("page_key", "width", "height")
BOX = ("x0", "y0", "x1", "y1")
MIN_INK, MIN_SIDE = 0.002, 10


def ink_fraction(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, fraction): ink pixels of all pixels; 0 for pages without a run."""
    ink = runs.groupBy("page_key").agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))
    return pages.join(ink, "page_key", "left").select("page_key", (F.coalesce("ink", F.lit(0)) / (F.col("width") * F.col("height"))).alias("fraction"))


def page_profiles(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, width, height, upto): for each page an array of running sums of ink, one for each scan line. Only lines with ink are grouped;
    the gaps between them are filled in within the page."""
    ink = runs.groupBy("page_key", F.col("y").cast("int").alias("y")).agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"))
    upto = F.sum("ink").over(Window.partitionBy("page_key").orderBy("y"))
    own = ink.withColumn("upto", upto).groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("y", "upto"))).alias("own"))
    d = pages.select(*PAGE).filter("height > 0").join(own, "page_key", "left")
    ends = F.concat(F.filter("own", lambda x: (x["y"] >= 0) & (x["y"] < F.col("height"))), F.array(F.struct(F.col("height").alias("y"), F.lit(0).cast("long").alias("upto"))))
    none = F.array().cast("array<struct<y: int, upto: bigint>>")
    d = d.withColumn("own", F.coalesce("own", none)).withColumn("own", ends)

    def stretch(x: Column, i: Column) -> Column:
        """The sums from this line with ink to the next."""
        following = F.get("own", i + 1)["y"]
        return F.array_repeat(x["upto"], following - x["y"])

    before = F.array_repeat(F.lit(0).cast("long"), F.get("own", F.lit(0))["y"])
    filled = F.flatten(F.transform(F.slice("own", F.lit(1), F.size("own") - 1), stretch))
    return d.select(*PAGE, F.concat(before, filled).alias("upto"))


def row_profile(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, width, height, y, ink) for every scan line of every page."""
    ink = F.transform("upto", lambda x, i: x - F.coalesce(F.get("upto", i - 1), F.lit(0)))
    # The outer forms of explode and inline: for the others a filter on the array's size is put below the steps that make it, and repeats them.
    return page_profiles(runs, pages).select(*PAGE, F.posexplode_outer(ink).alias("y", "ink"))


def smooth_window(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(size * 0.012)).cast("int")


def box_smooth(profile: DataFrame, win: Column, pos: str = "y", value: str = "ink", keys: tuple[str, ...] = PAGE) -> DataFrame:
    """profile with `smooth`: the mean of `value` over floor(win / 2) positions on either side, clipped at the ends. The window's width
    may differ from page to page: a running sum, gathered per page, is looked up at both ends."""
    running = F.sum(value).over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    p = profile.withColumns({"__half": F.when(win <= 1, 0).otherwise(F.floor(win / 2)).cast("int"), "__p": running})
    gathered = p.groupBy(*keys, "__half").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(value).alias("v"), F.col("__p").alias("p")))).alias("a"))

    def mean(a: Column) -> Column:
        n = F.size(a)

        def one(x: Column, i: Column) -> Column:
            low, high = F.greatest(F.lit(0), i - F.col("__half")), F.least(n, i + F.col("__half") + 1)
            before = F.when(low > 0, F.get(a, low - 1)["p"]).otherwise(0)
            return F.struct(x["pos"].alias("pos"), x["v"].alias("v"), ((F.get(a, high - 1)["p"] - before) / (high - low)).alias("s"))

        return F.transform(a, one)

    return gathered.select(*keys, F.inline(C.let(F.col("a"), mean))).select(*keys, F.col("pos").alias(pos), F.col("v").alias(value), F.col("s").alias("smooth"))


def page_max_threshold(df: DataFrame, value: str, keys: tuple[str, ...], default: float | None = None) -> DataFrame:
    """df with `on`: value above 0.02 and above 6 % of the greatest of its page (or band); a greatest value of 0 counts as `default`."""
    top = F.max(value).over(Window.partitionBy(*keys))
    if default is not None:
        top = F.when(top == 0, default).otherwise(top)
    return df.withColumn("on", F.col(value) > F.greatest(F.lit(0.02), 0.06 * top))


def bool_runs(on: DataFrame, keys: tuple[str, ...], pos: str = "y") -> DataFrame:
    """(keys, start, end): maximal runs of the positions in `on`, ends exclusive."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    return on.withColumn("__g", island).groupBy(*keys, "__g").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("__g")


def merge_runs(runs: DataFrame, keys: tuple[str, ...], gap: Column) -> DataFrame:
    """Runs that lie at most `gap` apart, joined."""
    order = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(order) <= gap, 0).otherwise(1)
    d = runs.withColumn("__n", new).withColumn("__g", F.sum("__n").over(order))
    return d.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def bands(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, y0, y1): bands of ink rows, gutters merged, those under 6 % of the height left out. The steps of box_smooth, page_max_threshold,
    bool_runs and merge_runs on a page's lines as one array: lines are neither exploded nor sorted; each step is a column of its own."""
    h = F.col("height")
    win = smooth_window(h)
    d = page_profiles(runs, pages).withColumn("half", F.when(win <= 1, 0).otherwise(F.floor(win / 2)).cast("int"))

    def share(i: Column) -> Column:
        low, high = F.greatest(F.lit(0), i - F.col("half")), F.least(h, i + F.col("half") + 1)
        return (F.get("upto", high - 1) - F.coalesce(F.get("upto", low - 1), F.lit(0))) / (high - low) / F.col("width")

    d = d.withColumn("share", F.transform(F.sequence(F.lit(0), h - 1), share))
    d = d.withColumn("on", C.let(F.greatest(F.lit(0.02), 0.06 * F.array_max("share")), lambda least: F.transform("share", lambda s: s > least)))
    on = lambda i: F.coalesce(F.get("on", i), F.lit(False))
    d = d.withColumn("start", F.filter(F.sequence(F.lit(0), h - 1), lambda i: on(i) & ~on(i - 1))).withColumn("end", F.filter(F.sequence(F.lit(1), h), lambda i: on(i - 1) & ~on(i)))
    gutter = F.greatest(F.lit(2), F.floor(h * 0.012))
    apart = lambda k: F.coalesce(F.get("start", k) - F.get("end", k - 1) > gutter, F.lit(True))
    d = d.withColumn("bands", F.arrays_zip(F.filter("start", lambda s, k: apart(k)).alias("y0"), F.filter("end", lambda e, k: apart(k + 1)).alias("y1")))
    tall = F.col("y1") - F.col("y0") >= F.greatest(F.lit(4), F.floor(h * 0.06))
    return d.select(*PAGE, F.inline_outer("bands").alias("y0", "y1")).filter(tall)


BAND = (*PAGE, "band_y0", "band_y1")


def band_column_profile(runs: DataFrame, bands_: DataFrame) -> DataFrame:
    """(band, start, end, ink): stretches of columns with the same number of ink rows in the band, by a difference array: work in
    proportion to the runs, not to the pixels."""
    b = bands_.select(*PAGE, F.col("y0").alias("band_y0"), F.col("y1").alias("band_y1"))
    inside = runs.join(b, "page_key").filter((F.col("y") >= F.col("band_y0")) & (F.col("y") < F.col("band_y1")))
    steps = inside.select(*BAND, F.inline(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))))
    order = Window.partitionBy(*BAND).orderBy("x")
    d = steps.groupBy(*BAND, "x").agg(F.sum("d").alias("d")).withColumns({"ink": F.sum("d").over(order), "end": F.lead("x").over(order)})
    return d.filter("end is not null").select(*BAND, F.col("x").alias("start"), "end", "ink")


def split_band_columns(profile: DataFrame) -> DataFrame:
    """(band, x0, x1, ambiguous): one box a band, or one for each of two or more wide blocks side by side. Ambiguous: bands split so, narrow
    or taller than wide."""
    share = profile.withColumn("share", F.col("ink") / (F.col("band_y1") - F.col("band_y0")))
    runs = merge_runs(page_max_threshold(share, "share", BAND, 1.0).filter("on"), BAND, F.lit(0))
    whole = Window.partitionBy(*BAND)
    edges = runs.withColumns({"left": F.min("start").over(whole), "right": F.max("end").over(whole)})
    keys = (*BAND, "left", "right")
    blocks = merge_runs(edges, keys, F.greatest(F.lit(2), F.floor(F.col("width") * 0.04)))
    wide = F.col("end") - F.col("start") >= F.col("width") * 0.28
    per_band = blocks.groupBy(*keys).agg(F.filter(F.collect_list(F.when(wide, F.struct("start", "end"))), lambda x: x.isNotNull()).alias("b"))
    band_w = F.col("right") - F.col("left")
    split = F.size("b") >= 2
    odd = split | (band_w < F.col("width") * 0.4) | (F.col("band_y1") - F.col("band_y0") > band_w)
    boxes = F.when(split, F.col("b")).otherwise(F.array(F.struct(F.col("left").alias("start"), F.col("right").alias("end"))))
    return per_band.select(*BAND, odd.alias("ambiguous"), F.inline(boxes)).select(*BAND, F.col("start").alias("x0"), F.col("end").alias("x1"), "ambiguous")


def pad_and_filter_boxes(boxes: DataFrame) -> DataFrame:
    """Pixel boxes (x0, y0, x1, y1) as fractions of the page, 1 % wider each way; `wide` tells those large enough to keep."""
    w, h = F.col("width"), F.col("height")
    d = boxes.withColumns({
        "x0": F.greatest(F.lit(0.0), (F.col("x0") - w * 0.01) / w), "y0": F.greatest(F.lit(0.0), (F.col("y0") - h * 0.01) / h),
        "x1": F.least(F.lit(1.0), (F.col("x1") + w * 0.01) / w), "y1": F.least(F.lit(1.0), (F.col("y1") + h * 0.01) / h),
    })
    return d.withColumn("wide", (F.col("x1") - F.col("x0") > 0.05) & (F.col("y1") - F.col("y0") > 0.03))


def order_regions(regions: DataFrame, key: str = "page_key", ties: tuple[str, ...] = ("i",)) -> DataFrame:
    """regions with `ordinal`, from 1: by top, then left, both to a hundredth; what is equal in both keeps its order (`ties`: its place before)."""
    order = Window.partitionBy(key).orderBy(C.round2(F.col("y0")), C.round2(F.col("x0")), *ties)
    return regions.withColumn("ordinal", F.row_number().over(order))


def regions_overlap_badly(regions: DataFrame, key: str = "page_key") -> DataFrame:
    """(key, bad): whether two regions of a page share over half of the lesser height and 0.3 of the lesser width. A page has at most
    MAX_CHEQUES regions when this is asked, so the pairs of a page are few."""
    a = regions.select(key, F.col("ordinal").alias("i"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = regions.select(key, F.col("ordinal").alias("j"), *[F.col(c).alias(f"b_{c}") for c in BOX])

    def shared(p: str, q: str) -> tuple[Column, Column]:
        over = F.greatest(F.lit(0.0), F.least(f"a_{q}", f"b_{q}") - F.greatest(f"a_{p}", f"b_{p}"))
        return over, F.least(F.col(f"a_{q}") - F.col(f"a_{p}"), F.col(f"b_{q}") - F.col(f"b_{p}"))

    (v, vmin), (h, hmin) = shared("y0", "y1"), shared("x0", "x1")
    bad = F.when((vmin > 0) & (hmin > 0), (v / vmin > 0.5) & (h / hmin > 0.3)).otherwise(False)
    pairs = a.join(b, key).filter("i < j").groupBy(key).agg(F.max(bad).alias("bad"))
    return regions.select(key).distinct().join(pairs, key, "left").select(key, F.coalesce("bad", F.lit(False)).alias("bad"))


def _keyed(box: Column, place: Column, nth: Column | int = 0) -> Column:
    """A box with its sort key before it, so that sorting an array of them is the order of regions; place, then nth: where it stood before."""
    nth = F.lit(nth) if isinstance(nth, int) else nth
    return F.struct(C.round2(box["y0"]).alias("top"), C.round2(box["x0"]).alias("left"), place.cast("int").alias("place"), nth.cast("int").alias("nth"), *[box[c].alias(c) for c in BOX])


def _full_page() -> Column:
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip(BOX, (0.0, 0.0, 1.0, 1.0), strict=True)])
    return F.array(_keyed(box, F.lit(0)))


def _any_clash(boxes: Column) -> Column:
    """As regions_overlap_badly, for the boxes of one page in an array."""

    def clash(a: Column, b: Column) -> Column:
        def share(p: str, q: str) -> tuple[Column, Column]:
            return F.greatest(F.lit(0.0), F.least(a[q], b[q]) - F.greatest(a[p], b[p])), F.least(a[q] - a[p], b[q] - b[p])

        (v, vmin), (h, hmin) = share("y0", "y1"), share("x0", "x1")
        return F.when((vmin > 0) & (hmin > 0), (v / vmin > 0.5) & (h / hmin > 0.3)).otherwise(False)

    return F.exists(F.transform(boxes, lambda a, i: F.exists(F.slice(boxes, i + 2, F.lit(MAX_CHEQUES)), lambda b: clash(a, b))), lambda x: x)


def detect_regions(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, ordinal, x0, y0, x1, y1, flag): the boxes of a page and 'single', 'ok' or 'ambiguous'. Every page has a row; a page that is small,
    blank or holds one box is its own single region, as is, ambiguous, one with more than MAX_CHEQUES. A page's runs are gathered once, and its
    boxes, a few dozen at most, are judged as an array. Runs may span lines (lines.gathered)."""
    w, h = F.col("width"), F.col("height")

    def padded(b: Column) -> Column:
        box = F.struct(
            F.greatest(F.lit(0.0), (b["x0"] - w * 0.01) / w).alias("x0"), F.greatest(F.lit(0.0), (b["y0"] - h * 0.01) / h).alias("y0"),
            F.least(F.lit(1.0), (b["x1"] + w * 0.01) / w).alias("x1"), F.least(F.lit(1.0), (b["y1"] + h * 0.01) / h).alias("y1"),
        )
        return _keyed(box, b["y0"], b["x0"])

    d = lines.page_boxes(runs, pages)
    blank = (w < MIN_SIDE) | (h < MIN_SIDE) | (F.col("ink") / F.greatest(w.cast("long") * h, F.lit(1)) < MIN_INK)
    kept = F.filter(F.transform("boxes", padded), lambda b: (b["x1"] - b["x0"] > 0.05) & (b["y1"] - b["y0"] > 0.03))
    none = F.array().cast("array<struct<top: double, left: double, place: int, nth: int, x0: double, y0: double, x1: double, y1: double>>")
    d = d.select("page_key", F.exists("boxes", lambda b: b["odd"]).alias("odd"), F.when(blank, none).otherwise(F.array_sort(kept)).alias("b")).withColumn("n", F.size("b"))
    flag = F.when(F.col("n") <= 1, "single").when((F.col("n") > MAX_CHEQUES) | F.col("odd"), "ambiguous").when(_any_clash(F.col("b")), "ambiguous").otherwise("ok")
    regions = F.when(F.col("n").between(2, MAX_CHEQUES), F.col("b")).otherwise(_full_page())
    out = d.select("page_key", flag.alias("flag"), F.posexplode(regions).alias("i", "r"))
    return out.select("page_key", (F.col("i") + 1).alias("ordinal"), *[F.col(f"r.{c}").alias(c) for c in BOX], "flag")


def cap_regions(regions: DataFrame, most: int = MAX_CHEQUES) -> DataFrame:
    """Pages with more than `most` regions become one full page, ambiguous."""
    n = F.count("*").over(Window.partitionBy("page_key"))
    d = regions.withColumn("n", n).filter((F.col("n") <= most) | (F.col("ordinal") == 1))
    many = F.col("n") > most
    full = dict(zip(BOX, (0.0, 0.0, 1.0, 1.0), strict=True))
    return d.select("page_key", "ordinal", *[F.when(many, full[c]).otherwise(F.col(c)).alias(c) for c in BOX], F.when(many, "ambiguous").otherwise(F.col("flag")).alias("flag"))


def resolve_page_regions(classical: DataFrame, proposals: DataFrame) -> DataFrame:
    """(page_key, ordinal, x0, y0, x1, y1, flag): single pages whole; ok pages by their boxes; ambiguous ones by two or more proposals, else whole.
    proposals: (page_key, boxes). Every page keeps at least one region."""
    own = classical.groupBy("page_key").agg(F.max("flag").alias("flag"), F.collect_list(_keyed(F.struct(*BOX), F.col("ordinal"))).alias("b"))
    given = proposals.select("page_key", F.transform(C.normalize_proposals(F.col("boxes")), lambda b, i: _keyed(b, i)).alias("p"))
    d = own.join(given, "page_key", "left")
    asked = (F.col("flag") == "ambiguous") & F.coalesce(F.size("p") >= 2, F.lit(False))
    regions = F.when(F.col("flag") == "ok", F.col("b")).when(asked, F.col("p")).otherwise(_full_page())
    out = d.select("page_key", "flag", F.posexplode(F.array_sort(regions)).alias("i", "r"))
    return out.select("page_key", (F.col("i") + 1).alias("ordinal"), *[F.col(f"r.{c}").alias(c) for c in BOX], "flag")


def region_ordinals(regions: DataFrame) -> DataFrame:
    """regions with cheques_on_page and id."""
    n = F.count("*").over(Window.partitionBy("page_key")).cast("int")
    return regions.withColumns({"cheques_on_page": n, "id": F.concat_ws(":", "page_key", "ordinal")})


#: Scan lines of a band in which runs and regions meet.
MEETING = 32


def _met(runs: DataFrame, regions: DataFrame, pages: DataFrame, band: int) -> DataFrame:
    """Runs beside the regions (r, in pixels) of their page that reach into their band of scan lines. Regions, and runs that span lines, are written to
    each of their bands; a run is cut there."""
    box = F.struct(*BOX)
    r = regions.join(pages.select(*PAGE), "page_key")
    whole = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").cast("int").alias("x1"), F.col("height").cast("int").alias("y1"))
    r = r.select("page_key", "ordinal", F.when(C.is_full_page(box), whole).otherwise(C.region_to_pixels(box, F.col("width"), F.col("height"))).alias("r")).filter("r.y0 < r.y1")
    nth = lambda y: F.floor(y / band)
    r = r.withColumn("band", F.explode(F.sequence(nth(F.col("r.y0")), nth(F.col("r.y1") - 1))))
    y1 = F.col("y1") if "y1" in runs.columns else F.col("y") + 1
    cut = runs.select("page_key", F.col("y").alias("from"), y1.alias("upto"), "x0", "x1").filter(F.col("from") < F.col("upto"))
    cut = cut.withColumn("band", F.explode(F.sequence(nth(F.col("from")), nth(F.col("upto") - 1))))
    cut = cut.select("page_key", "band", F.greatest("from", F.col("band") * band).cast("int").alias("y"), F.least("upto", (F.col("band") + 1) * band).cast("int").alias("y1"), "x0", "x1")
    return cut.join(r, ["page_key", "band"])


def crop_runs(runs: DataFrame, regions: DataFrame, pages: DataFrame, band: int = MEETING) -> DataFrame:
    """(page_key, ordinal, y, x0, x1): the ink of each region, from the region's own corner; a full page is taken whole. A join by page and band of
    scan lines: what is compared is in proportion to what is hit, however many regions a page has. Runs may span lines: they meet regions as they
    are, and only what is hit is written line by line."""
    hit = (F.col("y1") > F.col("r.y0")) & (F.col("y") < F.col("r.y1")) & (F.col("x0") < F.col("r.x1")) & (F.col("x1") > F.col("r.x0"))
    clipped = _met(runs, regions, pages, band).filter(hit)
    lines_of = F.sequence(F.greatest("y", "r.y0") - F.col("r.y0"), F.least("y1", "r.y1") - F.col("r.y0") - 1)
    return clipped.select("page_key", "ordinal", F.explode(lines_of).alias("y"), (F.greatest("x0", "r.x0") - F.col("r.x0")).alias("x0"), (F.least("x1", "r.x1") - F.col("r.x0")).alias("x1"))


def gray_percentile(hist: DataFrame, pct: float, keys: tuple[str, ...] = ("page_key",)) -> DataFrame:
    """(keys, level): from (keys, gray, n), the smallest gray level with at least pct percent of the pixels at or below it."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("gray"))
    all_ = F.sum("n").over(Window.partitionBy(*keys))
    d = hist.withColumns({"upto": upto, "all": all_}).filter(F.col("upto") >= pct / 100 * F.col("all"))
    return d.groupBy(*keys).agg(F.min("gray").alias("level"))
