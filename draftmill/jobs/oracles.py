"""The queries' SQL, written apart from the operators, for comparison on the same tables."""

from __future__ import annotations

from draftmill.functions.tables import BANKS, CURRENCY_HINTS, DEFAULT_ROIS, EASTERN, MAGNITUDES, MONTHS, SMALL, WESTERN
from draftmill.sources import bridge as B


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain_of(x: str, rows, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({x}, '')), {q(p)})" for p in parts) + f" THEN {q(v) if isinstance(v, str) else v}" for v, parts in rows) + f" ELSE {default} END"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def fmt(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '' ELSE printf('%.2f', {x}) END"


def bank_key(x: str) -> str:
    return chain_of(x, [(b[0], b[1]) for b in BANKS], "''")


def exemplar_key(x: str) -> str:
    return f"CASE WHEN {bank_key(x)} <> '' THEN {bank_key(x)} ELSE {trim(f'lower({x})')} END"


def raw(first: int = 1, last: int = 1) -> str:
    return B.sql(f"SELECT o.*, CAST(s.p AS BIGINT) AS p FROM ({B.SOURCES['raw_reads']}) AS o, range({first}, {last + 1}) AS s(p)", B.RAW_READS)


VALUES = lambda t: ", ".join(f"({q(w)}, CAST({n} AS DOUBLE))" for w, n in t.items())
AMOUNT = rf"""
  west AS (SELECT *, regexp_replace(translate(amount_numeric, {q(EASTERN)}, {q(WESTERN)}), '[^0-9.,-]', '', 'g') AS s FROM raw),
  plain AS (SELECT *, CASE WHEN instr(s, ',') > 0 AND (instr(s, '.') = 0 OR instr(reverse(s), ',') < instr(reverse(s), '.'))
    THEN replace(regexp_replace(replace(s, '.', ''), ',', '.'), ',', '') ELSE replace(s, ',', '') END AS t FROM west),
  amounts AS (SELECT *, CASE WHEN regexp_full_match(t, '-?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN TRY_CAST(t AS DOUBLE) END AS num FROM plain)"""
WORDS = rf"""
  small(w, n) AS (VALUES {VALUES(SMALL)}), mags(w, n) AS (VALUES {VALUES(MAGNITUDES)}),
  toks AS (SELECT DISTINCT amount_words AS aw, list_filter(string_split_regex(regexp_replace(lower(amount_words), '[,-]', ' ', 'g'), '\s+'), lambda x: x <> '') AS toks FROM raw WHERE amount_words IS NOT NULL),
  walk AS (
    SELECT aw, toks, 1 AS i, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS cur, CAST(0 AS DOUBLE) AS part, false AS hit FROM toks
    UNION ALL
    SELECT aw, toks, i + 1, CASE WHEN m.n IS NOT NULL THEN total + CASE WHEN cur = 0 THEN 1 ELSE cur END * m.n ELSE total END,
      CASE WHEN s.n IS NOT NULL THEN cur + s.n WHEN toks[i] = 'hundred' THEN CASE WHEN cur = 0 THEN 1 ELSE cur END * 100 WHEN m.n IS NOT NULL THEN 0 ELSE cur END,
      CASE WHEN regexp_full_match(toks[i], '[0-9]{{1,2}}/100') THEN CAST(split_part(toks[i], '/', 1) AS DOUBLE) / 100 ELSE part END,
      hit OR s.n IS NOT NULL OR m.n IS NOT NULL OR toks[i] = 'hundred' OR regexp_full_match(toks[i], '[0-9]{{1,2}}/100')
    FROM walk LEFT JOIN small s ON s.w = toks[i] LEFT JOIN mags m ON m.w = toks[i] WHERE i <= len(toks)
  ),
  spoken AS (SELECT aw, CASE WHEN hit THEN total + cur + part END AS spoken FROM walk WHERE i = len(toks) + 1)"""
_MONTH = "CASE substr(regexp_extract(ds, '[a-z]{3,}'), 1, 3) " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(MONTHS)) + " END"
_PIVOT = lambda y: f"CASE WHEN {y} < 70 THEN {y} + 2000 WHEN {y} < 100 THEN {y} + 1900 ELSE {y} END"
DATE = rf"""
  days AS (SELECT *, coalesce({trim('date')}, '') AS raw_date, lower(translate(coalesce({trim('date')}, ''), {q(EASTERN)}, {q(WESTERN)})) AS ds FROM raw),
  split AS (SELECT *, regexp_matches(ds, '[0-9]{{1,4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,4}}') AS numeric_date, regexp_extract_all(ds, '[0-9]{{1,4}}') AS nums,
    TRY_CAST(regexp_extract(ds, '([0-9]{{1,4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,4}})', 1) AS INT) AS a, TRY_CAST(regexp_extract(ds, '([0-9]{{1,4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,4}})', 2) AS INT) AS b,
    TRY_CAST(regexp_extract(ds, '([0-9]{{1,4}})[./-]([0-9]{{1,2}})[./-]([0-9]{{1,4}})', 3) AS INT) AS c3 FROM days),
  named AS (SELECT *, CASE WHEN numeric_date THEN CASE WHEN a > 31 THEN a ELSE {_PIVOT('c3')} END WHEN len(nums) >= 2 THEN {_PIVOT('CAST(nums[-1] AS INT)')} END AS yy,
    CASE WHEN numeric_date THEN b ELSE {_MONTH} END AS mm, CASE WHEN numeric_date THEN CASE WHEN a > 31 THEN c3 ELSE a END WHEN len(nums) >= 2 THEN CAST(nums[1] AS INT) END AS dd FROM split),
  dates AS (SELECT key, id, pass, raw_date, CASE WHEN yy BETWEEN 1900 AND 2200 AND mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND 31 AND TRY_CAST(printf('%04d-%02d-%02d', yy, mm, dd) AS DATE) IS NOT NULL
    THEN printf('%04d-%02d-%02d', yy, mm, dd) END AS iso FROM named)"""


def validated(first: int = 1, last: int = 1, blank_errors: bool = True, source: str = "") -> str:
    """WITH ... as far as `v`, the validated reads. flags: texts field:severity:reason, in a list."""
    source = source or raw(first, last)
    if blank_errors:
        fields = ("amount_numeric", "amount_words", "amount_words_value", "currency", "date", "payer", "bank", "cheque_number", "has_handwriting", "conf_amount", "conf_payer")
        source = f"SELECT * REPLACE ({', '.join(f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in fields)}) FROM ({source})"
    flag = lambda cond, s: f"CASE WHEN {cond} THEN {s} END"
    flags = ", ".join([
        flag("num IS NOT NULL AND words IS NOT NULL AND NOT rec", f"'amount:high:Digits (' || {fmt('num')} || ') and words (' || {fmt('words')} || ') disagree'"),
        flag("num IS NULL AND words IS NULL", "'amount:high:No amount detected'"),
        flag("(num IS NULL) <> (words IS NULL)", "'amount:low:Only one of digits/words present; cannot cross-check'"),
        flag("amount <> '' AND rec AND coalesce(conf_amount, 1) < 0.7", "'amount:low:Model low confidence on amount'"),
        flag("raw_date <> '' AND iso IS NULL", "'date:high:Date does not parse to a valid calendar date'"),
        flag("number = ''", "'chequeNumber:high:No cheque number detected'"),
        flag("number <> '' AND length(number) <> 8", "'chequeNumber:high:Expected 8 digits, got ' || length(number)"),
        flag("payer_t = ''", "'payer:low:Payer not detected'"),
        flag("payer_t <> '' AND coalesce(conf_payer, 1) < 0.6", "'payer:low:Model low confidence on payer'"),
        flag("bank_t = ''", "'bank:low:Bank not detected'"),
    ])
    t = lambda c: f"coalesce({trim(c)}, '')"
    return rf"""WITH RECURSIVE raw AS ({source}), {AMOUNT}, {WORDS}, {DATE},
  v1 AS (SELECT a.*, raw_date, iso, coalesce(amount_words_value, spoken) AS words, {t('payer')} AS payer_t, {t('bank')} AS bank_t, {t('currency')} AS cur_t, {t('amount_words')} AS words_t,
    coalesce(substr(regexp_replace(translate(cheque_number, {q(EASTERN)}, {q(WESTERN)}), '[^0-9]', '', 'g'), 1, 8), '') AS number
    FROM amounts a JOIN dates d ON a.key = d.key AND a.pass = d.pass LEFT JOIN spoken w ON w.aw = a.amount_words),
  v2 AS (SELECT *, coalesce(abs(num - words) < CAST(0.01 AS DOUBLE) OR abs(num - words) / greatest(abs(num), abs(words), 1) < CAST(0.005 AS DOUBLE), false) AS rec FROM v1),
  v3 AS (SELECT *, {fmt('CASE WHEN rec THEN num ELSE coalesce(words, num) END')} AS amount, CASE WHEN cur_t <> '' THEN cur_t ELSE {chain_of('bank_t', CURRENCY_HINTS, "''")} END AS cur_v,
    CASE WHEN raw_date = '' THEN 'HANDOVER PAYMENT' ELSE coalesce(iso, raw_date) END AS date_v FROM v2),
  v4 AS (SELECT *, list_filter([{flags}], lambda x: x IS NOT NULL) AS fl FROM v3),
  v5 AS (SELECT *, len(list_filter(fl, lambda x: contains(x, ':high:'))) AS high,
    greatest(0, (CASE WHEN amount <> '' THEN 3 ELSE 0 END + CASE WHEN raw_date <> '' THEN 3 ELSE 0 END + CASE WHEN payer_t <> '' THEN 1 ELSE 0 END + CASE WHEN bank_t <> '' THEN 1.5 ELSE 0 END
      + CASE WHEN length(number) = 8 THEN 1.5 ELSE 0 END) - CASE WHEN num IS NOT NULL AND words IS NOT NULL AND NOT rec THEN 2 ELSE 0 END) AS found FROM v4),
  v AS (SELECT id, pdf_id, page_index, cheque_on_page, key, pass, amount, words_t AS amount_words, num AS amount_numeric_value, words AS amount_words_value, rec AS amount_reconciled, cur_v AS currency, date_v AS date,
    payer_t AS payer, bank_t AS bank, number AS cheque_number, coalesce(has_handwriting, false) AS has_handwriting, fl, array_to_string(fl, ' | ') AS flags, CAST(high AS INT) AS high,
    CAST(floor(greatest(0, found - 0.5 * high) * 10 + 0.5) AS INT) AS confidence, CASE WHEN error IS NOT NULL THEN 'error' WHEN high > 0 THEN 'review' ELSE 'ok' END AS status, model, error FROM v5)"""


FIELDS = "id, pass, amount, amount_words, amount_numeric_value, amount_words_value, amount_reconciled, currency, date, payer, bank, cheque_number, has_handwriting, flags, confidence, status"
SCORE = "CASE WHEN amount_reconciled THEN 1000 ELSE 0 END - 100 * high + confidence"
BEST = f", best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass > 1 AND error IS NOT NULL, {SCORE} DESC, pass) = 1)"
SCALARS = f"WITH RECURSIVE raw AS ({raw()}), {AMOUNT}, {WORDS}, {DATE} "
CORR = f"corr AS ({B.sql('SELECT * FROM events', B.CORRECTIONS)})"
LAST = ", last AS (SELECT * FROM corr QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
EXEMPLARS = f""", keyed AS (SELECT *, {exemplar_key('bank')} AS bank_key FROM corr), fresh AS (SELECT * FROM keyed WHERE bank_key <> '' AND amount <> '' QUALIFY row_number() OVER (PARTITION BY bank_key, amount, date ORDER BY seq DESC) = 1),
  ex AS (SELECT *, CAST(row_number() OVER (PARTITION BY bank_key ORDER BY seq DESC) AS INT) AS pos FROM fresh QUALIFY pos <= 3)"""
CSV_COLS = [("pdf_id || '.pdf'", 0), ("page_index", 0), ("cheque_on_page", 0), ("n", 0), ("amount", 0), ("currency", 0), ("amount_reconciled", 0), ("amount_words", 0), ("date", 0), ("payer", 0), ("bank", 0), ("cheque_number", 0), ("has_handwriting", 0), ("confidence", 0), ("status", 0), ("model", 0), ("reviewed", 0), ("error", 0), ("flags", 0)]
CELL = lambda x: f"CASE WHEN regexp_matches(coalesce(CAST({x} AS VARCHAR), ''), '[\",\\n]') THEN '\"' || replace(CAST({x} AS VARCHAR), '\"', '\"\"') || '\"' ELSE coalesce(CAST({x} AS VARCHAR), '') END"

RUNS = f"""rect AS ({B.sql(B.SOURCES['rectangles'], B.RECTANGLES)}), pages AS ({B.sql(B.SOURCES['pages'], B.PAGES)}),
  lines AS (SELECT page_key, CAST(unnest(range(CAST(top AS BIGINT), CAST(low AS BIGINT))) AS INT) AS y, x0, x1, mid, halves FROM rect),
  runs AS (SELECT * FROM (SELECT page_key, y, x0, CASE WHEN halves THEN mid - 8 ELSE x1 END AS x1 FROM lines UNION ALL SELECT page_key, y, mid + 8, x1 FROM lines WHERE halves) AS t WHERE x0 < x1)"""
PROFILE = """, full_rows AS (SELECT page_key, width, height, CAST(unnest(range(height)) AS INT) AS y FROM pages),
  ink AS (SELECT page_key, y, sum(x1 - x0) AS ink FROM runs GROUP BY ALL),
  profile AS (SELECT page_key, width, height, y, CAST(coalesce(ink, 0) AS BIGINT) AS ink FROM full_rows LEFT JOIN ink USING (page_key, y))"""
SMOOTH = """, half AS (SELECT *, CASE WHEN greatest(1, floor(height * CAST(0.012 AS DOUBLE))) <= 1 THEN 0 ELSE CAST(floor(floor(height * CAST(0.012 AS DOUBLE)) / 2) AS INT) END AS half FROM profile),
  smooth AS (SELECT page_key, width, height, y, ink, avg(ink) OVER (PARTITION BY page_key ORDER BY y ROWS BETWEEN half PRECEDING AND half FOLLOWING) AS smooth FROM half),
  lit AS (SELECT *, smooth / width > greatest(CAST(0.02 AS DOUBLE), CAST(0.06 AS DOUBLE) * max(smooth / width) OVER (PARTITION BY page_key)) AS lit FROM smooth)"""
ROW_RUNS = """, island AS (SELECT *, y - row_number() OVER (PARTITION BY page_key ORDER BY y) AS g FROM lit WHERE lit),
  row_runs AS (SELECT page_key, width, height, min(y) AS s, max(y) + 1 AS e FROM island GROUP BY page_key, width, height, g)"""
BANDS = """, stepped AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY page_key ORDER BY s) <= greatest(2, floor(height * CAST(0.012 AS DOUBLE))) THEN 0 ELSE 1 END AS fresh FROM row_runs),
  grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY page_key ORDER BY s) AS g FROM stepped),
  merged AS (SELECT page_key, width, height, min(s) AS y0, max(e) AS y1 FROM grouped GROUP BY page_key, width, height, g),
  bands AS (SELECT * FROM merged WHERE y1 - y0 >= greatest(4, floor(height * CAST(0.06 AS DOUBLE))))"""
COLUMNS = """, pixel AS (SELECT b.page_key, width, height, b.y0, b.y1, unnest(range(r.x0, r.x1)) AS x FROM bands b JOIN runs r ON r.page_key = b.page_key AND r.y >= b.y0 AND r.y < b.y1),
  cols AS (SELECT page_key, width, height, y0, y1, CAST(x AS INT) AS x, count(*) AS ink FROM pixel GROUP BY ALL)"""
BOXES = """, col_on AS (SELECT *, ink / (y1 - y0) > greatest(CAST(0.02 AS DOUBLE), CAST(0.06 AS DOUBLE) * max(ink / (y1 - y0)) OVER (PARTITION BY page_key, y0)) AS lit FROM cols),
  col_island AS (SELECT *, x - row_number() OVER (PARTITION BY page_key, y0 ORDER BY x) AS g FROM col_on WHERE lit),
  col_runs AS (SELECT page_key, width, height, y0, y1, min(x) AS s, max(x) + 1 AS e FROM col_island GROUP BY page_key, width, height, y0, y1, g),
  col_step AS (SELECT *, min(s) OVER w AS le, max(e) OVER w AS ri, CASE WHEN s - lag(e) OVER (PARTITION BY page_key, y0 ORDER BY s) <= greatest(2, floor(width * CAST(0.04 AS DOUBLE))) THEN 0 ELSE 1 END AS fresh FROM col_runs WINDOW w AS (PARTITION BY page_key, y0)),
  col_group AS (SELECT *, sum(fresh) OVER (PARTITION BY page_key, y0 ORDER BY s) AS g FROM col_step),
  blocks AS (SELECT page_key, width, height, y0, y1, le, ri, min(s) AS s, max(e) AS e FROM col_group GROUP BY page_key, width, height, y0, y1, le, ri, g),
  counted AS (SELECT *, count(*) FILTER (e - s >= width * CAST(0.28 AS DOUBLE)) OVER (PARTITION BY page_key, y0) AS wide FROM blocks),
  boxes AS (SELECT page_key, width, height, y0, y1, s AS x0, e AS x1, true AS odd FROM counted WHERE wide >= 2 AND e - s >= width * CAST(0.28 AS DOUBLE)
    UNION ALL SELECT DISTINCT page_key, width, height, y0, y1, le, ri, ri - le < width * CAST(0.4 AS DOUBLE) OR y1 - y0 > ri - le FROM counted WHERE wide < 2)"""
PADDED = """, padded AS (SELECT page_key, width, height, odd, y0 AS band, x0 AS spot, greatest(CAST(0 AS DOUBLE), (x0 - width * CAST(0.01 AS DOUBLE)) / width) AS x0, greatest(CAST(0 AS DOUBLE), (y0 - height * CAST(0.01 AS DOUBLE)) / height) AS y0,
    least(CAST(1 AS DOUBLE), (x1 + width * CAST(0.01 AS DOUBLE)) / width) AS x1, least(CAST(1 AS DOUBLE), (y1 + height * CAST(0.01 AS DOUBLE)) / height) AS y1 FROM boxes),
  judged AS (SELECT *, x1 - x0 > CAST(0.05 AS DOUBLE) AND y1 - y0 > CAST(0.03 AS DOUBLE) AS wide, bool_or(odd) OVER (PARTITION BY page_key) AS any_odd FROM padded)"""
ORDERED = """, blank AS (SELECT page_key FROM pages LEFT JOIN (SELECT page_key, sum(ink) AS t FROM ink GROUP BY page_key) USING (page_key) WHERE coalesce(t, 0) / (width * height) < CAST(0.002 AS DOUBLE)),
  keep AS (SELECT *, count(*) OVER (PARTITION BY page_key) AS n FROM judged WHERE wide AND page_key NOT IN (SELECT page_key FROM blank)),
  ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_key ORDER BY floor(y0 * 100 + 0.5) / 100, floor(x0 * 100 + 0.5) / 100, band, spot) AS INT) AS ordinal FROM keep WHERE n BETWEEN 2 AND 12),
  clash AS (SELECT a.page_key, bool_or(greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) > CAST(0.5 AS DOUBLE) AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.x1 - a.x0, b.x1 - b.x0) > CAST(0.3 AS DOUBLE)) AS bad
    FROM ordered a JOIN ordered b ON a.page_key = b.page_key AND a.ordinal < b.ordinal GROUP BY a.page_key),
  regions AS (SELECT page_key, ordinal, x0, y0, x1, y1, CASE WHEN any_odd OR bad THEN 'ambiguous' ELSE 'ok' END AS flag FROM ordered JOIN clash USING (page_key)
    UNION ALL SELECT page_key, 1, 0, 0, 1, 1, CASE WHEN page_key IN (SELECT page_key FROM keep WHERE n > 12) THEN 'ambiguous' ELSE 'single' END FROM pages WHERE page_key NOT IN (SELECT page_key FROM ordered))"""
LAYOUT = "WITH " + RUNS + PROFILE + SMOOTH + ROW_RUNS + BANDS + COLUMNS + BOXES + PADDED + ORDERED
R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
BOX6 = R6("x0", "y0", "x1", "y1")
PROPS = """props AS (SELECT vec_id AS page_key, i, abs(CAST(embedding[4 * i + 1] AS DOUBLE)) * m AS a, abs(CAST(embedding[4 * i + 2] AS DOUBLE)) * m AS b, abs(CAST(embedding[4 * i + 3] AS DOUBLE)) * m AS c, abs(CAST(embedding[4 * i + 4] AS DOUBLE)) * m AS d
    FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN CAST(300 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS m FROM embeddings), range(16) AS s(i)),
  unit AS (SELECT page_key, i, least(1, a / k) AS a, least(1, b / k) AS b, least(1, c / k) AS c, least(1, d / k) AS d FROM (SELECT *, CASE WHEN greatest(a, b, c, d) > 1.5 THEN CAST(100 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS k FROM props)),
  normal AS (SELECT page_key, i, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM unit WHERE abs(a - c) > CAST(0.05 AS DOUBLE) AND abs(b - d) > CAST(0.03 AS DOUBLE))"""
RESOLVED = f""", {PROPS}, chosen AS (SELECT page_key, x0, y0, x1, y1, ordinal AS was FROM regions WHERE flag = 'ok'
    UNION ALL SELECT page_key, x0, y0, x1, y1, i FROM normal WHERE page_key IN (SELECT page_key FROM regions WHERE flag = 'ambiguous') QUALIFY count(*) OVER (PARTITION BY page_key) >= 2),
  resolved AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_key ORDER BY floor(y0 * 100 + 0.5) / 100, floor(x0 * 100 + 0.5) / 100, was) AS INT) AS ordinal
    FROM (SELECT * FROM chosen UNION ALL SELECT page_key, 0, 0, 1, 1, 0 FROM pages WHERE page_key NOT IN (SELECT page_key FROM chosen)) AS t)"""
PIXELS = """SELECT page_key, ordinal, CAST(px0 AS INT) AS x0, CAST(py0 AS INT) AS y0, CAST(greatest(px0 + 1, least(width, floor(x1 * width + 0.5))) AS INT) AS x1, CAST(greatest(py0 + 1, least(height, floor(y1 * height + 0.5))) AS INT) AS y1
  FROM (SELECT r.*, width, height, greatest(0, least(width - 1, floor(x0 * width + 0.5))) AS px0, greatest(0, least(height - 1, floor(y0 * height + 0.5))) AS py0 FROM regions r JOIN pages USING (page_key)) AS t"""
VOTE = lambda base, after: f""", s AS (SELECT id, pos, val FROM (SELECT id, 0 AS pos, amount_numeric_value AS val FROM {base} UNION ALL SELECT id, 1, amount_words_value FROM {base}
    UNION ALL SELECT id, 2 * pass + 10, num FROM amounts WHERE pass > {after} UNION ALL SELECT id, 2 * pass + 11, amount_words_value FROM raw WHERE pass > {after}) AS t WHERE val IS NOT NULL),
  tally AS (SELECT id, printf('%.2f', val) AS amount, count(*) AS votes, min(pos) AS pos FROM s GROUP BY 1, 2),
  won AS (SELECT id, amount, votes FROM tally QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, pos) = 1), voted AS (SELECT * FROM won WHERE votes >= 3)"""  # noqa: E731
VOTED = """, f AS (SELECT b.*, w.amount AS w, b.status = 'review' AS asked, list_filter(fl, lambda x: NOT starts_with(x, 'amount:')) AS other FROM best b LEFT JOIN voted w ON w.id = b.id),
  after AS (SELECT * REPLACE (CASE WHEN asked AND w IS NOT NULL THEN w ELSE amount END AS amount, amount_reconciled OR (asked AND w IS NOT NULL) AS amount_reconciled,
    CASE WHEN asked AND w IS NOT NULL THEN array_to_string(other, ' | ') ELSE flags END AS flags,
    CASE WHEN asked AND w IS NOT NULL THEN CASE WHEN len(list_filter(other, lambda x: contains(x, ':high:'))) > 0 THEN 'review' ELSE 'ok' END ELSE status END AS status,
    CASE WHEN asked THEN 'gemini-2.5-pro' ELSE model END AS model) FROM f)"""
# Fixed texts, written out here so that a wrong one in the library shows.
ASK_CHEQUE = (
    "Extract the fields from this single bank cheque. For the amount, report the figures from the amount box as "
    "amount_numeric, the courtesy line text as amount_words, and your own numeric reading of those words as "
    "amount_words_value. If a field is absent, return an empty string (or null for amount_words_value). The cheque "
    "number is the leading digits of the MICR/MRIC line at the bottom. Give a 0..1 confidence per field."
)
ASK_REGIONS = (
    "This scanned page may contain ONE or SEVERAL separate bank cheques. Identify every distinct physical cheque "
    "and give a bounding box for each as fractions of the image size with the origin at the TOP-LEFT: x0,y0 is the "
    "top-left corner and x1,y1 the bottom-right, each between 0 and 1. Order cheques top-to-bottom then left-to-"
    "right. Exclude page edges, staples, and anything that is not a cheque. If a single cheque covers most of the "
    "page, return one box [0,0,1,1]."
)
BANK_TEXTS = [
    ("Bank-specific guidance for Qatar National Bank (QNB): Amount box is top-right; courtesy line is centre, usually English. Cheque number = first 8 digits of the MICR line. Currency QAR.", ("qatar national", "qnb")),
    ("Bank-specific guidance for Commercial Bank of Qatar (CBQ): Bilingual layout; legal amount box upper-right. MICR cheque number is 8 digits. Currency QAR.", ("commercial bank", "cbq")),
    ("Bank-specific guidance for Qatar Islamic Bank (QIB): Arabic-forward layout; date often upper-right in DD/MM/YYYY. 8-digit cheque number. Currency QAR.", ("qatar islamic", "qib")),
    ("Bank-specific guidance for Qatar International Islamic Bank (QIIB): Bilingual; courtesy line may be Arabic. 8-digit MICR cheque number. Currency QAR.", ("international islamic", "qiib")),
    ("Bank-specific guidance for Doha Bank: Amount box upper-right; English courtesy line common. 8-digit cheque number. Currency QAR.", ("doha bank",)),
    ("Bank-specific guidance for Masraf Al Rayan: Islamic-bank bilingual layout. 8-digit MICR cheque number. Currency QAR.", ("al rayan", "masraf")),
    ("Bank-specific guidance for HSBC: English-forward layout; amount box upper-right. 8-digit cheque number.", ("hsbc",)),
]
EXAMPLES_TEXT = "Recently human-verified examples for this bank (format references only, NOT answers for this image):"
LINES = ", lines AS (SELECT bank_key, string_agg('  - amount=' || amount || ' ' || currency || ', date=' || date || ', cheque#=' || cheque_number, chr(10) ORDER BY pos) AS l FROM ex WHERE pos <= 2 GROUP BY bank_key)"
HINT = f"nullif(concat_ws(chr(10) || chr(10), {chain_of('bank', BANK_TEXTS, 'NULL')}, {q(EXAMPLES_TEXT)} || chr(10) || l), '')"
#: From responses: what each read's error is; an answer that was cut off or in another tool has none of the fields.
_GOOGLE = "starts_with(model, 'gemini')"
ANSWERS = f"""SELECT * REPLACE (CASE WHEN error IS NOT NULL THEN CASE WHEN {_GOOGLE} THEN 'Gemini' ELSE 'Anthropic' END || ' ' || split_part(error, ',', 1) WHEN {_GOOGLE} AND key % 43 = 0 THEN 'Could not parse model JSON'
  WHEN NOT {_GOOGLE} AND key % 47 = 0 THEN 'Model returned no tool_use block' END AS error) FROM ({raw(1, 4)}) AS t"""
READ_JOB = ", best AS (SELECT * FROM v WHERE pass = 1 OR (pass = 2 AND id IN (SELECT id FROM v WHERE pass = 1 AND status = 'review' AND model <> 'gemini-2.5-pro')) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass > 1 AND error IS NOT NULL, " + SCORE + " DESC, pass) = 1)" + VOTE("best", 2) + VOTED + " SELECT id, amount, amount_reconciled, currency, date, payer, bank, cheque_number, flags, confidence, status, false AS reviewed, model, error FROM after"
REVIEWED = validated() + f", {CORR}{LAST}, d AS (SELECT v.* REPLACE ({', '.join(f'CASE WHEN l.id IS NOT NULL THEN l.{c} ELSE v.{c} END AS {c}' for c in ('amount', 'currency', 'date', 'payer', 'bank', 'cheque_number'))}, CASE WHEN l.id IS NOT NULL THEN 'ok' ELSE status END AS status, CASE WHEN l.id IS NOT NULL THEN '' ELSE flags END AS flags), l.id IS NOT NULL AS reviewed FROM v LEFT JOIN last l ON l.id = v.id) SELECT id, row_number() OVER (ORDER BY pdf_id, page_index, cheque_on_page) AS rank, concat_ws(',', {', '.join(CELL(x) for x, _ in CSV_COLS)}) AS line FROM (SELECT *, count(*) OVER (PARTITION BY pdf_id, page_index) AS n FROM d) AS t"
REQUESTS = (
    validated(1, 2, source=f"SELECT * FROM ({raw(1, 2)}) AS t WHERE pass = 1 OR key % 2 = 0")
    + f""", first AS (SELECT * FROM v WHERE pass = 1), asked AS (SELECT id, key, bank FROM first WHERE status = 'review' AND model <> 'gemini-2.5-pro'),
  best AS (SELECT * FROM v WHERE pass = 1 OR id IN (SELECT id FROM asked) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass > 1 AND error IS NOT NULL, {SCORE} DESC, pass) = 1),
  second AS (SELECT id, bank, 2 AS pass FROM asked WHERE key % 2 <> 0), votes AS (SELECT id, bank, p.p AS pass FROM best, (VALUES (3), (4)) AS p(p) WHERE status = 'review' AND id NOT IN (SELECT id FROM second) AND (p.p = 4 OR key % 4 <> 0)),
  {CORR}{EXEMPLARS}{LINES} SELECT id, CAST(pass AS INT) AS pass, 'gemini-2.5-pro' AS model, md5({q(ASK_CHEQUE)} || coalesce(chr(10) || chr(10) || {HINT}, '')) AS prompt_md5
  FROM (SELECT * FROM second UNION ALL SELECT * FROM votes) AS d LEFT JOIN lines ON bank_key = {exemplar_key('bank')}"""
)
TARGET = "CASE WHEN starts_with(model, 'gemini') THEN 'gemini-2.5-pro' ELSE 'claude-opus-4-8' END"

SQL = {
    "n1_western_digits": f"SELECT id, translate(amount_numeric, {q(EASTERN)}, {q(WESTERN)}) AS digits FROM ({raw()})",
    "n2_parse_amount": SCALARS + "SELECT id, num AS amount FROM amounts",
    "n3_format_amount": f"WITH raw AS ({raw()}), {AMOUNT} SELECT id, {fmt('num')} AS amount, {fmt('CASE WHEN num / 125 = floor(num / 125) THEN floor(num / 10 + 0.5) / 100 ELSE num / 1000 END')} AS thousandth FROM amounts",
    "n4_cheque_number": f"SELECT id, coalesce(substr(regexp_replace(cheque_number, '[^0-9]', '', 'g'), 1, 8), '') AS cheque_number FROM ({raw()})",
    "n5_parse_date": SCALARS + "SELECT id, iso FROM dates",
    "n6_words_to_number": SCALARS + "SELECT id, round(spoken, 6) AS value FROM raw LEFT JOIN spoken ON aw = amount_words",
    "n7_approx_equal": SCALARS + "SELECT id, abs(num - amount_words_value) < CAST(0.01 AS DOUBLE) OR abs(num - amount_words_value) / greatest(abs(num), abs(amount_words_value), 1) < CAST(0.005 AS DOUBLE) AS same FROM amounts",
    "n8_trim": f"SELECT id, {trim('payer')} AS payer, {trim('bank')} AS bank FROM ({raw()})",
    "n9_validate_extraction": validated(blank_errors=False) + f" SELECT {FIELDS.replace(', status', '')}, CASE WHEN high > 0 THEN 'review' ELSE 'ok' END AS status FROM v",
    "n10_score": validated() + f" SELECT id, CAST({SCORE} AS INT) AS score FROM v",
    "n11_normalize_proposals": f"WITH {PROPS} SELECT page_key, {BOX6} FROM normal",
    "n12_pad_boxes": LAYOUT + f" SELECT page_key, {BOX6}, wide FROM judged",
    "n13_field_flags": validated() + " SELECT id, split_part(f, ':', 1) AS field, substr(f, length(split_part(f, ':', 1)) + length(split_part(f, ':', 2)) + 3) AS reason FROM (SELECT id, unnest(fl) AS f, generate_subscripts(fl, 1) AS i FROM v) AS t QUALIFY row_number() OVER (PARTITION BY id, split_part(f, ':', 1) ORDER BY i DESC) = 1",
    "n14_flags_text": validated() + f" SELECT id, flags, {CELL('flags')} AS cell FROM v",
    "n15_strip_fences": f"SELECT id, coalesce(amount_numeric, '') AS body FROM ({raw()})",
    "n16_split_band_columns": LAYOUT + " SELECT page_key, CAST(y0 AS INT) AS y0, CAST(y1 AS INT) AS y1, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1, odd AS ambiguous FROM boxes",
    "n17_detect_regions": LAYOUT + f" SELECT page_key, ordinal, {BOX6}, flag FROM regions",
    "s2_read_raw": f"SELECT id, CASE WHEN key % 37 <> 0 THEN amount_numeric END AS amount_numeric, CASE WHEN key % 37 <> 0 THEN amount_words_value END AS amount_words_value, CASE WHEN key % 37 <> 0 THEN bank END AS bank, CASE WHEN key % 37 <> 0 THEN conf_amount END AS conf_amount, CASE WHEN key % 37 = 0 THEN 'Invalid JSON' END AS error FROM ({raw()})",
    "s3_tool_use": f"SELECT id, CASE WHEN key % 4 <> 0 THEN bank END AS bank, CASE WHEN key % 4 = 0 THEN 'Model returned no tool_use block' END AS error FROM ({raw()})",
    "s4_function_call": f"SELECT id, CASE WHEN key % 5 < 3 THEN bank END AS bank, CASE key % 5 WHEN 3 THEN 'Could not parse model JSON' WHEN 4 THEN 'Model returned no structured output' END AS error FROM ({raw()})",
    "s1_pdf_manifest": "SELECT 'doc ' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.pdf' ELSE '.PDF' END AS source_file, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents WHERE doc_id % 3 < 2",
    "s5_export_csv": validated()
    + f", l AS (SELECT 1 + row_number() OVER (ORDER BY pdf_id, page_index, cheque_on_page) AS n, concat_ws(',', {', '.join(CELL(x) for x, _ in CSV_COLS)}) AS line FROM (SELECT *, false AS reviewed, count(*) OVER (PARTITION BY pdf_id, page_index) AS n FROM v) AS t)"
    + " SELECT n, line, true AS several FROM l UNION ALL SELECT 1, 'sourceFile,pageIndex,chequeOnPage,chequesOnPage,amount,currency,amountReconciled,amountWords,date,payer,bank,chequeNumber,hasHandwriting,confidence,status,model,reviewed,error,flags', true",
    "s7_crops": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id % 5 AS c, event_id % 29 = 0 AS gone, CASE WHEN event_id % 11 <> 0 THEN event_type || ' ' || lpad(CAST(event_id AS VARCHAR), 12, '0') ELSE '' END AS crop FROM events),
  log AS (SELECT id, c, 0 AS after, max(crop) FILTER (crop <> '') AS crop FROM e GROUP BY id, c UNION ALL SELECT DISTINCT id, c, 1, NULL FROM e WHERE gone),
  kept AS (SELECT * FROM log WHERE after = 1 OR crop IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, after DESC) = 1) SELECT id, crop FROM kept WHERE after = 0""",
    "p1_validate_requests": f"SELECT id, CASE WHEN key % 7 = 0 OR key % 6 = 5 THEN 'Missing image or unsupported model' END AS error FROM ({raw()})",
    "p2_provider_of": f"SELECT id, CASE WHEN model IN ('gemini-2.5-flash-lite', 'gemini-2.5-pro') THEN 'google' ELSE 'anthropic' END AS provider FROM ({raw()})",
    "p3_is_full_page": LAYOUT + " SELECT page_key, ordinal, x0 <= 0.001 AND y0 <= 0.001 AND x1 >= 0.999 AND y1 >= 0.999 AS whole FROM regions",
    "p4_region_to_pixels": LAYOUT + " " + PIXELS,
    "p5_page_label": f"SELECT id, CASE WHEN n > 1 THEN (page_index + 1) || '·' || cheque_on_page || '/' || n ELSE 'p' || (page_index + 1) END AS label FROM (SELECT *, count(*) OVER (PARTITION BY pdf_id, page_index) AS n FROM ({raw()}) AS a) AS t",
    "p6_needs_escalation": validated() + " SELECT id FROM v WHERE status = 'review' AND model <> 'gemini-2.5-pro'",
    "p7_needs_vote": validated(1, 2) + BEST + " SELECT id FROM best WHERE status = 'review'",
    "p8_page_geometry": "SELECT page_key, CAST(rotation AS INT) AS rotation, CAST(ceil(CASE WHEN rotation % 180 = 90 THEN height ELSE width END * s) AS INT) AS out_width, CAST(ceil(CASE WHEN rotation % 180 = 90 THEN width ELSE height END * s) AS INT) AS out_height FROM (SELECT *, CAST(1500 AS DOUBLE) / greatest(width, height) AS s, CASE WHEN height > CAST(1.3 AS DOUBLE) * width THEN (rotate + 90) % 360 ELSE rotate END AS rotation FROM (SELECT p_partkey AS page_key, 600 + p_partkey % 300 AS width, 500 + p_size * 13 AS height, 90 * (p_partkey % 4) AS rotate FROM part) AS a) AS b",
    "p9_build_requests": f"SELECT id, md5(CASE WHEN key % 3 = 0 THEN {q(ASK_REGIONS)} ELSE {q(ASK_CHEQUE)} END || CASE WHEN {trim('bank')} <> '' THEN chr(10) || chr(10) || {trim('bank')} ELSE '' END) AS prompt_md5 FROM ({raw()})",
    "p10_retry_plan": f"""WITH a AS (SELECT * FROM ({B.sql('SELECT * FROM events', B.ATTEMPTS)}) AS t QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC, seq DESC) = 1),
  b AS (SELECT *, CASE WHEN http_status = 200 AND has_payload THEN 'done' WHEN (http_status IN (408, 409, 429, 500, 502, 503, 529) OR http_status = 200) AND attempt < 4 THEN 'retry' ELSE 'fail' END AS action FROM a)
  SELECT request_id, attempt, action, CASE WHEN action = 'retry' THEN CAST(1500 * pow(2, attempt) AS BIGINT) END AS wait_ms FROM b""",
    "j1_infer_currency": f"SELECT id, {chain_of('bank', CURRENCY_HINTS, chr(39) * 2)} AS currency FROM ({raw()})",
    "j2_canonical_bank": f"SELECT id, {bank_key('bank')} AS bank_key FROM ({raw()})",
    "j3_rois_for_bank": f"SELECT id, CASE WHEN k = '' THEN {DEFAULT_ROIS['amount'][0]} ELSE 0.58 END::DOUBLE AS amount_x0, CASE k WHEN '' THEN 0.38 WHEN 'qnb' THEN 0.36 WHEN 'cbq' THEN 0.37 WHEN 'qib' THEN 0.37 WHEN 'qiib' THEN 0.37 ELSE 0.38 END::DOUBLE AS amount_y1, 0.66::DOUBLE AS date_x0, 0.8::DOUBLE AS micr_y0 FROM (SELECT id, {bank_key('bank')} AS k FROM ({raw()}) AS a) AS t",
    "j4_apply_corrections": validated() + f", {CORR}{LAST} SELECT v.id, CASE WHEN l.id IS NULL THEN v.amount ELSE l.amount END AS amount, CASE WHEN l.id IS NULL THEN v.bank ELSE l.bank END AS bank, CASE WHEN l.id IS NULL THEN v.cheque_number ELSE l.cheque_number END AS cheque_number, l.id IS NOT NULL AS reviewed, CASE WHEN l.id IS NULL THEN v.status ELSE 'ok' END AS status, CASE WHEN l.id IS NULL THEN flags ELSE '' END AS flags, confidence FROM v LEFT JOIN last l ON l.id = v.id",
    "j5_regions_overlap_badly": f"WITH {PROPS}, o AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY i) AS o FROM normal) SELECT page_key, coalesce(bool_or(a_o < b_o AND greatest(0, least(ay1, by1) - greatest(ay0, by0)) / least(ay1 - ay0, by1 - by0) > CAST(0.5 AS DOUBLE) AND greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) / least(ax1 - ax0, bx1 - bx0) > CAST(0.3 AS DOUBLE)), false) AS bad FROM (SELECT a.page_key, a.o AS a_o, b.o AS b_o, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1 FROM o a JOIN o b USING (page_key)) AS t GROUP BY page_key",
    "j6_crop_runs": LAYOUT + f", px AS ({PIXELS}) SELECT r.page_key, p.ordinal, CAST(r.y - p.y0 AS INT) AS y, CAST(greatest(r.x0, p.x0) - p.x0 AS INT) AS x0, CAST(least(r.x1, p.x1) - p.x0 AS INT) AS x1 FROM runs r JOIN px p ON r.page_key = p.page_key AND r.y >= p.y0 AND r.y < p.y1 AND r.x0 < p.x1 AND r.x1 > p.x0",
    "j7_attach_crops": f"WITH r AS ({raw()}), c AS (SELECT DISTINCT id AS cid FROM ({B.sql('SELECT * FROM events', B.CORRECTIONS)}) AS t) SELECT id, CASE WHEN key % 3 = 0 THEN 'own' WHEN cid IS NOT NULL THEN 'stored ' || id END AS crop FROM r LEFT JOIN c ON cid = id",
    "j8_escalation_worklist": validated(1, 2) + BEST + " SELECT id, bank, status, confidence FROM best b WHERE status = 'review' AND model <> 'gemini-2.5-pro' AND NOT EXISTS (SELECT 1 FROM v WHERE v.id = b.id AND model = 'gemini-2.5-pro' AND (v.pass = 1 OR v.key % 4 <> 0))",
    "j9_build_hints": validated() + f", {CORR}{EXEMPLARS}{LINES} SELECT id, md5({HINT}) AS hint_md5 FROM v LEFT JOIN lines ON bank_key = {exemplar_key('bank')}",
    "j10_resolve_page_regions": LAYOUT + RESOLVED + f" SELECT page_key, ordinal, {BOX6} FROM resolved",
    "j11_escalation_target": f"SELECT id, {TARGET} AS target FROM ({raw()})",
    "a1_summary": validated() + " SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'error') AS error, CAST(coalesce(floor(avg(confidence) + 0.5), 0) AS BIGINT) AS avg_confidence FROM v",
    "a2_cheques_per_page": LAYOUT + " SELECT page_key, ordinal, CAST(count(*) OVER (PARTITION BY page_key) AS INT) AS cheques_on_page FROM regions",
    "a3_row_profile": f"WITH {RUNS}{PROFILE} SELECT page_key, y, ink FROM profile",
    "a4_band_column_profile": LAYOUT + " SELECT page_key, CAST(y0 AS INT) AS y0, sum(ink)::BIGINT AS ink, max(ink) AS top, count(*) AS columns FROM cols GROUP BY page_key, y0",
    "a5_ink_fraction": f"WITH {RUNS}{PROFILE} SELECT page_key, round(sum(ink) / (any_value(width) * any_value(height)), 6) AS fraction FROM profile GROUP BY page_key",
    "a6_gray_percentile": "SELECT l_suppkey AS page_key, CAST(quantile_disc((CAST(l_quantity AS INT) * 5) % 256, 0.95) AS INT) AS level FROM lineitem GROUP BY 1",
    "a7_majority_amount": validated(1, 3) + VOTE("v WHERE pass = 1", 1) + " SELECT id, amount, votes FROM voted",
    "a8_apply_vote": validated(1, 4) + ", best AS (SELECT * FROM v WHERE pass <= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass > 1 AND error IS NOT NULL, " + SCORE + " DESC, pass) = 1)" + VOTE("best", 2) + VOTED + " SELECT id, amount, amount_reconciled, flags, status, model FROM after",
    "a9_progress": f"WITH r AS ({raw()}), p AS (SELECT pdf_id, page_index, count(*) AS n, min(key) % 5 <> 0 AS done FROM r GROUP BY 1, 2) SELECT pdf_id, count(*) FILTER (done) AS pages_done, count(*) AS total_pages, CAST(sum(n) AS BIGINT) AS cheques_found, CAST(floor(100 * count(*) FILTER (done) / count(*) + 0.5) AS BIGINT) AS percent FROM p GROUP BY pdf_id",
    "w1_box_smooth": f"WITH {RUNS}{PROFILE}{SMOOTH} SELECT page_key, y, round(smooth, 6) AS smooth FROM smooth",
    "w2_bool_runs": f"WITH {RUNS}{PROFILE}{SMOOTH}{ROW_RUNS} SELECT page_key, CAST(s AS INT) AS start, CAST(e AS INT) AS end FROM row_runs".replace("AS end FROM", 'AS "end" FROM'),
    "w3_merge_runs": f"WITH {RUNS}{PROFILE}{SMOOTH}{ROW_RUNS}{BANDS} SELECT page_key, CAST(y0 AS INT) AS start, CAST(y1 AS INT) AS \"end\" FROM merged",
    "w4_page_max_threshold": f"WITH {RUNS}{PROFILE}{SMOOTH} SELECT page_key, y, lit FROM lit",
    "w5_pick_best_read": validated(1, 4) + BEST + " SELECT id, pass, amount, status, confidence, model FROM best",
    "w6_keep_last": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "w7_learn_exemplars": f"WITH {CORR}{EXEMPLARS} SELECT bank_key, pos, amount, date, currency, cheque_number, seq FROM ex",
    "w8_region_ordinals": LAYOUT + RESOLVED + " SELECT page_key || ':' || ordinal AS id, page_key, ordinal, CAST(count(*) OVER (PARTITION BY page_key) AS INT) AS cheques_on_page FROM resolved",
    "w9_display_rank": f"SELECT id, row_number() OVER (ORDER BY pdf_id, page_index, cheque_on_page) AS rank FROM ({raw()})",
    "o1_order_regions": f"WITH {PROPS} SELECT page_key, CAST(row_number() OVER (PARTITION BY page_key ORDER BY floor(y0 * 100 + 0.5) / 100, floor(x0 * 100 + 0.5) / 100, i) AS INT) AS ordinal, {BOX6} FROM normal",
    "o2_order_results": f"SELECT id, pdf_id, page_index, cheque_on_page FROM ({raw()}) ORDER BY pdf_id, page_index, cheque_on_page",
    "o2_locale_order": f"""WITH f AS (SELECT id, page_index, cheque_on_page, pdf_id AS doc, ['etude', 'Étude', 'zeta', 'Etude', 'alpha', 'étude', 'Zeta', 'Alpha'][key % 8 + 1] AS name FROM ({raw()}) AS t)
  SELECT id, name || ' ' || doc AS pdf_id, row_number() OVER (ORDER BY strip_accents(lower(name)), doc, strip_accents(name) <> name, lower(name) <> name, page_index, cheque_on_page) AS rank FROM f""",
    "o3_top_exemplars": f"WITH {CORR}{EXEMPLARS} SELECT bank_key, pos, amount, seq FROM ex WHERE pos <= 2",
    "o4_cap_regions": f"WITH {PROPS}, o AS (SELECT *, count(*) OVER (PARTITION BY page_key) AS n, CAST(row_number() OVER (PARTITION BY page_key ORDER BY i) AS INT) AS ordinal FROM normal) SELECT page_key, ordinal, {BOX6}, 'ok' AS flag FROM o WHERE n <= 12 UNION ALL SELECT page_key, 1, 0, 0, 1, 1, 'ambiguous' FROM o WHERE n > 12 AND ordinal = 1",
    "u1_union_outcomes": LAYOUT + RESOLVED + ", f AS (SELECT page_key, max(flag) AS flag FROM regions GROUP BY page_key) SELECT flag, count(DISTINCT page_key) AS pages, count(*) AS regions FROM resolved JOIN f USING (page_key) GROUP BY flag",
    "u2_with_error_rows": validated() + f" SELECT {FIELDS}, model, error FROM v",
    "job_find_cheques": LAYOUT + RESOLVED + f", f AS (SELECT page_key, max(flag) AS flag FROM regions GROUP BY page_key) SELECT page_key || ':' || ordinal AS id, page_key, ordinal, CAST(count(*) OVER (PARTITION BY page_key) AS INT) AS cheques_on_page, {BOX6}, flag FROM resolved JOIN f USING (page_key)",
    "job_read_cheques": validated(1, 4) + READ_JOB,
    "job_review_cheques": REVIEWED, "job_review_stored": REVIEWED,
    "job_read_responses": validated(1, 4, source=ANSWERS) + READ_JOB,
    "job_request_reads": REQUESTS,
    "s6_save_load": validated() + " SELECT id, amount, status, confidence FROM v",
    "s8_pages_to_ink_runs": f"WITH {RUNS}, full_ink AS (SELECT page_key FROM runs JOIN pages USING (page_key) GROUP BY page_key, width, height HAVING sum(runs.x1 - runs.x0) >= CAST(0.95 AS DOUBLE) * width * height) SELECT page_key, y, x0, x1 FROM runs WHERE page_key NOT IN (SELECT page_key FROM full_ink)",
    "t1_stream_validate": validated(source=f"SELECT * REPLACE (CASE WHEN key % 41 <> 0 THEN id END AS id, CASE WHEN key % 41 <> 0 THEN model END AS model, CASE WHEN key % 41 = 0 THEN 'Invalid JSON' ELSE error END AS error) FROM ({raw()}) AS t")
    + f" SELECT {FIELDS.replace('pass,', 'CASE WHEN id IS NOT NULL THEN pass END AS pass,')}, model, error FROM v",
    "t2_stream_upsert": f"WITH {CORR}{LAST} SELECT id, seq, amount, bank, cheque_number FROM last",
    "t3_stream_progress": f"SELECT pdf_id AS file, count(DISTINCT page_index) AS pages_done, count(*) AS cheques_found FROM ({raw()}) GROUP BY pdf_id",
    "t4_stream_exemplars": f"WITH {CORR}{EXEMPLARS} SELECT bank_key, pos, amount, date, currency, cheque_number, seq FROM ex",
    "f1_map_bounded": f"SELECT key, 2 * key AS twice, upper(bank) AS bank FROM ({raw()})",
}
