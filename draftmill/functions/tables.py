"""Schemas and fixed tables of the cheque data model."""

from __future__ import annotations

REGION = "struct<x0: double, y0: double, x1: double, y1: double>"
FLAG = "struct<field: string, severity: string, reason: string>"
CONFIDENCE = "struct<amount: double, date: double, payer: double, bank: double, chequeNumber: double>"
#: A model's answer; every field may be missing.
RAW = (
    "amount_numeric string, amount_words string, amount_words_value double, currency string, date string, payer string, "
    f"bank string, cheque_number string, has_handwriting boolean, field_confidence {CONFIDENCE}"
)
RESULT = (
    f"id string, pdf_id string, source_file string, page_index int, cheque_on_page int, cheques_on_page int, region {REGION}, "
    "amount string, amount_words string, amount_numeric_value double, amount_words_value double, currency string, date string, "
    f"payer string, bank string, cheque_number string, has_handwriting boolean, amount_reconciled boolean, flags array<{FLAG}>, "
    "confidence int, status string, reviewed boolean, model string, crop_ref string, error string"
)

# Digits and marks that stand for Western ones, in pairs.
EASTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬"
WESTERN = "01234567890123456789.,"

# Number words.
SMALL = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
MAGNITUDES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# The models, weakest to strongest within a provider.
MODELS = (
    ("gemini-2.5-flash-lite", "google"), ("gemini-2.5-pro", "google"), ("claude-haiku-4-5-20251001", "anthropic"), ("claude-sonnet-4-6", "anthropic"),
    ("claude-opus-4-8", "anthropic"),
)

# Parts of bank names that tell the currency; the first row that fits counts.
CURRENCY_HINTS = (
    ("QAR", ("qatar", "qnb", "cbq", "qib", "qiib", "doha", "rayan", "barwa")),
    ("AED", ("emirates", "dubai", "abu dhabi", "mashreq", "enbd", "adcb", "fab")),
    ("SAR", ("saudi", "rajhi", "riyad", "alinma", "ncb", "snb")),
    ("KWD", ("kuwait", "nbk", "gulf bank", "boubyan")),
    ("OMR", ("oman", "bank muscat", "nbo")),
    ("BHD", ("bahrain", "bbk", "ahli united")),
)

# Known banks, by parts of their names; the first row that fits counts. key, name parts, lower edge of the
# amount box, label, hint.
BANKS = (
    ("qnb", ("qatar national", "qnb"), 0.36, "Qatar National Bank (QNB)", "Amount box is top-right; courtesy line is centre, usually English. Cheque number = first 8 digits of the MICR line. Currency QAR."),
    ("cbq", ("commercial bank", "cbq"), 0.37, "Commercial Bank of Qatar (CBQ)", "Bilingual layout; legal amount box upper-right. MICR cheque number is 8 digits. Currency QAR."),
    ("qib", ("qatar islamic", "qib"), 0.37, "Qatar Islamic Bank (QIB)", "Arabic-forward layout; date often upper-right in DD/MM/YYYY. 8-digit cheque number. Currency QAR."),
    ("qiib", ("international islamic", "qiib"), 0.37, "Qatar International Islamic Bank (QIIB)", "Bilingual; courtesy line may be Arabic. 8-digit MICR cheque number. Currency QAR."),
    ("doha", ("doha bank",), 0.38, "Doha Bank", "Amount box upper-right; English courtesy line common. 8-digit cheque number. Currency QAR."),
    ("rayan", ("al rayan", "masraf"), 0.38, "Masraf Al Rayan", "Islamic-bank bilingual layout. 8-digit MICR cheque number. Currency QAR."),
    ("hsbc", ("hsbc",), 0.38, "HSBC", "English-forward layout; amount box upper-right. 8-digit cheque number."),
)
#: Left, upper and right edge of the amount box where the bank is known; and the boxes where it is not.
BANK_AMOUNT = (0.58, 0.1, 0.98)
DEFAULT_ROIS = {"amount": (0.56, 0.08, 0.99, 0.38), "date": (0.66, 0.12, 0.99, 0.42), "micr": (0.0, 0.8, 1.0, 1.0)}

# Fixed texts.
HANDOVER = "HANDOVER PAYMENT"
EXTRACT_PROMPT = (
    "Extract the fields from this single bank cheque. For the amount, report the figures from the "
    "amount box as amount_numeric, the courtesy line text as amount_words, and your own numeric "
    "reading of those words as amount_words_value. If a field is absent, return an empty string (or "
    "null for amount_words_value). The cheque number is the leading digits of the MICR/MRIC line at "
    "the bottom. Give a 0..1 confidence per field."
)
REGION_PROMPT = (
    "This scanned page may contain ONE or SEVERAL separate bank cheques. Identify every distinct "
    "physical cheque and give a bounding box for each as fractions of the image size with the origin "
    "at the TOP-LEFT: x0,y0 is the top-left corner and x1,y1 the bottom-right, each between 0 and 1. "
    "Order cheques top-to-bottom then left-to-right. Exclude page edges, staples, and anything that is "
    "not a cheque. If a single cheque covers most of the page, return one box [0,0,1,1]."
)
EXAMPLES = "Recently human-verified examples for this bank (format references only, NOT answers for this image):\n"
CSV_FIELDS = (
    ("sourceFile", "source_file"), ("pageIndex", "page_index"), ("chequeOnPage", "cheque_on_page"), ("chequesOnPage", "cheques_on_page"),
    ("amount", "amount"), ("currency", "currency"), ("amountReconciled", "amount_reconciled"), ("amountWords", "amount_words"), ("date", "date"),
    ("payer", "payer"), ("bank", "bank"), ("chequeNumber", "cheque_number"), ("hasHandwriting", "has_handwriting"), ("confidence", "confidence"),
    ("status", "status"), ("model", "model"), ("reviewed", "reviewed"), ("error", "error"),
)
RETRIABLE = (408, 409, 429, 500, 502, 503, 529)
MAX_RETRIES, BACKOFF_MS = 4, 1500
MAX_CHEQUES = 12
