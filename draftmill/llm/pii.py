"""Personal data: weak supervision. Labelers vote on candidate spans; expectation-maximisation finds how far each can be trusted and
trains a final span classifier.

One pass over the texts finds the base spans (four patterns with their checks) and looser candidates: obfuscated e-mail
addresses, phone numbers without a plus sign, 15-digit cards, US social security numbers, bank account numbers (IBAN) and names
after a title. Labelers of three sorts vote yes, no or not at all on every candidate:

  regex      the strict form of the kind holds, or its form holds but its check fails
  checksum   Luhn, modulo 97, or parts of an address in range
  gazetteer  top-level domains, card issuers, calling codes, first names; addresses of private networks vote no
  context    words before the span that announce the kind
  adverse    words before the span that announce something else (a version, an order, a page ...)
  isolation  the span stands by itself, or is part of a longer word or number

Votes are counted by pattern (kind x votes x length class: some thousands at most, whatever the number of spans), and the counts alone
come to the driver. Expectation-maximisation (two classes, labelers independent given the class) gives each labeler's
reliability and each pattern's posterior; a logistic regression on the votes, the kind and the length class is fitted to the posteriors. A
candidate becomes a span if the classifier gives it ACCEPT or more and it does not overlap a base span. Base spans always stay.

Defined results: null text counts as empty and has no span. Of overlapping candidates the first kind in KINDS, then the leftmost,
counts. Repeated rows get equal results, a null doc_id stays null. Positions are code points, ends exclusive. Only doc_id and text are
read, whatever other columns there are; no rows in, no rows out.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, staged
from .exact import text_hash

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name")
LABELERS = ("regex", "checksum", "gazetteer", "context", "adverse", "isolation")
ACCEPT = 0.8
BEFORE = 40  # code points of context

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,}(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,})+"),
    "phone": re.compile(r"(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}"),
    "card": re.compile(r"[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"),
    "name": re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?"),
}
DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
# Generic top-level domains in wide use; those of two letters are the countries' own, all of them.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro aero asia cat coop jobs mobi museum post tel travel app dev online site store tech xyz eu".split())
# Country calling codes: of one digit, of two, and of three by zone.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split(),
    *"211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255 256 257 258".split(),
    *"260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 379 380 381 382 383 385 386 387 389".split(),
    *"420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692".split(),
    *"800 808 850 852 853 855 856 870 878 880 881 882 883 886 888 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 979 992 993 994 995 996 998".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "@"), "ip": ("ip", "host", "address", "server", "login", "from"), "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank", "transfer"), "name": ("name", "dear", "patient", "signed", "regards", "contact"),
}
ADVERSE = ("version", "isbn", "issn", "order", "invoice", "page", "section", "serial", "sku", "item", "figure", "chapter", "build", "release")
_WORD = re.compile(r"[a-z@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: str, s: str) -> bool:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in s.split(".")))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """What EMAIL finds, from each @ outwards: the run of a local part's characters before it, and the domain behind it. Every character is looked
    at a few times at most, however long a run is."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    """What IP finds: of each sequence of numbers with single dots between them, four at a time."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            at, parts = m.start(), m.group().split(".")
            for k in range(0, len(parts) - 3, 4):
                size = sum(map(len, parts[k : k + 4])) + 3
                out.append((at, at + size))
                at += size + 1
    return out


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """All matches of the base patterns, leftmost and non-overlapping within a kind, before their checks."""
    found = [("email", s, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        found += [("ip", s, e) for s, e in _ips(text)] + [("card", m.start(), m.end()) for m in CARD.finditer(text)]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)]
    return found


def _loose(text: str) -> list[tuple[str, int, int]]:
    kinds = (["phone", "card", "ssn", "iban"] if DIGIT.search(text) else []) + (["email"] if "(at)" in text or "[at]" in text else []) + (["name"] if any(t in text for t in ("Mr", "Ms", "Dr", "Prof")) else [])
    return [(k, m.start(), m.end()) for k in kinds for m in LOOSE[k].finditer(text)]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(kind: str, start: int, end: int, text: str, strict: bool | None) -> tuple[int, ...]:
    """Of each labeler: 1 yes, 0 no, 2 no vote. strict: the base pattern's check passed or failed, or None for a looser form."""
    s = text[start:end]
    d = _digits(s)
    before = _WORD.findall(text[max(0, start - BEFORE) : start].lower())
    checksum = {"card": lambda: luhn(d), "iban": lambda: _mod97(s), "ip": lambda: passes("ip", s), "ssn": lambda: None if d[:3] not in ("000", "666") and d[3:5] != "00" and d[0] != "9" else False}.get(kind)
    gazetteer = 2
    if kind == "email":
        top = re.split(r"[^A-Za-z]+", s.lower().rstrip(")]"))[-1]
        gazetteer = int(len(top) == 2 or top in DOMAINS) or 2
    elif kind == "card":
        gazetteer = int(d[0] in "3456" or "2221" <= d[:4] <= "2720")
    elif kind == "phone":
        gazetteer = int(s[0] == "+" and d.startswith(CODES)) or 2
    elif kind == "ip":
        gazetteer = 0 if d and (s.startswith(("0.", "10.", "127.", "192.168.", "255."))) else 2
    left, right = text[start - 1 : start], text[end : end + 1]
    alone = not (left.isalnum() or left in ("_", ".", "-", "+", "$") and left or right.isalnum() or right in ("_", "-") and right)
    return (
        2 if strict is None else int(strict),
        2 if checksum is None or (ok := checksum()) is None else int(ok),  # a rule that nearly all numbers keep only speaks against one
        gazetteer,
        1 if any(w.startswith(c) for w in before[-5:] for c in CONTEXT[kind]) else 2,
        0 if any(w in ADVERSE for w in before[-3:]) else 2,
        int(alone),
    )


def spans_of(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, pattern, base) of a text, by kind and start; candidates that overlap what comes before them are left out."""
    matches = [(k, s, e, passes(k, text[s:e])) for k, s, e in base_matches(text)]
    # Stretches that are taken, apart from one another (base spans of two kinds may overlap: such are joined).
    starts, ends = [], []
    for a, b in sorted((s, e) for _, s, e, ok in matches if ok):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = [(k, s, e, True, True) for k, s, e, ok in matches if ok]
    # A number that only looks like the start of a card is no candidate: cards that failed need 13 digits or more.
    more = [(k, s, e, False) for k, s, e, ok in matches if not ok and (k != "card" or len(_digits(text[s:e])) >= 13)] + [(*x, None) for x in _loose(text)]
    # An account number whose check digits are right comes before a card number that failed within it.
    for k, s, e, strict in sorted(more, key=lambda x: (x[0] != "iban" or not _mod97(text[x[1] : x[2]]), KINDS.index(x[0]), x[1], x[2], x[3] is None)):
        at = bisect_left(starts, e)  # the stretches before `at` start before this one ends
        if at == 0 or ends[at - 1] <= s:
            starts.insert(at, s)
            ends.insert(at, e)
            out.append((k, s, e, strict, False))
    rows = []
    for k, s, e, strict, base in sorted(out, key=lambda x: (KINDS.index(x[0]), x[1])):
        v = votes(k, s, e, text, strict)
        rows.append((k, s, e, f"{k}|{''.join(map(str, v))}|{min((e - s) // 8, 4)}", base))
    return rows


def _unpack(patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [p.split("|") for p in patterns]
    return np.array([KINDS.index(k) for k, _, _ in parts]), np.array([[int(c) for c in v] for _, v, _ in parts]), np.array([int(n) for _, _, n in parts])


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of each pattern, and how often each labeler votes yes, no or not at all (class x vote x labeler) on spans that are
    not personal data and that are. A labeler is judged on the kinds that it ever votes on. Labelers are taken to be no worse than
    chance: a yes never speaks against a span, a no never for it. A few made-up votes keep all shares between 0 and 1."""
    kind, vote, _ = _unpack(patterns)
    said = np.stack([vote == 1, vote == 0, vote == 2])  # vote x pattern x labeler
    able = np.stack([(vote[kind == k] != 2).any(axis=0) if (kind == k).any() else np.zeros(vote.shape[1], bool) for k in range(len(KINDS))])[kind]
    yes, no = said[0].sum(1), said[1].sum(1)
    post = np.clip((1 + 2.0 * yes) / (2 + 2.0 * (yes + no)), 0.05, 0.95)
    made_up = np.array([[1.0, 3.0, 2.0], [3.0, 1.0, 2.0]])[:, :, None]  # class x vote
    for _ in range(rounds):
        weights = np.stack([counts * (1 - post), counts * post])  # class x pattern
        seen = np.einsum("cp,vpl->cvl", weights, said & able) + made_up
        rate = seen / seen.sum(axis=1, keepdims=True)
        worth = np.log(rate[1] / rate[0])  # vote x labeler
        worth[0], worth[1] = np.maximum(worth[0], 0), np.minimum(worth[1], 0)
        prior = (np.bincount(kind, weights[1], len(KINDS)) + 1) / (np.bincount(kind, counts, len(KINDS)) + 2)
        score = np.log(prior / (1 - prior))[kind] + np.einsum("vpl,vl->p", said & able, worth)
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return post, rate


def classify(patterns: list[str], counts: np.ndarray, steps: int = 60) -> np.ndarray:
    """The final classifier's probability for each pattern: logistic regression by Newton steps, fitted to the posteriors."""
    post, _ = reliabilities(patterns, counts)
    kind, vote, length = _unpack(patterns)
    x = np.concatenate([np.eye(len(KINDS))[kind], *(vote == v for v in (0, 1)), np.eye(5)[length]], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (counts * (post - p)) - w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def find_candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, th (the hash of the text), and its base spans and candidates in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("base", pa.bool_())]))

    def per_task():
        names = ("kind", "start", "end", "pattern", "base")
        return lambda ids, texts: {"th": [text_hash(t) for t in texts], "spans": pa.array([[dict(zip(names, s, strict=True)) for s in spans_of(t)] for t in texts], kind)}

    return map_texts(id_and_text(docs), per_task, "th long, spans array<struct<kind: string, start: long, end: long, pattern: string, base: boolean>>")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per row: doc_id, th (the hash of the text), base (array of base spans) and found (array of all spans), each of kind, start, end and base, by kind and start."""
    found = staged(find_candidates(docs), "pii-candidates")
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.pattern").count().orderBy("pattern").collect()
    patterns = [r.pattern for r in rows]
    good = [p for p, x in zip(patterns, classify(patterns, np.array([r["count"] for r in rows], float)) if patterns else [], strict=True) if x >= accept]
    chosen = F.array(*[F.lit(p) for p in good]) if good else F.array().cast("array<string>")
    return found.select("doc_id", "th", F.filter("spans", lambda s: s["base"]).alias("base"), F.filter("spans", lambda s: s["base"] | F.array_contains(chosen, s["pattern"])).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, their SHA-256, and all spans written out."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Per row: doc_id and text with every span replaced by its kind in angle brackets. Joined by doc_id and a hash of the text."""
    docs = id_and_text(docs)
    spans = personal_data(docs, accept).select("doc_id", "th", "found")
    ordered = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    once = spans.filter(F.size("found") > 0).withColumn("found", ordered).groupBy(F.col("doc_id").alias("id"), "th").agg(F.first("found").alias("found"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def put(acc: Column, s: Column) -> Column:
        text = F.col("text")
        skip = s["start"] < acc["at"]
        kept = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(skip, acc).otherwise(F.struct(F.concat(acc["out"], kept, F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at")))

    whole = F.aggregate("found", start, put, lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))))
    both = docs.join(once, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("th")), "left")
    return both.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(whole).alias("text"))
