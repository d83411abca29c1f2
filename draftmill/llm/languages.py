"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; whatever isn't a letter becomes a space, runs of spaces become one, and one stands before and after. The n-grams of ORDERS
characters, each order by itself, are hashed into WIDTH places. Training counts every place for every language over all labelled texts: each task sums its
texts up in one matrix, whose entries are added by key. The model is a matrix of log probabilities (languages x places), with Laplace's smoothing,
beside the logs of the languages' shares of the documents. It is broadcast: WIDTH halves while languages are so many that it would exceed
MODEL_BYTES, so its size is bounded whatever the input, and beyond MOST languages an error is raised.

Scoring works on batches of texts, laid end to end: the places of all n-grams that lie within one text are one array, each language's row of the matrix is
gathered and added up text by text (np.add.reduceat), a bounded number at a time, so a long text takes no more than its own length. The score is the probability of the predicted language, with
evidence divided by the number of orders, as an n-gram of one order nearly says what those within it say.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text where nothing could be learned; texts equal but for case,
digits and marks get equal results; languages that tie are taken in the order of their names; rows with a null or empty lang aren't learned from, nor rows
without letters. A null doc_id counts as the text 'null' for the held-out part and stays null. Only doc_id, text and lang are read, and lang in
training only; no rows in, no rows out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, text_of, to_arrow

ORDERS = (1, 2, 3, 4)
#: Places of the hash, at most; bytes of the model, at most; languages, at most.
WIDTH, MODEL_BYTES, MOST = 1 << 17, 1 << 25, 1 << 12
#: Added to every count; code points of a batch of texts, about (a longer text is a batch by itself); numbers gathered at a time.
SMOOTH, BATCH, CELLS = 0.5, 1 << 18, 1 << 21
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end: code points (0 for what isn't a letter) and which text each belongs to. A text has one 0 before, one after, and one for whatever
    lies between letters."""
    framed = [f"\0{t.lower()}\0" for t in texts]
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in framed])
    points = np.where(_letters()[points], points, np.uint32(0))
    keep = points != 0
    keep[1:] |= (points[:-1] != 0) | (owner[1:] != owner[:-1])
    keep[:1] = True
    return points[keep], owner[keep]


def places(points: np.ndarray, owner: np.ndarray, width: int, languages: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of all n-grams within one text, and the text of each, in parts: (places, owners ascending)."""
    step, longest = max(CELLS // max(languages, 4), 1024), max(ORDERS)
    shift = np.uint64(64 - int(math.log2(width)))
    for at in range(0, len(points), step):
        part, own = points[at : at + step + longest - 1].astype(np.uint64), owner[at : at + step + longest - 1]
        hashed = np.zeros(len(part), np.uint64)
        for n in range(1, min(longest, len(part)) + 1):
            # Products of odd numbers, folded; the high bits are the place.
            hashed = (hashed[: len(part) - n + 1] + part[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            if n in ORDERS:
                within = own[n - 1 :] == own[: len(part) - n + 1]
                within[step:] = False
                if n == 1:
                    within &= part != 0
                yield ((hashed[within] * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64), own[: len(part) - n + 1][within]


def batches(texts: list[str]) -> Iterator[slice]:
    """Parts of the list with some BATCH code points, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


@dataclass
class Model:
    names: list[str]  # ascending
    prior: np.ndarray  # logs of shares of documents; of languages that nothing was learned of minus infinity
    matrix: np.ndarray  # languages x places: log probabilities, less their mean over the languages of the place

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts x languages: summed log probabilities; and which texts have letters."""
        total, seen = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), bool)
        for part in batches(texts):
            first = part.start
            for place, own in places(*laid_out(texts[part]), self.matrix.shape[1], len(self.names)):
                if len(place):
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    at = first + own[starts]
                    for i, column in enumerate(self.matrix):
                        total[at, i] += np.add.reduceat(column[place], starts)
                    seen[at] = True
        return total, seen

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not np.isfinite(self.prior).any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, seen = self.evidence(texts)
        total = total / len(ORDERS) + self.prior
        top = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        score = np.where(seen, share.max(axis=1) / share.sum(axis=1), 0.0)
        return [self.names[i] if s else UNKNOWN for i, s in zip(top, seen, strict=True)], score


def learn(docs: DataFrame, train: Column) -> Model:
    """The model of all rows for which `train` holds and lang says something."""
    spark = docs.sparkSession
    rows = docs.filter(train & (F.coalesce(F.col("lang"), F.lit("")) != "")).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    width = WIDTH
    while width * max(len(names), 1) * 4 > MODEL_BYTES:
        width //= 2
    of, kind = {name: i for i, name in enumerate(names)}, "place int, lang int, n long"
    arrow = to_arrow(spark, kind)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(of) * width, np.int64)
        documents = np.zeros(len(of), np.int64)
        for batch in parts:
            lang = np.array([of[x] for x in batch.column(0).to_pylist()], np.int64)
            for at in range(0, batch.num_rows, 4096):
                texts = batch.column(1).slice(at, 4096).to_pylist()
                for part in batches(texts):
                    own_lang, letters = lang[at:][part], np.zeros(part.stop - part.start, bool)
                    for place, own in places(*laid_out(texts[part]), width, len(of)):
                        np.add.at(counts, own_lang[own] * width + place, 1)
                        letters[own] = True
                    np.add.at(documents, own_lang[letters], 1)
        cell = np.flatnonzero(counts)
        found = np.flatnonzero(documents)
        out = [np.r_[cell % width, np.full(len(found), -1)], np.r_[cell // width, found], np.r_[counts[cell], documents[found]]]
        for at in range(0, len(out[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)], f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    counts, documents = np.zeros((width, len(names))), np.zeros(len(names))
    if names:
        found = rows.mapInArrow(count, kind).groupBy("place", "lang").agg(F.sum("n").alias("n")).toArrow()
        place, lang, n = (found.column(c).to_numpy() for c in ("place", "lang", "n"))
        documents[lang[place < 0]] = n[place < 0]
        counts[place[place >= 0], lang[place >= 0]] = n[place >= 0]
    with np.errstate(divide="ignore"):
        prior = np.log(documents / max(documents.sum(), 1))
    matrix = np.log(counts + SMOOTH) - np.log(counts.sum(axis=0) + SMOOTH * width)
    return Model(names, prior, np.ascontiguousarray((matrix - matrix.mean(axis=1, keepdims=True) if names else matrix).T, np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_task():
        def work(ids: list, texts: list) -> dict:
            lang, score = shared.value.predict(texts)
            return {"lang_pred": lang, "score": score}

        return work

    return map_texts(docs.select("doc_id", text_of().alias("text")), per_task, "lang_pred string, score double")


def languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the model is learned from rows that aren't held out (crc32 of doc_id, modulo folds, is `held`)."""
    model = learn(docs, crc_mod("doc_id", folds) != held)
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
