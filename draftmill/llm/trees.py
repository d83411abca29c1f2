"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the texts computes the statistics of every document. The trees are fitted on labelled documents: on all of them up to
MAX_ROWS, beyond that on a part chosen by a hash of their ids (a documented bound; the fit takes a second or two). Statistics are cut into at
most BINS bins, a split is the best cut of a histogram of gradients, and every tree is complete to its depth. The forest is held as three
arrays (features, thresholds, leaf values), so a batch of documents walks down all trees by numpy indexing: at each level, node = 2 node
+ 1 + (statistic > threshold).

Only a text's own statistics enter its score: neither labels nor doc_id, lang or source.

Defined results: null text counts as empty; an empty text is scored like any other. Without labels the score is 0.5. Null
labels, labels without a document and labels without an id are left out; of several labels of one doc_id the highest counts. Repeated rows get equal
results, a null doc_id stays null and is never learned from. Only doc_id and text are read, whatever other columns there are; no rows in,
no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, id_and_text, map_texts, staged
from .exact import drop_rows, text_hash

MAX_ROWS, BINS, TREES, DEPTH, RATE = 30_000, 64, 60, 4, 0.15
_UPPER, _DIGITS, _SYMBOLS, _MARKS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>=@_{}[]^~", b"!?", b".,;:"
_HIGH = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """What the trees see of a text."""
    b = text.encode("utf-8", "surrogatepass")
    words, size = b.split(), len(b)
    n, lines = len(words), [line for line in b.split(b"\n") if line]
    per_byte = lambda chars: (size - len(b.translate(None, chars))) / max(size, 1)
    lengths = sum(map(len, words))
    return [
        math.log1p(n), lengths / max(n, 1), max(map(len, words), default=0), len(set(words)) / max(n, 1), len(set(zip(words, islice(words, 1, None)))) / max(n - 1, 1),
        sum(map(eq, words, islice(words, 1, None))) / max(n - 1, 1), per_byte(_UPPER), per_byte(_DIGITS), per_byte(_SYMBOLS), per_byte(b"|"), per_byte(_MARKS), per_byte(_STOPS), per_byte(_HIGH),
        math.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1),
    ]


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of x."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = 1.0, least: float = 1.0) -> Forest:
    n, k = x.shape
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0 if not n else (4.0 if y[0] else -4.0))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    start = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, start)
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), start)
    column = np.arange(k) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (k * bins) + column + binned).ravel()
            hist = [np.bincount(at, np.repeat(w, k), width * k * bins).reshape(width, k, bins) for w in (g, h)]
            (gl, hl), (gt, ht) = [a.cumsum(axis=2)[:, :, :-1] for a in hist], [a.sum(axis=2)[:, :, None] for a in hist]
            gr, hr = gt - gl, ht - hl
            gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2), 0).reshape(width, -1)
            best = gain.argmax(axis=1)
            f, b = best // (bins - 1), best % (bins - 1)
            for i in np.flatnonzero(gain.max(axis=1) > 1e-6):
                if b[i] < len(cuts[f[i]]):
                    out.feature[t, first + i], out.threshold[t, first + i] = f[i], cuts[f[i]][b[i]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.threshold[t, node])
        gs, hs = (np.bincount(node - inner, w, inner + 1) for w in (g, h))
        out.leaf[t] = -rate * gs / (hs + l2)
        total += out.leaf[t][node - inner]
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, th (the hash of the text), x (its statistics)."""

    def per_task():
        return lambda ids, texts: {"th": [text_hash(t) for t in texts], "x": [statistics(t) for t in texts]}

    return map_texts(id_and_text(docs), per_task, "th long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: doc_id, th (the hash of the text), score. learn: which labelled rows may be learned from; by default those outside the
    held-out fold."""
    learn = crc_mod("doc_id", 5) != 0 if learn is None else learn
    stats = staged(document_statistics(docs), "document-statistics")
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    labelled = staged(stats.join(marks.filter(learn), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", "x", "y"), "labelled-documents")
    # The bound is put on hashes before anything is sorted: no task sends more rows than it has below the limit.
    n = labelled.count()
    few = labelled.filter(F.shiftrightunsigned("h", 32) < int(2**32 * min(1.0, (max_rows + 4 * math.sqrt(max_rows)) / max(n, 1)))) if n > max_rows else labelled
    rows = few.orderBy("h", "doc_id").limit(max_rows).select("x", "y").collect()
    forest = fit(np.array([r.x for r in rows], float).reshape(len(rows), len(statistics(""))), np.array([r.y for r in rows], float))
    kind = stats.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["score"] = shared.value.score(np.stack(batch["x"].to_list())) if len(batch) else 0.0
            yield batch[["doc_id", "th", "score"]]

    # An id that is null or beyond 2^53 would not survive pandas as it is: it goes as text.
    texts = stats.select(F.col("doc_id").cast("string").alias("doc_id"), "th", "x").mapInPandas(score, "doc_id string, th long, score double")
    return texts.select(F.col("doc_id").cast(kind).alias("doc_id"), "th", "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, but for those whose score is below the threshold."""
    bad = quality_scores(docs, labels).filter(F.col("score") < threshold).select(F.col("doc_id").alias("id"), "th", F.lit(True).alias("all")).distinct()
    return drop_rows(docs, staged(bad, "rejected"))
