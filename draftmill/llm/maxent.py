"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased words and one end per text. Counts are taken over all training texts: each task sums its own and sends
(word, n). The most frequent words, HEAD at most, are broadcast (a bounded table, about 4 MB); the other words of a text are joined to their counts by a
shuffle, summed per text, so no table grows on the driver.

The model: the words of the head, and one leaf for all other words, are the leaves of a Huffman tree over their counts: nested classes. P(w | h) is
the product of the binary decisions on the way to w's leaf. A decision is a logistic function of a sum of weights: the node's bias and one
weight for each hashed pair of the node and a feature of the history h (the word before, and the one two before; the README has what other sets gave).
At the last leaf a word's share is its smoothed count. So the probabilities of all words sum to one whatever the weights. The
table of hashed weights has PER_KIND places for each distinct word, up to 2 ** MOST_BITS, where its bound is.

Training: one pass over all positions of every training text, in ROUNDS rounds, each over a slice of the texts. In a round, tasks start from
the broadcast weights and take gradient steps over their own texts in batches: a weight moves by the sum of its gradients over its
curvature. The tables that they end with are averaged, in blocks, by a shuffle; a weight counts by the curvature that it met in the task. A
task sends a table of at most 17 MB for TOKENS positions, so what is sent is in proportion to the input, and there are more tasks on more input.

Words are split, lower-cased, counted and looked up by Arrow, a piece of the texts at a time. Scoring takes a slice of documents at a time: one sparse
gather of the weights of all decisions. Within a batch or slice the positions are taken by word: what is added up doesn't depend on their order, and
the ways of equal words stay in a core's cache.

Defined results: null text counts as empty; it has one token, the end. Without training texts N and V are 0, every count is 0 and the model is
the last leaf alone. Repeated rows get equal results, a null doc_id stays null (and counts as the text 'null' for the
split). Only doc_id and text are read, whatever other columns there are; no rows in, no rows out.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, crc_mod, id_and_text, most_frequent, staged, to_arrow

END = b"\n"  # no word holds white space
HEAD, PER_KIND, LEAST_BITS, MOST_BITS = 1 << 17, 16, 12, 22
COUNTED, ROUNDS, BATCH, RATE, BLOCK = 1 << 19, 2, 1 << 16, 0.6, 1 << 15
TOKENS, FAN = 10_000_000, 64  # training tokens of a task; tasks whose tables are averaged in one step
PIECE, POSITIONS = 4_000_000, 1 << 11  # bytes of text whose words are looked up at a time; positions that are worked on at a time
SCALE, SPARSE = 4096, 1 << 14
EASE = 4.0  # curvature that a weight counts as met before its first example
RARE = 1 << 16  # history codes of the words outside the head
FEATURES = 2
_ODD = np.array([0x9E3779B1, 0xC2B2AE3D], np.uint64)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts one after the other, and how many each text has; ends are not among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().cast(pa.binary())
    full = pc.binary_length(words).to_numpy() > 0  # white space before the first word or after the last gives an empty one
    offsets = lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    if not full.all():
        words = words.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return words, np.diff(offsets)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PIECE bytes of text: some slices of SLICE rows, one at least."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(size, PIECE + (size[at - 1] if at else 0), "right")) - at
            rows = fits if at + fits == batch.num_rows else max(SLICE, fits // SLICE * SLICE)
            yield batch.slice(at, rows)
            at += rows


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of docs."""
    schema = "word binary, n long"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        texts = 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        for piece in pieces(batches):
            texts += piece.num_rows
            held.append(pa.table(pc.value_counts(words_of(piece.column(1))[0]).flatten(), ["word", "n"]))
            if sum(map(len, held)) > 2 * COUNTED:
                held = [merged()]
                if len(held[0]) > COUNTED:
                    yield from held.pop().cast(arrow).to_batches(20_000)
        if held:
            yield from merged().cast(arrow).to_batches(20_000)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Model:
    """What tasks need. Word i of the head has code i + 1, count counts[i]; code 0 stands before a text's first word."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N
    kinds: int  # V
    classes: np.ndarray | None = None  # weights of hashed pairs of a feature and a node
    inner: np.ndarray | None = None  # biases of the tree's inner nodes
    seen: np.ndarray | None = None  # of each weight the curvature that its steps have met so far (hashed pairs, then biases)
    first: np.ndarray | None = None  # of each leaf (the last one for all other words) where its way starts in `way`, and the end
    way: np.ndarray | None = None  # the decisions on the leaves' ways: twice the inner node, plus 1 for the second child

    @property
    def modelled(self) -> int:
        return len(self.words)

    @property
    def rest(self) -> float:
        """log10 of the denominator of a word's share in the last leaf."""
        return float(np.log10(self.total - int(self.counts.sum()) + self.kinds - self.modelled + 1))

    def start(self) -> None:
        """The tree; biases from counts, all other weights zero."""
        m = self.modelled
        mass = [*map(int, self.counts), self.total - int(self.counts.sum()) + self.kinds - m + 1]
        up = np.zeros(2 * m + 1, np.int32)
        heap = [(n, i) for i, n in enumerate(mass)]
        heapq.heapify(heap)
        odds = np.zeros(m)
        for node in range(m + 1, 2 * m + 1):
            (n, i), (k, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j] = 2 * node, 2 * node + 1
            odds[node - m - 1] = k / n if n else 1.0
            heapq.heappush(heap, (n + k, node))
        # All leaves go up one step at a time.
        leaf, node, parts = np.arange(m + 1), np.arange(m + 1), []
        while m:
            leaf, node = leaf[node != 2 * m], node[node != 2 * m]
            if not len(leaf):
                break
            step = up[node]
            node = step >> 1
            parts.append((leaf, 2 * (node - m - 1) + (step & 1)))
        at = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        self.way = (np.concatenate([w for _, w in parts])[order] if parts else np.zeros(0)).astype(np.int32)
        self.first = np.searchsorted(at[order], np.arange(m + 2))
        bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(PER_KIND * max(1, self.kinds))))))
        self.inner, self.classes = np.log(odds).astype(np.float32), np.zeros(1 << bits, np.float32)
        self.seen = np.zeros(len(self.classes) + m, np.float32)

    def decisions(self, feats: np.ndarray, codes: np.ndarray, keep: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """On the ways to words' leaves: where each word's decisions start, and of each decision its inner node, child, log-odds of the second
        child, and the places of its weights (keep: of all features, else of the last). The decisions of a word stand together."""
        m = self.modelled
        leaf = np.minimum((codes - 1).view(np.uint64), np.uint64(m)).view(np.int64)  # code 0 goes to the last one too
        low = self.first.take(leaf)
        size = self.first.take(leaf + 1) - low
        ends = np.cumsum(size)
        at = np.repeat(low - ends + size, size)
        at += np.arange(len(at))
        step = self.way.take(at)
        node = step >> 1
        salt = node.astype(np.uint32)
        salt *= np.uint32(0x9E3779B1)
        shift = np.uint32(33 - len(self.classes).bit_length())
        places = np.empty((len(feats) if keep else 1, len(step)), np.int64)
        z, own = self.inner.take(node), np.empty(len(step), self.classes.dtype)
        for k, f in enumerate(feats):
            h = np.repeat(f, size)
            h ^= salt
            h *= np.uint32(0x85EBCA77)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE3D)
            h >>= shift
            here = places[k if keep else 0]
            here[:] = h
            z += self.classes.take(here, out=own, mode="clip")  # no place is out of bounds; this mode writes to `own` without a copy
        return ends - size, node, step & 1, z, places


def encoded(texts: pa.Array, head: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Codes of all tokens, ends included: 1, 2, ... in the head, beyond it a hash, one of RARE; where each text starts; and the rows and words of
    the tokens beyond the head."""
    words, sizes = words_of(texts)
    n = len(texts)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    ends = np.cumsum(sizes.astype(np.int64) + 1) - 1
    own = pc.index_in(words, value_set=head).fill_null(-1).to_numpy().astype(np.int64) + 1
    rare = np.flatnonzero(own == 0)
    rows, others = row[rare], words.take(pa.array(rare))
    hashed = lambda found: len(head) + 1 + np.fromiter((zlib.crc32(w) % RARE for w in found), np.int64, len(found))
    own[rare] = hashed(others.to_pylist())
    end = pc.index_in(pa.array([END], pa.binary()), value_set=head)[0].as_py()
    codes = np.empty(len(words) + n, np.int64)
    codes[np.arange(len(words)) + row] = own
    codes[ends] = hashed([END])[0] if end is None else end + 1
    if end is None:
        rows, others = np.concatenate([rows, np.arange(n, dtype=np.int32)]), pa.concat_arrays([others, pa.array([END] * n, pa.binary())])
    return codes, ends - sizes, rows, others


def features(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """FEATURES hashes for each position, from the codes of words before it within the text."""
    n = len(codes)
    plain = codes.astype(np.uint64)

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[k:] = plain[: max(0, n - k)]
        for j in range(k):  # the first k positions of a text have nothing there
            at = starts + j
            out[at[at < n]] = 0
        return out

    mixed = np.empty((FEATURES, n), np.uint32)
    for k, key in enumerate((back(1), back(2) + np.uint64(2 << 40))):
        key ^= key >> np.uint64(17)
        key *= _ODD[k] * np.uint64(0x100000001)
        key >>= np.uint64(32)
        mixed[k] = key
    return mixed


def log_prob(model: Model, codes: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Natural log of P(w | h), and of P(last leaf | h) for words outside the head."""
    out = np.zeros(len(codes))
    if not model.modelled:
        return out
    order = np.argsort(codes)  # as in training
    feats, codes = feats[:, order], codes[order]
    for start in range(0, len(codes), POSITIONS):
        part = slice(start, start + POSITIONS)
        starts, _, child, z, _ = model.decisions(feats[:, part], codes[part], keep=False)
        z *= np.float32(1) - (child << 1).astype(np.float32)
        lost = np.exp(-np.abs(z))
        lost += np.float32(1)
        np.log(lost, out=lost)
        lost += np.maximum(z, 0)
        out[order[part]] = -np.add.reduceat(lost, starts)
    return out


class Steps:
    """Gradient steps over examples, a batch at a time. A weight moves by the sum of a batch's gradients over its curvature: that of the
    examples it has met so far, and EASE, so a rare weight moves little on one example and a frequent one settles."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.met = model, rate, np.zeros_like(model.seen)
        # Gradient (upper half, may be negative) and curvature (lower half) of a batch, both in whole numbers of 1 / SCALE.
        self.total = np.zeros(len(model.seen), np.int64)
        # All weights in one array, of which the model's are parts.
        self.flat = np.concatenate([model.classes, model.inner])
        model.classes, model.inner = self.flat[: len(model.classes)], self.flat[len(model.classes) :]

    def batch(self, feats: np.ndarray, codes: np.ndarray) -> None:
        if not self.model.modelled:
            return
        hashed = len(self.model.classes)
        order = np.argsort(codes)  # equal words stand together, so their ways are in a core's cache
        feats, codes = feats[:, order], codes[order]
        for start in range(0, len(codes), POSITIONS):
            part = slice(start, start + POSITIONS)
            _, node, child, z, places = self.model.decisions(feats[:, part], codes[part])
            p = 1 / (1 + np.exp(-z))
            both = np.empty((len(p), 2), "<i4")  # the lower half first
            both[:, 0] = np.rint(p * (1 - p) * np.float32(SCALE))
            both[:, 1] = np.rint((p - child.astype(np.float32)) * np.float32(SCALE))
            both = both.view("<i8").ravel()
            for at in places:
                np.add.at(self.total, at, both)
            np.add.at(self.total, node + hashed, both)
        if len(codes) < SPARSE:
            hit = np.flatnonzero(self.total)
            total, met = self.total[hit], self.met[hit]
            self.flat[hit] -= self.moves(total, met, self.model.seen[hit])
            self.met[hit], self.total[hit] = met, 0
            return
        for at in range(0, len(self.total), BLOCK):  # what a block takes stays in a core's cache
            part = slice(at, at + BLOCK)
            self.flat[part] -= self.moves(self.total[part], self.met[part], self.model.seen[part])
            self.total[part] = 0

    def moves(self, total: np.ndarray, met: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """What weights move by; met gets what they met."""
        met += total.view("<u4")[::2].astype(np.float32) * np.float32(1 / SCALE)
        move = total.view("<i4")[1::2].astype(np.float32)
        move *= np.float32(self.rate / SCALE)
        move /= seen + met + np.float32(EASE)
        return move


def slices(docs: DataFrame, rounds: int) -> list[DataFrame]:
    """docs, each row in one of the slices; a round of training learns from one."""
    return [docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r) for r in range(rounds)]


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS, rate: float = RATE) -> None:
    """One pass over all positions of docs (doc_id, text), in rounds of local gradient steps and averaging; `model` gets the weights."""
    spark = docs.sparkSession
    model.start()
    tasks = max(1, -(-model.total // TOKENS))
    for part in slices(docs, rounds):
        data = part.coalesce(tasks)
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            m = sent.value
            # The curvature of earlier rounds, of which this task stands for a share.
            mine = replace(m, classes=m.classes.copy(), inner=m.inner.copy(), seen=m.seen / np.float32(tasks))
            steps, head = Steps(mine, rate), pa.array(m.words, pa.binary())
            held, rows = [], 0

            def learn():
                codes = np.concatenate([c for c, _ in held])
                starts = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in held]))[:-1]])
                steps.batch(features(codes, starts), codes)
                held.clear()

            for piece in pieces(batches):
                codes, starts, _, _ = encoded(piece.column(1), head)
                bounds = np.append(starts, len(codes))
                for at in range(0, piece.num_rows, SLICE):
                    own = bounds[at : at + SLICE + 1]
                    held.append((codes[own[0] : own[-1]], np.diff(own)))
                    rows += len(held[-1][0])
                    if rows >= BATCH:
                        learn()
                        rows = 0
            if held:
                learn()
            if steps.met.any():
                flat, met = np.concatenate([mine.classes, mine.inner]), np.minimum(steps.met, 60_000)
                for block, at in enumerate(range(0, len(flat), BLOCK)):
                    cells = [flat[at : at + BLOCK].astype("<f2").tobytes(), met[at : at + BLOCK].astype("<f2").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([block, TaskContext.get().partitionId(), *cells], kind, strict=True)], schema=kind)

        def average(group: pd.DataFrame) -> pd.DataFrame:
            """Weights count by the curvature that they met, so tasks which never met a pair don't pull its weight back."""
            w, met = (np.stack([np.frombuffer(x, "<f2") for x in group[c]]).astype(float) for c in ("w", "met"))
            whole = met.sum(axis=0)
            total = np.where(whole > 0, (w * met).sum(axis=0) / np.where(whole > 0, whole, 1), 0)
            return pd.DataFrame({"block": [group["block"].iloc[0]], "task": [0], "w": [total.astype("<f2").tobytes()], "met": [np.minimum(whole, 60_000).astype("<f2").tobytes()]})

        schema = "block int, task int, w binary, met binary"
        kind = to_arrow(spark, schema)
        tables = data.mapInArrow(run, schema)
        if tasks > FAN:  # in two levels, so that a group has a bounded number of blocks
            few = math.isqrt(tasks)
            tables = tables.groupBy("block", (F.col("task") % few).alias("few")).applyInPandas(average, schema)
        got = {r.block: r for r in tables.groupBy("block").applyInPandas(average, schema).collect()}
        sent.unpersist()
        if got:
            w, met = (np.concatenate([np.frombuffer(got[b][c], "<f2") for b in range(len(got))]).astype(np.float32) for c in ("w", "met"))
            flat = np.where(met > 0, w, np.concatenate([model.classes, model.inner]))
            model.classes, model.inner, model.seen = flat[: len(model.classes)].copy(), flat[len(model.classes) :].copy(), model.seen + met


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, rid, n_tokens, the sums over the words of the head, and the other words with their counts in the text."""
    half = model.classes.astype(np.float16) if model.classes is not None else None  # exact: averaged tables are of that precision
    sent = docs.sparkSession.sparkContext.broadcast(replace(model, classes=half))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rid long, n_tokens long, head_known long, head_log double, model_log double, tail array<struct<word: binary, n: long>>"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m = sent.value
        head = pa.array(m.words, pa.binary())
        logs = np.concatenate([[0.0], np.log10(m.counts + 1.0)])
        rid = TaskContext.get().partitionId() << 40
        for piece in pieces(batches):
            codes, starts, rows, others = encoded(piece.column(1), head)
            n, bounds = len(starts), np.append(starts, len(codes))
            model_part = np.empty(len(codes))
            for at in range(0, n, SLICE):
                low, high = bounds[at], bounds[min(at + SLICE, n)]
                model_part[low:high] = log_prob(m, codes[low:high], features(codes[low:high], starts[at : at + SLICE] - low))
            model_part /= np.log(10)
            known = codes <= len(head)
            # At the last leaf a word's share is (c + 1) / rest; c is joined later.
            model_part[~known] -= m.rest
            # The other words of each text, once each with their number.
            found = pa.table([pa.array(rows), others], ["row", "word"]).group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")])
            order = np.argsort(found["row"].to_numpy(), kind="stable")
            found = found.take(pa.array(order)).combine_chunks()
            column = lambda name: pa.concat_arrays(found[name].chunks) if found.num_rows else pa.array([], found[name].type)
            offsets = np.searchsorted(found["row"].to_numpy(), np.arange(n + 1))
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([column("word"), column("count_all")], ["word", "n"]))
            sums = [np.diff(bounds), np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(logs[np.where(known, codes, 0)], starts), np.add.reduceat(model_part, starts)]
            columns = [piece.column(0), np.arange(rid, rid + n), *sums, tail]
            rid += n
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def language_scores(docs: DataFrame, learn: Column | None = None, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score. learn: which rows are learned from; by default those
    outside the held-out fold."""
    docs = id_and_text(docs)
    learn = crc_mod("doc_id", 7) != 2 if learn is None else learn
    counts = staged(count_words(docs.filter(learn)), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = sorted(((-c, bytes(w)) for w, c in most_frequent(counts, head).collect()))
    model = Model([w for _, w in top], np.array([-c for c, _ in top], np.int64), n, v)
    train(docs.filter(learn), model, rounds)
    model.seen = None
    parts = staged(score_texts(docs, model), "scored")
    tail = parts.select("rid", F.explode("tail").alias("t")).select("rid", "t.word", "t.n")
    sums = tail.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("tail_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"))
    both = parts.drop("tail").join(sums, "rid", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail_log - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("model_log") + tail_log).alias("score"),
    )
