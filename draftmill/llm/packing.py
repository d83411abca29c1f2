"""Best-fit packing of token sequences: bounded-space online best fit.

Each task tokenizes its documents, cuts those longer than a sequence and packs the pieces at once; nothing is shuffled. A
fixed number of sequences is open at a time. They are kept by free space, with a bitset of the free spaces that occur: the
best fit for n tokens is the lowest bit at n or above. When one more would be open than is allowed, the fullest closes. Pieces wait in a
window of a bounded number of tokens and are placed longest first, which packs nearly as well as best fit over all.

Sequence ids hold the number of the partition in their upper bits, so tasks need not agree on them, and a task
that is run again gives the same ids. Where documents come in spans of a mix, each span is packed alone, without what is left open by the span
before, and its number takes the place of the partition's: sequence ids ascend by span, so the first sequences hold the first spans.

Defined results: null text counts as empty; an empty text is one piece of the end token alone. Repeated rows are packed one
by one. A null doc_id stays null. No rows in, no rows out. Other columns play no part in it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpeIds
from .common import SLICE, id_and_text, text_of, to_arrow

CAPACITY, OPEN, WINDOW = 2048, 8192, 1 << 22
SPAN_BITS = 32  # of a sequence id, for the sequences of one span


class OpenBins:
    """At most `most` open bins of `capacity`, by free space."""

    def __init__(self, capacity: int, most: int, first_id: int = 0):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.n = 0, 0

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of 1 to `capacity` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.next_id
            self.next_id += 1
        if rest := free - length:
            self.by_free[rest].append(bin_)
            self.bits |= 1 << rest
            self.n += 1
            if self.n > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all of the full length, but for the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN, window: int = WINDOW, span: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, sequence_id, offset, ids (little-endian unsigned 32-bit ids, as BINARY). span: a column of whole
    numbers, from 0, by which the partitions of docs are sorted and of which none is in two partitions."""
    docs = docs.select("doc_id", text_of().alias("text"), F.col(span).cast("long").alias("span")) if span else id_and_text(docs)
    full = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, sequence_id long, offset long, ids binary"
    arrow = to_arrow(docs.sparkSession, full)

    def run(batches):
        from pyspark import TaskContext

        ids_of, end = ByteBpeIds(tokenizer), end_id.to_bytes(4, "little")
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        held, waiting, now = [], 0, None

        def flush():
            held.sort(key=lambda p: -p[3])
            for at in range(0, len(held), 2000):
                rows = [(d, k, s, n, *bins.place(n), ids) for d, k, s, n, ids in held[at : at + 2000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                spans = part.column(2).to_pylist() if span else [None] * part.num_rows
                for doc_id, text, of in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), spans, strict=True):
                    if of != now:
                        yield from flush()
                        bins, waiting, now = OpenBins(capacity, open_bins, of << SPAN_BITS), 0, of
                    ids = ids_of(text) + end
                    waiting += len(ids) // 4
                    held += [(doc_id, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
                    if waiting >= window:
                        yield from flush()
                        waiting = 0
        yield from flush()

    return docs.mapInArrow(run, full)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, and the share of the sequences' room that tokens fill."""
    return packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("sequences") * capacity))
