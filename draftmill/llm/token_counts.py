"""Token counts by a map-side two-tier lookup.

First tier: a broadcast hash table of the token counts of frequent pre-tokens, of at most HEAD entries (about 4 MB). Second
tier: a cache in each Python worker, for the rest; what both miss is encoded by the tokenizer's library. No pre-token is shuffled: to
find the frequent ones each task counts its own in bounded space and sends one record, a sketch of its CANDIDATES most frequent; sketches are
merged as a tree. Nothing depends on that table but speed.

A pre-token is here a run without ASCII white space. The tokenizer drops white space and its pieces never reach over it, so a
text's tokens are those of its pre-tokens; strings of special tokens hold no white space and meet the library whole.

Defined results: null text counts as empty and has no tokens. Repeated rows get equal results, a null doc_id stays null.
No rows in, no rows out. Other columns play no part in it.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, load
from .common import SLICE, id_and_text, map_texts, staged, to_arrow

HEAD, CANDIDATES, COUNTED, FAN = 1 << 15, 1 << 13, 1 << 18, 32


def _sketch(count: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The CANDIDATES most frequent words, end to end (they hold no line feed), and their counts."""
    top = heapq.nsmallest(CANDIDATES, count.items(), key=lambda x: (-x[1], x[0]))
    return b"\n".join(w for w, _ in top), np.array([n for _, n in top], "<i8").tobytes()


def _merged(sketches) -> dict[bytes, int]:
    count: Counter = Counter()
    for words, n in sketches:
        if n:
            for w, k in zip(bytes(words).split(b"\n"), np.frombuffer(n, "<i8").tolist(), strict=True):
                count[w] += k
    return count


def frequent(docs: DataFrame, head: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent pre-tokens with their counts, as far as bounded counters in the tasks can tell; head at most. A task sends one record, a sketch of
    its CANDIDATES most frequent ones; sketches are merged as a tree, FAN at a time, so that a merge holds some FAN x CANDIDATES words and the driver the
    last FAN sketches."""
    schema = "task int, words binary, n binary"
    arrow = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text in batch.column(1).slice(at, SLICE).to_pylist():
                    count.update(text.encode("utf-8", "surrogatepass").split())
                if len(count) > COUNTED:  # what came once or twice goes; more, if that leaves too many
                    least = 2
                    while len(count) > COUNTED // 2:
                        count = Counter({w: n for w, n in count.items() if n > least})
                        least *= 2
        words, n = _sketch(count)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((TaskContext.get().partitionId(), words, n), arrow, strict=True)], schema=arrow)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        words, n = _sketch(_merged(zip(group["words"], group["n"], strict=True)))
        return pd.DataFrame({"task": [int(group["task"].iloc[0]) // FAN], "words": [words], "n": [n]})

    found = staged(docs.mapInArrow(run, schema), "frequent-words")
    while found.count() > FAN:
        found = staged(found.groupBy(F.floor(F.col("task") / FAN).alias("of")).applyInPandas(merge, schema), "frequent-words")
    count = _merged((r.words, r.n) for r in found.collect())
    return heapq.nsmallest(head, count.items(), key=lambda x: (-x[1], x[0]))


class Head(dict):
    """The first tier: a table of lengths. What it misses is asked of the second tier and not kept here."""

    def __init__(self, table: tuple[bytes, bytes], rest: Memo):
        super().__init__(zip(table[0].split(b"\n"), np.frombuffer(table[1], "<u4").tolist(), strict=True) if table[0] else ())
        self.rest = rest

    def __missing__(self, word: bytes) -> int:
        return self.rest[word]


def token_counts(docs: DataFrame, tokenizer: str, head: int = HEAD) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens."""
    docs = id_and_text(docs)
    spark = docs.sparkSession
    coder = load(tokenizer)
    words = [w for w, _ in frequent(docs, head)]
    lengths = [len(e) for e in coder.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
    # Compact: the words end to end (they hold no line feed) and their lengths.
    table = spark.sparkContext.broadcast((b"\n".join(words), np.array(lengths, "<u4").tobytes()))

    def per_task():
        coder = load(tokenizer)
        head = Head(table.value, Memo(lambda w: len(coder.encode(w.decode("utf-8", "replace"), add_special_tokens=False))))

        def work(ids, texts):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            return {"n_bytes": [len(b) for b in raw], "n_tokens": [sum(map(head.__getitem__, b.split())) for b in raw]}

        return work

    return map_texts(docs, per_task, "n_bytes long, n_tokens long")
