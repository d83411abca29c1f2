"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint of 64 bits is the majority vote, bit by bit, of the XXH64 hashes of a text's word shingles. Candidate pairs come
from 2^(r+1) - 1 tables (31 for radius r = 4). Bit i is given the vector m(i), one of the non-zero vectors of r+1 bits in turn; table v
looks at the bits with <m(i), v> = 1 (mod 2). r differing bits span r dimensions at most, so some v is orthogonal to all of
them: the pair agrees in table v. No pair within the radius is missed, and each table compares about 33 bits.

Copies are folded before anything else: only distinct fingerprints enter the tables. A bucket of two is compared by an
expression. A bucket of up to LIMIT fingerprints is searched in one task, block by block, and gives a spanning forest of its links, never
all pairs. Larger buckets use a form whose work is linear in the bucket: two fingerprints are within 4 bits if and only
if some point is within 2 bits of both, so each is written to the points around it (bits outside the table's mask only, under
500) and the at most 500 fingerprints that meet in a point are linked to the least of them. Links are exact in all three.
The components of the link graph are found by `components`.

The buckets' sizes and least members are summed up before their shuffle and written out; a set or a Bloom filter of the shared buckets then
keeps the rows of all others from being shuffled again, and adaptive execution can split the join of a hot one.

Defined results: null and empty texts, and texts of white space, have the fingerprint zero and link like any other;
texts of fewer words than a shingle have one shingle, the whole sequence. A null doc_id never names a component unless it
has no other. Repeated rows get equal results. No rows in, no rows out. Other columns play no part in it.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, staged
from .components import components
from .exact import in_set

LIMIT = 4096


def fingerprint(text: str, words: int) -> int:
    """A fingerprint bit is 1 if it is set in more than half of the shingles' hashes."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), joined), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def per_task():
        return lambda ids, texts: {"fp": pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))}

    return map_texts(id_and_text(docs), per_task, "fp long")


def tables(vectors: list[int], radius: int) -> list[list[int]]:
    """Of each table the places that it looks at. vectors: one of radius + 1 bits for each place of a print."""
    return [[i for i, m in enumerate(vectors) if (m & v).bit_count() % 2] for v in range(1, 2 ** (radius + 1))]


def masks(radius: int) -> list[int]:
    """The tables over the 64 bits of a fingerprint, as masks."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    return [sum(1 << i for i in places) for places in tables(vectors, radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is linked within one bucket: each fingerprint is compared once with those not yet reached."""
    left, out = fps.view(np.uint64), []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            at = stack.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                hit = left[near]
                out += [(int(at.view(np.int64)), int(x)) for x in hit.view(np.int64)]
                stack.extend(hit)
                left = left[~near]
    return out


def links(fps: DataFrame, radius: int = 4, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints `fp` whose components are those of all pairs within the radius."""
    spark = fps.sparkSession
    each = masks(radius)
    buckets = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in each])).alias("t", "key"))
    shared = buckets.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1")
    shared = staged(shared, "buckets")
    near = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius
    twos = shared.filter((F.col("n") == 2) & near).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    # Most buckets hold one fingerprint. The hashes of the others keep their rows from a second shuffle.
    full = shared.filter("n > 2").select("t", "key", "n").withColumn("h", F.xxhash64("t", "key"))
    members = in_set(buckets.withColumn("h", F.xxhash64("t", "key")), full, "h").drop("h").join(full.drop("h"), ["t", "key"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(group["fp"].to_numpy(), radius), columns=["u", "v"], dtype="int64")

    some = members.filter(F.col("n") <= limit).groupBy("t", "key").applyInPandas(search, "u long, v long")
    out = twos.union(some)
    if shared.filter(F.col("n") > limit).limit(1).count():
        half = radius // 2
        free = [[b for b in range(64) if not m >> b & 1] for m in each]
        flips = [(t, _signed(sum(1 << b for b in bits))) for t, f in enumerate(free) for k in range(half + 1) for bits in combinations(f, k)]
        around = F.broadcast(spark.createDataFrame(flips, "t int, flip long"))  # 31 x under 500 rows, whatever the data
        points = members.filter(F.col("n") > limit).join(around, "t").select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        # radius is even: a pair within it has a point within half of it from both. A point has under 500 fingerprints about it.
        least = points.groupBy("t", "point").agg(F.min("fp").alias("m"), F.count("*").alias("k")).filter("k > 1")
        out = out.union(points.join(least, ["t", "point"]).filter("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v")).distinct())
    return out


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id that it reaches over links, itself included)."""
    if radius % 2:
        raise ValueError("the radius must be even")
    prints = staged(fingerprints(docs, words), "fingerprints")
    rep = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    root = components(links(rep, radius, limit))
    # Roots have no row of their own: add them, then take the least doc_id of each component.
    whole = root.union(root.select("root", "root").distinct())
    named = whole.join(rep, F.col("node") == F.col("fp")).select("fp", "root", "low")
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = named.join(names, "root").select("fp", "component_id")
    # Written out: its join with the rows has an exchange of its own on either side, so a fingerprint of very many rows can be split.
    of = staged(rep.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "component-of-fingerprints")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs that stay: of each component the row with the smallest doc_id. Only ids are shuffled for the decision;
    the ids to drop then leave the texts by an anti join. Rows that share a doc_id go or stay together; rows without one stay."""
    gone = near_duplicates(docs, words, radius).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
