"""Near-dedup of edited texts: covering tables choose the candidates, whole sets of five-word shingles judge them.

A text is the set of hashes of its five-word shingles; texts with equal sets are folded into one node. Two texts are linked if the Jaccard
similarity of their sets is `similar` (0.8) or more. Candidates come from two kinds of print, both under covering masks (`simhash.tables`):

  sign bits    the 64-bit SimHash of the shingles, in the 31 tables of radius 4 of `simhash`;
  least hashes PRINTS prints of 8 places, each the least of a hash function over the set. Two sets agree in a place with the probability of
               their similarity. 14 tables of radius 3 look at 4 places each, such that any 3 differing places miss one of them.

Sign bits alone can't keep the promise: at a similarity of 0.8, some 10 of the 64 bits differ. Of the least hashes, a print of 8 has at most 3
differing places with probability 0.944 at that similarity, and all three prints fail with probability 0.0001, whatever was edited.

The buckets' least members are summed up before their shuffle. Each node is held against the least node it meets; then against the least nodes
of its other buckets, where they are not yet joined. What is left are buckets that still hold several components. Where LIMIT nodes at most are
outside a bucket's largest component, they are held against all others: one step, in which a row is sent once, or, if it is held, once for each LIMIT rows
that pass by, so some 2 n rows for n members, and a task holds some 2 x LIMIT sets.

Larger ones, such as of many texts on one template, are dealt anew by prefixes: of its shingles, rarest first (counted over the texts of such buckets), a
set of n shares one of the first n - 0.8 n + 1 with every set that it is linked to. What texts on one template have in common is frequent, so it is not in
their prefixes unless they are linked; rows sent are one for each shingle and then one for each shared shingle of a prefix. Only where still more than LIMIT
nodes of several components share a rare shingle there are several steps, LIMIT nodes held at a time, between which components are found anew; that is
the one part whose rows can grow faster than the members, by one round for each LIMIT of them. Only texts that share a bucket are read again for their sets.

Defined results: null counts as empty. Texts without words are alike. Texts of under five words have one shingle, the whole sequence. A row is known by
its doc_id and text: rows equal in both stay or go together. A null doc_id comes after all others. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, staged
from .components import components
from .exact import drop_rows, in_set, text_hash
from .simhash import majority, masks, tables

WORDS, SIMILAR, LIMIT, RADIUS = 5, 0.8, 1024, 4
PRINTS, PLACES, CHUNK = 3, 8, 8192
_ODD = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_EACH = np.random.default_rng(1).integers(1, 2**63, (PRINTS * PLACES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_BLOCKS = np.array([t for t in tables([8 + i for i in range(PLACES)], 3) if len(t) < PLACES])  # the table of all places only meets equal prints
_MASKS = np.array(masks(RADIUS), np.uint64)
_TABLE = np.random.default_rng(2).integers(1, 2**63, len(_MASKS) + PRINTS * len(_BLOCKS), np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, from the words' hashes; of all words if they are fewer."""
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _ODD[i]
    return _stir(out)


def hashes(text: str) -> np.ndarray:
    """Of each shingle a hash, with repeats."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return _mixed(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), WORDS) if w else np.zeros(0, np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """The set of shingles, in order, as 32-bit numbers: in sets of 20,000, chance moves a similarity by less than 0.00001."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def name_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes())


def bucket_keys(h: np.ndarray) -> np.ndarray:
    """The text's bucket in each table; none without words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    signs = _MASKS & np.uint64(majority(h))
    least = np.full(PRINTS * PLACES, np.iinfo(np.uint64).max)
    for at in range(0, len(h), CHUNK):
        x = h[at : at + CHUNK] * _EACH
        least = np.minimum(least, ((x ^ (x >> np.uint64(31))) * _ODD[0]).min(axis=1))
    places = least.reshape(PRINTS, PLACES)[:, _BLOCKS] * _ODD[: _BLOCKS.shape[1]]
    return _stir(_stir(np.concatenate([signs, places.sum(axis=2).ravel()])) + _TABLE)


def alike(one: np.ndarray, owner: np.ndarray, each: np.ndarray, sizes: np.ndarray, similar: float) -> np.ndarray:
    """Which sets have the similarity with `one`; `each` holds the sets end to end, `owner` whose each value is."""
    if not len(one):
        return sizes == 0
    hit = one[np.minimum(np.searchsorted(one, each), len(one) - 1)] == each
    both = np.bincount(owner[hit], minlength=len(sizes))
    return both >= similar * (len(one) + sizes - both) - 1e-9


def cross_links(held: list[tuple], rest: list[tuple], similar: float) -> list[tuple[int, int]]:
    """Links of each held node with those held after it and with the rest, where they are of different components still: a spanning forest. A node
    is (node, root, set)."""
    every = held + rest
    roots, sizes = np.array([r for _, r, _ in every]), np.array([len(s) for _, _, s in every])
    owner, each, ends = np.repeat(np.arange(len(every)), sizes), np.concatenate([s for _, _, s in every]), np.cumsum(sizes)
    out = []
    for i, (node, _, own) in enumerate(held):
        # Sets whose sizes alone rule it out, and those of its own component, need no look.
        fit = (roots[i + 1 :] != roots[i]) & (sizes[i + 1 :] >= similar * sizes[i] - 1e-9) & (sizes[i] >= similar * sizes[i + 1 :] - 1e-9)
        if fit.any():
            hit = i + 1 + np.flatnonzero(fit & alike(own, owner[ends[i] :] - i - 1, each[ends[i] :], sizes[i + 1 :], similar))
            for x in hit:
                if roots[x] != roots[i]:
                    out.append((node, every[x][0]))
                    roots[roots == roots[x]] = roots[i]
    return out


def near_copies(docs: DataFrame, similar: float = SIMILAR, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, th (hash of the text), component_id (the smallest doc_id that it reaches over links, itself included) and low_th (the least
    hash of a text with that id in the component)."""
    rows, nodes, root = _linked(id_and_text(docs), similar, limit)
    whole = root.union(root.select("root", "root").distinct())
    lows = whole.join(nodes.select("node", "low"), "node")
    names = lows.groupBy("root").agg(F.min("low").alias("least"))
    linked = lows.join(names, "root").select("node", "least")
    # Written out: its join with the rows has an exchange of its own on either side, so a text with very many copies can be split.
    of = staged(nodes.select("node", "low").join(linked, "node", "left").select("node", F.coalesce("least", "low").alias("least")), "least-of-nodes")
    return rows.select("doc_id", "th", "node").join(of, "node").select("doc_id", "th", F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("low_th"))


def _linked(texts: DataFrame, similar: float, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their nodes, the nodes, and the components (node, root)."""

    def prints():
        def work(ids, found):
            each = [hashes(t) for t in found]
            return {
                "th": [text_hash(t) for t in found],
                "node": pa.array(np.array([name_of(shingles(h)) for h in each], np.uint64).view(np.int64)),
                "keys": [bucket_keys(h).view(np.int64) for h in each],
            }

        return work

    rows = staged(map_texts(texts, prints, "th long, node long, keys array<long>"), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("low")
    nodes = staged(rows.groupBy("node").agg(least), "nodes")
    keys = rows.select("node", F.explode("keys").alias("h"))
    shared = staged(keys.groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("h", "least"), "shared-buckets")
    members = staged(in_set(keys, shared, "h").join(shared, "h"), "bucket-members")

    # Sets, only of texts that share a bucket: their ids say which texts are read again.
    wanted = staged(members.select("node").distinct().join(nodes, "node").select("node", F.xxhash64("low.doc_id").alias("k")), "wanted")
    again = texts.withColumn("k", F.xxhash64("doc_id"))

    def sets_of():
        def work(ids, found):
            each = [shingles(hashes(t)) for t in found]
            return {"node": pa.array(np.array([name_of(s) for s in each], np.uint64).view(np.int64)), "s": [s.tobytes() for s in each]}

        return work

    found = map_texts(in_set(again, wanted, "k").select("doc_id", "text"), sets_of, "node long, s binary")
    sets = staged(found.select("node", "s").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "candidate-sets")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            ok = []
            for a, b in zip(p["a"], p["b"], strict=True):
                one, two = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                ok.append(bool(alike(one, np.zeros(len(two), np.int64), two, np.array([len(two)]), similar)[0]))
            yield p.loc[np.array(ok, bool), ["u", "v"]]

    def judged(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
        return both.select("u", "v", "a", "b").mapInPandas(judge, "u long, v long")

    def rooted(df: DataFrame, root: DataFrame, *names: str) -> DataFrame:
        for c in names:
            df = df.join(root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
        return df

    met = staged(members.filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "met")
    links = staged(judged(met.groupBy("u").agg(F.min("v").alias("v"))), "links")
    root = components(links)
    links = links.union(staged(judged(rooted(met, root, "u", "v").filter("u_root <> v_root").select("u", "v")), "links"))
    root = components(links)

    def opened(inside: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
        """Of (h, node, node_root) the buckets of `least` or more that hold several components; those with the same members are one. Gives the plan (h,
        groups of nodes outside the largest component, spread of those that pass by over tasks) and the members with their groups."""
        inside = staged(inside, "held")
        n = inside.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("v"), F.bit_xor("node").alias("x"), F.min("node_root").alias("lo"), F.max("node_root").alias("hi"))
        h = staged(n.filter((F.col("n") >= least) & (F.col("lo") < F.col("hi"))).groupBy("n", "u", "v", "x").agg(F.min("h").alias("h")).select("h"), "open-buckets")
        sizes = inside.join(h, "h").groupBy("h", "node_root").agg(F.count("*").alias("m"))
        plan = sizes.groupBy("h").agg(F.max_by("node_root", F.struct("m", "node_root")).alias("large"), F.sum("m").alias("n"), F.max("m").alias("most"))
        plan = staged(plan.select("h", "large", F.ceil((F.col("n") - F.col("most")) / limit).cast("int").alias("groups"), F.ceil(F.col("n") / limit).cast("int").alias("spread")), "plan")
        group = F.when(F.col("node_root") == F.col("large"), F.col("groups")).otherwise(F.pmod(F.xxhash64("node"), "groups")).cast("int")
        return plan, staged(inside.join(plan, "h").withColumn("group", group).drop("large"), "dealt")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        each = [(n, r, np.frombuffer(s, np.uint32)) for n, r, s in zip(group["node"], group["node_root"], group["s"], strict=True)]
        held = group["held"].to_numpy()
        links = cross_links([x for x, y in zip(each, held, strict=True) if y], [x for x, y in zip(each, held, strict=True) if not y], similar)
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    def step(dealt: DataFrame, at: int) -> DataFrame:
        """Links of the nodes of group `at` with those of the groups after it."""
        now = dealt.filter((F.col("groups") > at) & (F.col("group") >= at)).withColumn("held", F.col("group") == at)
        spots = F.when(F.col("held"), F.sequence(F.lit(0), F.col("spread") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", "h"), "spread").cast("int")))
        sent = now.select("h", "node", "node_root", "held", F.explode(spots).alias("spot")).join(sets, "node")
        return staged(sent.groupBy("h", "spot").applyInPandas(search, "u long, v long"), "step-links")

    def none(df: DataFrame) -> bool:
        return not df.limit(1).count()

    plan, dealt = opened(rooted(members.select("h", "node").distinct(), root, "node"), 3)
    if none(plan):
        return rows, nodes, root
    links = links.union(step(dealt.filter("groups = 1"), 0))
    root = components(links)
    large = staged(dealt.filter("groups > 1").select("node").distinct(), "large-buckets")
    if none(large):
        return rows, nodes, root
    plan, dealt = opened(rooted(staged(by_prefix(sets.join(large, "node"), similar), "prefixes"), root, "node"), 2)
    for at in range(plan.agg(F.coalesce(F.max("groups"), F.lit(0))).first()[0]):
        if at:
            dealt = rooted(dealt.drop("node_root"), root, "node")
        links = links.union(step(dealt, at))
        root = components(links)
    return rows, nodes, root


def by_prefix(sets: DataFrame, similar: float) -> DataFrame:
    """(h, node): each set's prefix shingles that other sets have too. Two sets that are linked share one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            parts = [np.frombuffer(s, np.uint32) for s in p["s"]]
            n = np.array([len(x) for x in parts], np.int64)
            if n.sum():
                yield pd.DataFrame({"h": np.concatenate(parts).astype(np.int64), "node": np.repeat(p["node"].to_numpy(), n), "size": np.repeat(n, n)})

    shingle = sets.select("node", "s").mapInPandas(each, "h long, node long, size long")
    often = staged(shingle.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shared-shingles")
    own = shingle.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("xs"), F.first("size").alias("size"))
    # Shingles that no other set has come first and meet nobody.
    prefix = F.col("size") - F.ceil(F.lit(similar) * F.col("size") - 1e-9) + 1
    take = F.greatest(F.lit(0), prefix - (F.col("size") - F.size("xs"))).cast("int")
    return own.select("node", F.explode(F.slice("xs", F.lit(1), take)).alias("x")).select("x.h", "node")


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs that stay: of each component those with the smallest doc_id."""
    low = F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("low_th") == F.col("th"))
    gone = near_copies(docs, similar).filter(~low).select(F.col("doc_id").alias("id"), "th", F.lit(True).alias("all")).distinct()
    return drop_rows(docs, staged(gone, "near-gone"))
