"""Scan lines and columns of many pages at once. A page is one row with its runs gathered (`gathered`); the pages of an Arrow batch lie one after the other in flat
arrays, with a slot for each line and an empty one after a page's last, so that a step is one operation for all of them. Runs are counted by
difference arrays: work is in proportion to runs and lines, not to pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scan lines, about, that are looked at together.
TOGETHER = 500_000


def gathered(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, width, height, own): each page with its runs. A run is on line y, or on the lines from y to y1 if there is such a column."""
    y1 = F.col("y1") if "y1" in runs.columns else F.col("y") + 1
    run = F.struct(*[c.cast("int").alias(n) for n, c in (("y", F.col("y")), ("y1", y1), ("x0", F.col("x0")), ("x1", F.col("x1")))])
    own = runs.groupBy("page_key").agg(F.collect_list(run).alias("own"))
    return pages.select("page_key", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).join(own, "page_key", "left")


def each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of n: the group of every member, and its place in there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of]


def stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the slots that are on begin and end."""
    change = np.diff(on.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def joined(group: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of a group that lie at most its gap apart, joined."""
    apart = np.ones(len(start) + 1, bool)
    apart[1:-1] = (group[1:] != group[:-1]) | (start[1:] - end[:-1] > gap[group[1:]])
    return group[apart[:-1]], start[apart[:-1]], end[apart[1:]]


class Lines:
    """The pages of a batch, their runs (page, y, y1, x0, x1) and their lines: page and y of each slot, and the ink before each slot."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.keys = batch["page_key"]
        self.w, self.h = (np.maximum(batch[c].fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64) for c in ("width", "height"))
        self.page = np.repeat(np.arange(len(self.h)), batch["own"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        self.runs = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch["own"].flatten().flatten()]
        y, y1, x0, x1 = self.runs
        self.base = np.cumsum(self.h + 1) - self.h - 1
        self.of, self.y = each(self.h + 1)
        self.ends = np.clip(y, 0, self.h[self.page]), np.clip(y1, 0, self.h[self.page])
        top, low = (self.base[self.page] + e for e in self.ends)
        ink = np.cumsum(np.bincount(top, x1 - x0, len(self.of)) - np.bincount(low, x1 - x0, len(self.of)))
        self.before = np.concatenate([[0.0], np.cumsum(ink)])

    def smooth(self) -> np.ndarray:
        """Mean ink of the lines around each, as layout.box_smooth with layout.smooth_window; 0 in the slot after a page."""
        win = np.maximum(1, np.floor(self.h * 0.012))
        half = np.where(win <= 1, 0, win // 2).astype(np.int64)[self.of]
        h, base = self.h[self.of], self.base[self.of]
        low, high = np.maximum(0, self.y - half), np.minimum(h, self.y + half + 1)
        return np.where(self.y < h, (self.before[base + high] - self.before[base + low]) / np.maximum(high - low, 1), 0.0)

    def lit(self) -> np.ndarray:
        """Whether a line's share of the width is above 0.02 and above 6 % of the page's greatest."""
        share = self.smooth() / np.maximum(self.w, 1)[self.of]
        return share > np.maximum(0.02, 0.06 * np.maximum.reduceat(share, self.base))[self.of]

    def bands(self, merge: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """page, y0 and y1 of the lit stretches; those at most a gutter apart are one."""
        start, end = stretches(self.lit())
        page = self.of[start]
        found = page, start - self.base[page], end - self.base[page]
        return joined(*found, np.maximum(2, np.floor(self.h * 0.012))) if merge else found

    def boxes(self) -> tuple[np.ndarray, ...]:
        """page, y0, y1, x0, x1 and odd of the boxes of tall bands, as layout.split_band_columns finds them: from top to bottom, then from left to right."""
        page, b0, b1 = self.bands()
        page, b0, b1 = (c[b1 - b0 >= np.maximum(4, np.floor(self.h * 0.06))[page]] for c in (page, b0, b1))
        at, top, low = self.base[self.page], self.base[page] + b0, self.base[page] + b1
        first, last = np.searchsorted(low, at + self.ends[0], "right"), np.searchsorted(top, at + self.ends[1], "left")
        run, nth = each(np.maximum(0, last - first))
        band = first[run] + nth
        rows = np.minimum(low[band], (at + self.ends[1])[run]) - np.maximum(top[band], (at + self.ends[0])[run])
        width = self.w[page]
        base = np.cumsum(width + 1) - width - 1
        of, x = each(width + 1)
        step = lambda c: np.bincount(base[band] + np.clip(c[run], 0, width[band]), rows, len(of))
        share = np.cumsum(step(self.runs[2]) - step(self.runs[3])) / (b1 - b0)[of]
        most = np.maximum.reduceat(share, base) if len(base) else share
        start, end = stretches(share > np.maximum(0.02, 0.06 * most)[of])
        group, start, end = joined(of[start], x[start], x[start] + end - start, np.maximum(2, np.floor(width * 0.04)))
        wide = end - start >= width[group] * 0.28
        split = np.bincount(group, wide, len(page)) >= 2
        edge = np.flatnonzero(np.diff(group, prepend=-1))  # the first block of each band that has one
        left, right = np.zeros(len(page), np.int64), np.zeros(len(page), np.int64)
        left[group[edge]], right[group] = start[edge], end
        whole = np.zeros(len(group), bool)
        whole[edge] = True
        kept = np.where(split[group], wide, whole)
        group, start, end = group[kept], start[kept], end[kept]
        start, end = np.where(split[group], start, left[group]), np.where(split[group], end, right[group])
        odd = split | (right - left < width * 0.4) | (b1 - b0 > right - left)
        return page[group], b0[group], b1[group], start, end, odd[group]


def by_page(d: DataFrame, work: Callable[[Lines], dict[str, object]], kind: str) -> DataFrame:
    """What `work` makes of gathered pages: columns of arrays, the first of which says by number which page a row is of."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            upto = np.cumsum(np.maximum(batch["height"].fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64))
            cuts = np.flatnonzero(np.diff((upto - upto[:1]) // TOGETHER, prepend=-1, append=-1)) if batch.num_rows else []
            for a, b in pairwise(cuts):
                part = Lines(batch.slice(a, b - a))
                page, *columns = work(part)
                yield pa.RecordBatch.from_arrays([part.keys.take(pa.array(page)), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], names)

    kind = f"page_key {d.schema['page_key'].dataType.simpleString()}, {kind}"
    names = [c.split()[0] for c in kind.split(", ")]
    return d.mapInArrow(batches, kind)


def smooth_lines(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, y, smooth): the mean ink around every scan line."""

    def work(p: Lines) -> list:
        own = p.y < p.h[p.of]
        return [p.of[own], p.y[own].astype(np.int32), p.smooth()[own]]

    return by_page(gathered(runs, pages), work, "y int, smooth double")


def lit_lines(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, y, lit) for every scan line."""

    def work(p: Lines) -> list:
        own = p.y < p.h[p.of]
        return [p.of[own], p.y[own].astype(np.int32), p.lit()[own]]

    return by_page(gathered(runs, pages), work, "y int, lit boolean")


def lit_runs(runs: DataFrame, pages: DataFrame, merge: bool = True) -> DataFrame:
    """(page_key, start, end): stretches of lit lines, those at most a gutter apart merged or not."""

    def work(p: Lines) -> list:
        page, start, end = p.bands(merge)
        return [page, start.astype(np.int32), end.astype(np.int32)]

    return by_page(gathered(runs, pages), work, "start int, end int")


def page_boxes(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_key, width, height, ink, boxes): each page with its ink pixels and its boxes (y0, y1, x0, x1, odd), in pixels, from top to bottom and left to right."""

    def work(p: Lines) -> list:
        page, *box = p.boxes()
        n = len(p.h)
        ends = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=n))]).astype(np.int32)
        names = ("y0", "y1", "x0", "x1", "odd")
        box = pa.StructArray.from_arrays([pa.array(c.astype(bool if k == "odd" else np.int32)) for k, c in zip(names, box, strict=True)], names)
        y, y1, x0, x1 = p.runs
        ink = np.bincount(p.page, (y1 - y) * (x1 - x0), n).astype(np.int64)
        return [np.arange(n), p.w.astype(np.int32), p.h.astype(np.int32), ink, pa.ListArray.from_arrays(pa.array(ends), box)]

    return by_page(gathered(runs, pages), work, "width int, height int, ink bigint, boxes array<struct<y0:int,y1:int,x0:int,x1:int,odd:boolean>>")
