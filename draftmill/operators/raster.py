"""Page rasters to ink runs: the one step that looks at pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def gray_of(pixels: bytes | np.ndarray, width: int, height: int) -> np.ndarray:
    """Gray levels of a raster of one (gray), three or four bytes (colour, luma of weights 77, 150, 29) a pixel."""
    a = np.frombuffer(pixels, np.uint8)
    depth = len(a) // max(width * height, 1)
    a = a[: depth * width * height]
    if depth == 2:
        a = a[::2]
    if depth >= 3:
        r, g, b = a.reshape(-1, depth).T[:3]
        a = ((r * np.uint16(77) + g * np.uint16(150) + b * np.uint16(29)) >> 8).astype(np.uint8)  # at most 65,280
    return a.reshape(height, width)


def percentile(gray: np.ndarray, pct: float, times: np.ndarray | int = 1) -> int:
    """The smallest level with pct percent of the pixels at or below it; a line counts `times`."""
    each = np.broadcast_to(times, gray.shape[:1])
    upto = np.bincount(gray.ravel(), np.repeat(each, gray.shape[1]), 256).cumsum()
    return int(min(255, np.searchsorted(upto, pct / 100 * upto[-1])))


def runs_of(gray: np.ndarray, times: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x0 and x1 of the stretches darker than the background; a line counts `times` in what the background is."""
    limit = min(235, max(120, percentile(gray, 95, times) - 40))
    edge = np.zeros((gray.shape[0], gray.shape[1] + 2), np.int8)
    edge[:, 1:-1] = gray < limit
    change = np.diff(edge, axis=1)
    (y, x0), (_, x1) = np.nonzero(change == 1), np.nonzero(change == -1)
    return y, x0, x1


def page_runs(pixels: bytes | np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """runs_of a raster. Lines that are, byte for byte, the one above them share its runs; only the others are looked into."""
    a = np.frombuffer(pixels, np.uint8)
    lines = a[: len(a) // (width * height) * width * height].reshape(height, -1)
    fresh = np.ones(height, bool)
    fresh[1:] = (lines[1:] != lines[:-1]).any(axis=1)
    at = np.flatnonzero(fresh)
    line, x0, x1 = runs_of(gray_of(lines[at], width, len(at)), np.diff(at, append=height))
    n = np.bincount(line, minlength=len(at))
    which = np.cumsum(fresh) - 1
    each = n[which]
    nth = np.arange(each.sum()) + np.repeat((np.cumsum(n) - n)[which] - (np.cumsum(each) - each), each)
    return np.repeat(np.arange(height), each), x0[nth], x1[nth]


def pages_to_ink_runs(pages: DataFrame) -> DataFrame:
    """(page_key, y, x0, x1) from (page_key, width, height, pixels). A page is looked at where it lies in its Arrow batch, one after the other; only runs leave. A page
    without a size or pixels, or with fewer pixels than its size asks for, has no runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [(np.zeros(0, np.int64),) * 3], np.zeros(batch.num_rows, np.int64)
            for i, (w, h, pixels) in enumerate(zip(batch["width"].to_pylist(), batch["height"].to_pylist(), batch["pixels"], strict=True)):
                if w is not None and h is not None and w > 0 and h > 0 and pixels.is_valid and len(seen := pixels.as_buffer()) >= int(w) * int(h):
                    found.append(page_runs(seen, int(w), int(h)))
                    n[i] = len(found[-1][0])
            runs = [pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_key"].take(pa.array(np.repeat(np.arange(len(n)), n))), *runs], ["page_key", "y", "x0", "x1"])

    kind = pages.schema["page_key"].dataType.simpleString()
    return pages.select("page_key", "width", "height", "pixels").mapInArrow(work, f"page_key {kind}, y int, x0 int, x1 int")
