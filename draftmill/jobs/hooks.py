"""User workers over rows, a bounded number at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHUNK = 256  # results that are held before they leave


def map_bounded(df: DataFrame, worker: Callable[[dict], dict], limit: int, schema: str) -> DataFrame:
    """worker(row) for every row, at most `limit` in flight in a partition (so limit x partitions in all), rows in their order. For workers that
    wait, such as calls of a service. Rows keep their types; a null is None."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, out = deque(), []
        with ThreadPoolExecutor(max(1, limit)) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    for row in batch.slice(at, CHUNK).to_pylist():
                        if len(waiting) >= max(1, limit):
                            out.append(waiting.popleft().result())
                        waiting.append(pool.submit(worker, row))
                    if len(out) >= CHUNK:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
            out += [w.result() for w in waiting]
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, schema)
