"""A table by key that is kept as a log of segments: what a batch writes is in proportion to the batch, not to the table.

Each version (a micro-batch of a stream, or a call) appends one segment: the last row of each key that it has, or a tombstone for a key that it deletes.
Readers merge the live segments by key. When the segments that came after one hold more than SHARE of its bytes, all of them are merged into one,
which covers their versions; so a row is rewritten a number of times that grows with the logarithm of the table, and as many segments are live.

    <path>/s-<first version>-<last version>/part-*.parquet, _SUCCESS

A segment counts when its success file is there; of segments one of which covers the other's versions the wider counts. A version that is there already is
not written again, so a batch that a restarted stream repeats changes nothing. Merged segments stay until the version after their merge, for readers
that had planned on them. There is one writer at a time.

The last row of a key is the one with the highest `seq` columns, then the newest version; with no `seq` columns just the newest version. Tombstones go when
a merge reaches the oldest segment and the order is that of versions alone; with `seq` columns they stay, as an older row may still arrive. Rows without
a key are left out. Nothing is held in the driver but names and sizes of segments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions.shared import delete, file_system
from draftmill.operators.results import keep_last

#: Newer segments are merged with one before them when they hold this share of its bytes.
SHARE = 0.5
_VERSION, _GONE = "_version", "_gone"


@dataclass(frozen=True, order=True)
class Segment:
    first: int
    last: int
    size: int = 0

    @property
    def name(self) -> str:
        return f"s-{self.first:012d}-{self.last:012d}"

    def covers(self, other: Segment) -> bool:
        return self.first <= other.first and other.last <= self.last


class KeyedTable:
    """The table at `path`, by `key`."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", seq: tuple[str, ...] = (), share: float = SHARE):
        self.spark, self.path, self.key, self.seq, self.share = spark, path.rstrip("/"), key, tuple(seq), share

    def complete(self) -> list[Segment]:
        """All segments that were written to their end, also those that others cover."""
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at(self.path)):
            return []
        found = [m for s in fs.listStatus(at(self.path)) if (m := re.fullmatch(r"s-(\d+)-(\d+)", s.getPath().getName()))]
        return sorted(Segment(int(m[1]), int(m[2]), fs.getContentSummary(at(f"{self.path}/{m[0]}")).getLength()) for m in found if fs.exists(at(f"{self.path}/{m[0]}/_SUCCESS")))

    def live(self) -> list[Segment]:
        """The segments that readers merge, oldest first."""
        found = self.complete()
        return [s for s in found if not any(o != s and o.covers(s) for o in found)]

    def _scan(self, segments: list[Segment]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{s.name}" for s in segments])

    def _last(self, rows: DataFrame) -> DataFrame:
        return keep_last(rows, self.key, *self.seq, _VERSION)

    def read(self) -> DataFrame | None:
        """The table as it is now, without the keys that were deleted; none where nothing was ever written. Rows of the largest segment whose key no other
        segment has are passed on as they are, so they need no shuffle while the others are small enough to be broadcast."""
        live = self.live()
        if not live:
            return None
        base = max(live, key=lambda s: s.size)
        rest = [s for s in live if s != base]
        rows = self._scan([base])
        if rest:
            newer = self._scan(rest)
            keys = newer.select(self.key).distinct()
            rows = rows.join(keys, self.key, "left_anti").unionByName(self._last(newer.unionByName(rows.join(keys, self.key, "left_semi"))))
        return rows.filter(~F.col(_GONE)).drop(_VERSION, _GONE)

    def put(self, rows: DataFrame, version: int | None = None) -> int:
        """The last row of each key of `rows` becomes version `version` (the next, if none is given); gives the version."""
        return self._append(keep_last(rows, self.key, *self.seq) if self.seq else rows.dropDuplicates([self.key]), False, version)

    def delete(self, keys: DataFrame, version: int | None = None) -> int:
        """Keys (and `seq` columns, if the table has any) that go; keys that aren't there are no matter."""
        gone = keys.select(self.key, *self.seq)
        gone = keep_last(gone.withColumn("_", F.lit(0)), self.key, *self.seq).drop("_") if self.seq else gone.dropDuplicates()
        return self._append(gone, True, version)

    def _append(self, rows: DataFrame, gone: bool, version: int | None) -> int:
        found = self.complete()
        version = max([s.last for s in found], default=-1) + 1 if version is None else version
        own = Segment(version, version)
        if any(s.covers(own) for s in found):
            rows.write.format("noop").mode("overwrite").save()  # a stream that keeps state must work the batch out all the same
        else:
            rows = rows.filter(F.col(self.key).isNotNull()).withColumns({_VERSION: F.lit(version).cast("long"), _GONE: F.lit(gone)})
            live = [s for s in found if not any(o != s and o.covers(s) for o in found)]
            if live:
                kept = self._scan(live[:1]).schema
                if gone:
                    rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kept])
            elif gone:
                return version  # nothing to delete from
            rows.write.mode("overwrite").parquet(f"{self.path}/{own.name}")
        self._tidy(found)
        self._merge()
        return version

    def _tidy(self, before: list[Segment]) -> None:
        """Removes what was covered before this version already, and what a writer that died left unfinished."""
        fs, at = file_system(self.spark, self.path)
        own = {s.name for s in self.complete()}
        needed = own - {s.name for s in before if any(o != s and o.covers(s) for o in before)}
        for name in [s.getPath().getName() for s in fs.listStatus(at(self.path))]:
            if name.startswith("s-") and name not in needed:
                delete(self.spark, f"{self.path}/{name}")

    def _merge(self, everything: bool = False) -> None:
        live = self.live()
        at = len(live) - 1
        size = live[at].size if live else 0
        while at > 0 and (everything or size >= self.share * live[at - 1].size):
            at -= 1
            size += live[at].size
        if len(live) - max(at, 0) < 2:
            return
        part = live[at:]
        rows = self._last(self._scan(part))
        if at == 0 and not self.seq:
            rows = rows.filter(~F.col(_GONE))
        rows.write.mode("overwrite").parquet(f"{self.path}/{Segment(part[0].first, part[-1].last).name}")

    def compact(self) -> None:
        """All segments merged into one."""
        self._merge(everything=True)

    def clear(self) -> None:
        """Removes all that was written."""
        delete(self.spark, self.path)
