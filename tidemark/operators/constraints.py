"""What the store must satisfy, as queries that return the offenders."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAR = 1 << 62


class Live:
    """Accepted rows of a section that are on record, disjoint in validity, by when they leave."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, int]] = []
        self.ends: list[tuple[int, int, int]] = []

    def advance(self, t: int) -> None:
        """Forget what left by ``t``."""
        while self.ends and self.ends[0][0] <= t:
            gone = heapq.heappop(self.ends)[1:]
            self.ranges.pop(bisect_left(self.ranges, gone))

    def clashes(self, start: int, end: int) -> bool:
        at = bisect_left(self.ranges, (start, end))
        return any(r[0] < end and start < r[1] for r in self.ranges[max(0, at - 1) : at + 1])

    def add(self, start: int, end: int, until: int) -> None:
        insort(self.ranges, (start, end))
        heapq.heappush(self.ends, (until, start, end))


_INTS = {"valid_from": pa.int32(), "valid_to": pa.int32(), "recorded_at": pa.int64(), "recorded_until": pa.int64()}


def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, clocks as integers."""
    return zip(*((b.column(n).cast(_INTS[n]) if n in _INTS else b.column(n)).to_pylist() for n in b.schema.names), strict=True)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, live = None, Live()
    for b in batches:
        refused = []
        for section, version, start, end, t, until in rows_of(b):
            if section != key:
                key, live = section, Live()
            end, until = (_FAR if x is None else x for x in (end, until))
            live.advance(t)
            if start is None or start >= end or t >= until:
                continue  # an empty range overlaps nothing; the interval check reports it
            if live.clashes(start, end):
                refused.append((section, version))
            else:
                live.add(start, end, until)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in refused], pa.string()), pa.array([v for _, v in refused], pa.int32())], names=["section_key", "version_no"])


def overlaps(versions: DataFrame, hot: int | None = None) -> DataFrame:
    """``(section_key, version_no)`` that an exclusion constraint on both ranges would refuse.

    Rows come in order of recording; one that overlaps an accepted row of its section on both clocks
    is refused, an overlap on one clock is fine.  Accepted rows of a moment are disjoint, so a sorted
    list of them and a look at the neighbours decide: a sweep instead of a self-join of pairs.

    A section is swept by one task; with ``hot``, sections of more rows than that are swept in slabs
    of recorded time by many, see ``hotoverlap``, with the same rows.  Where that would make more
    slabs than the driver should hold, slabs are longer and fewer sections cut.
    """
    cols = versions.select(F.col("section_key").cast("string").alias("section_key"), F.col("version_no").cast("int").alias("version_no"), "valid_from", "valid_to", "recorded_at", "recorded_until")
    hot_rows, cold, large, size = None, cols, {}, hot
    if hot is not None:
        from tidemark.operators.hotfold import apart, large_sections
        from tidemark.operators.hotoverlap import overlaps_hot

        large, size = large_sections(cols, hot)
        if large:
            hot_rows, cold = apart(cols, large)
    ordered = cold.repartition("section_key").sortWithinPartitions("section_key", "recorded_at", "version_no")
    out = ordered.mapInArrow(_sweep, "section_key string, version_no int")
    return out.unionByName(overlaps_hot(hot_rows, large, size)) if large else out


def bad_intervals(versions: DataFrame) -> DataFrame:
    """Rows with an end that is not after its start."""
    return versions.where((F.col("valid_to") <= F.col("valid_from")) | (F.col("recorded_until") <= F.col("recorded_at")))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def outside(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose value is not one of the allowed."""
    return rows.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)).distinct(), column, "left_anti")


def counted(**found: DataFrame) -> DataFrame:
    """``(constraint_name, violations)``: one row a constraint, also where nothing offends."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations") for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exactly_one(n: Column, what: str) -> Column:
    """``n`` if it is 0 or 1, else an error."""
    return F.when(n > 1, F.raise_error(F.concat(F.lit(f"more than one {what}: "), n.cast("string"))).cast("long")).otherwise(n)
