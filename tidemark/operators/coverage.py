"""What a store says at many instants: a sweep over recorded time with a Fenwick tree over days.

A version is in force at an instant if it lies in a rectangle, recorded time by validity.  The sweep
goes through recorded time; the tree holds how many live versions begin or end at each day, so the
number in force on a day is a prefix sum.  Only the places of the instants matter: a beginning or
end moves on to the next moment, and the next day, that some instant asks for, and is added up there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Moments of a time range of the sweep, and cells a task holds before it passes them on.
_RANGE, _HELD = 2_000, 1_000_000
_EVENT = "span int, slot int, kind int, day int, delta long"


class Fenwick:
    """Prefix sums under point updates, both in logarithmic time."""

    def __init__(self, n: int) -> None:
        self.sums = [0] * (n + 1)

    def add(self, at: int, delta: int) -> None:
        at += 1
        while at < len(self.sums):
            self.sums[at] += delta
            at += at & -at

    def upto(self, at: int) -> int:
        at, total = at + 1, 0
        while at:
            total += self.sums[at]
            at &= at - 1
        return total


def _micros(c: pa.Array) -> np.ndarray:
    """Days or microseconds as integers; null is beyond all."""
    kind = pa.int32() if pa.types.is_date(c.type) else pa.int64()
    return c.cast(kind).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _summed(keys: np.ndarray, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=deltas, minlength=len(found)).astype(np.int64)


def _cells(marks: Broadcast):
    """``slot, day, delta``: what versions change at each moment and day asked for; day -1 counts live versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, days = marks.value
        width = len(days) + 1

        def rows(keys: np.ndarray, deltas: np.ndarray) -> pa.RecordBatch:
            keys, deltas = keys[deltas != 0], deltas[deltas != 0]
            columns = [pa.array((keys // width).astype(np.int32)), pa.array((keys % width - 1).astype(np.int32)), pa.array(deltas)]
            return pa.RecordBatch.from_arrays(columns, names=["slot", "day", "delta"])

        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            start, end, opened, closed = (_micros(b.column(c)) for c in ("valid_from", "valid_to", "recorded_at", "recorded_until"))
            known = opened < closed
            keys, deltas = [held[0]], [held[1]]
            for at, sign in ((opened, 1), (closed, -1)):
                slot = np.searchsorted(moments, at)
                on = known & (slot < len(moments))
                keys.append(slot[on] * width)
                deltas.append(np.full(int(on.sum()), sign))
                for day, turn in ((start, 1), (end, -1)):
                    place = np.searchsorted(days, day)
                    ok = on & (start < end) & (place < len(days))
                    keys.append(slot[ok] * width + place[ok] + 1)
                    deltas.append(np.full(int(ok.sum()), sign * turn))
            held = _summed(np.concatenate(keys), np.concatenate(deltas))
            if len(held[0]) > _HELD:
                yield rows(*held)
                held = np.empty(0, np.int64), np.empty(0, np.int64)
        yield rows(*held)

    return run


def _asked(marks: Broadcast, spans: int):
    """Instants as events of the sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, days = marks.value
        for b in batches:
            slot = np.searchsorted(moments, _micros(b.column("known_at")))
            day = np.searchsorted(days, _micros(b.column("valid_at")))
            columns = [pa.array((slot * spans // len(moments)).astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(np.ones(len(slot), np.int32)), pa.array(day.astype(np.int32)), pa.array(np.zeros(len(slot), np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, b.column("valid_at"), b.column("known_at")], names=["span", "slot", "kind", "day", "delta", "valid_at", "known_at"])

    return run


def _sweep(days: int):
    """``valid_at, known_at, live, force`` of the instants, from events in order of span, moment and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, live, tree = None, 0, Fenwick(0)
        for b in batches:
            at, live_at, force_at = [], [], []
            columns = (b.column(c).to_pylist() for c in ("span", "kind", "day", "delta"))
            for k, (own, kind, day, delta) in enumerate(zip(*columns, strict=True)):
                if own != span:
                    span, live, tree = own, 0, Fenwick(days)
                if kind == 1:
                    at.append(k)
                    live_at.append(live > 0)
                    force_at.append(tree.upto(day) > 0)
                elif day < 0:
                    live += delta
                else:
                    tree.add(day, delta)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("valid_at").take(place), b.column("known_at").take(place), pa.array(live_at, pa.bool_()), pa.array(force_at, pa.bool_())], names=["valid_at", "known_at", "live", "force"])

    return run


def covered(rows: DataFrame, instants: DataFrame, block: int = 4_000_000) -> DataFrame:
    """``valid_at, known_at, live, force`` for each distinct pair of ``instants(valid_at, known_at)``.

    ``live``: some version of ``rows`` was on record at ``known_at``; ``force``: one of them held on
    ``valid_at``.  The distinct moments and days asked for are broadcast, ``block`` instants at a
    time, 48 MB at most; beyond that the rows are scanned once a block.  A scan adds up the versions
    by moment and day; ranges of moments are then swept side by side, each from the sums of all
    ranges before it.  No pair of an instant and a version is ever formed.

    Null instants get no row.  Versions without ``valid_from`` hold on no day, without
    ``recorded_at`` were never on record; empty ranges hold nothing; no versions give false.
    """
    spark = rows.sparkSession
    once = instants.where("valid_at is not null and known_at is not null").select("valid_at", "known_at").distinct()
    whole = once.limit(block + 1).toArrow()
    parts = [(once, whole)]
    if len(whole) > block:
        n = -(-2 * once.count() // block)  # half full on average: hashing is uneven
        split = [once.where(F.pmod(F.xxhash64("valid_at", "known_at"), F.lit(n)) == k) for k in range(n)]
        parts = [(part, part.toArrow()) for part in split]
    stamp = once.schema["known_at"].dataType.simpleString()
    out = spark.createDataFrame([], f"valid_at date, known_at {stamp}, live boolean, force boolean")
    for part, table in parts:
        if len(table):
            swept = _covered(rows, part, table, stamp)
            out = swept if len(parts) == 1 else out.unionByName(swept)
    return out


def _covered(rows: DataFrame, once: DataFrame, table: pa.Table, stamp: str) -> DataFrame:
    moments, days = (np.unique(_micros(table[c].combine_chunks())) for c in ("known_at", "valid_at"))
    marks = rows.sparkSession.sparkContext.broadcast((moments, days))
    spans = -(-len(moments) // _RANGE)
    changed = rows.select("valid_from", "valid_to", "recorded_at", "recorded_until").mapInArrow(_cells(marks), "slot int, day int, delta long")
    summed = changed.groupBy("slot", "day").agg(F.sum("delta").alias("delta")).where("delta <> 0")
    cells = summed.select(F.expr(f"int(slot * {spans}L div {len(moments)})").alias("span"), "slot", F.lit(0).alias("kind"), "day", "delta")
    events = cells
    if spans > 1:  # what each range starts from: the sums of the ranges before it, by day
        order = Window.partitionBy("day").orderBy("span")
        net = cells.groupBy("span", "day").agg(F.sum("delta").alias("delta"))
        until = net.select("span", "day", F.sum("delta").over(order).alias("delta"), F.coalesce(F.lead("span").over(order), F.lit(spans - 1)).alias("until"))
        carried = until.where("delta <> 0 and span < until").select(F.explode(F.sequence(F.col("span") + 1, "until")).alias("span"), F.lit(-1).alias("slot"), F.lit(0).alias("kind"), "day", "delta")
        events = cells.unionByName(carried)
    dated = events.withColumns({"valid_at": F.lit(None).cast("date"), "known_at": F.lit(None).cast(stamp)})
    asked = once.mapInArrow(_asked(marks, spans), f"{_EVENT}, valid_at date, known_at {stamp}")
    ordered = dated.unionByName(asked).repartition("span").sortWithinPartitions("span", "slot", "kind")
    return ordered.mapInArrow(_sweep(len(days)), f"valid_at date, known_at {stamp}, live boolean, force boolean")
