"""The exclusion sweep of sections too large for one task.

Recorded time is cut into slabs; a row is judged in the slab it was recorded in, and copies of it
enter all later slabs it reaches into.  Whether a row was accepted, and so may refuse others, is
known only when the slabs before are: the first round takes all entering rows as accepted, the next
leaves out those it found refused, until a round finds nothing new.  The first slab is right after one
round, the second after two at the latest, and a round that changes nothing satisfies all slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.constraints import _FAR, Live, rows_of
from tidemark.operators.hotfold import cuts_between, micros, places

_ROW = ["section_key", "version_no", "valid_from", "valid_to", "recorded_at", "recorded_until"]
_REFUSED = "section_key string, version_no int, valid_from int, valid_to int, recorded_at long, recorded_until long, again int, first boolean"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Refused rows of each slab; rows with flag 0 enter it accepted."""
    key, live = None, Live()
    for b in batches:
        refused = []
        for section, slab, flag, copies, *row in rows_of(b):
            version, start, end, t, until = row
            if (section, slab) != key:
                key, live = (section, slab), Live()
            last, gone = (_FAR if x is None else x for x in (end, until))
            if start is None or start >= last or t >= gone:
                continue
            if flag == 0:
                live.add(start, last, gone)
                continue
            live.advance(t)
            clash = live.clashes(start, last)
            if not clash:
                live.add(start, last, gone)
            if clash or copies > 1:
                refused.append((section, version, start, end, t, until, copies - 1, clash))
        kinds = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in refused], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in _REFUSED.split(", ")])


def overlaps_hot(rows: DataFrame, counts: dict[str | None, int], size: int) -> DataFrame:
    """``(section_key, version_no)`` refused among ``rows``, sections of the sizes ``counts``, in slabs of about ``size`` rows.

    Equal rows are one row and a number: the second is refused in any case.  A task holds the rows
    that enter its slab; each round reads ``rows`` once, and the refused rows so far are kept by Spark.
    """
    stamp = rows.schema["recorded_at"].dataType.simpleString()
    days = {c: F.unix_date(c) for c in ("valid_from", "valid_to")}
    plain = rows.withColumns(days | {c: micros(c, stamp) for c in ("recorded_at", "recorded_until")})
    most = max(-(-n // size) for n in counts.values())
    cuts = cuts_between(plain, "recorded_at", counts, size)
    once = plain.groupBy(*_ROW).agg(F.count("*").cast("int").alias("copies"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's own slab and the last it reaches into."""
        for b in batches:
            until = b.column("recorded_until").fill_null(_FAR).to_numpy(zero_copy_only=False)
            # what leaves at a cut is gone in the next slab
            own, last = places(b.column("section_key"), cuts, b.column("recorded_at").to_numpy(zero_copy_only=False), until)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own), pa.array(last)], names=[*b.schema.names, "own", "last"])

    slabs = once.mapInArrow(placed, "section_key string, version_no int, valid_from int, valid_to int, recorded_at long, recorded_until long, copies int, own int, last int")
    reaching = slabs.where("last > own")
    judged = slabs.select("section_key", F.col("own").alias("slab"), F.lit(1).alias("flag"), "copies", *_ROW[1:])
    refused = None
    for _ in range(most + 1):
        known = reaching
        if refused is not None:
            gone = refused.where("first").select(*(F.col(c).alias(f"_{c}") for c in _ROW))
            known = reaching.join(gone, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ROW], "left_anti")
        entering = known.select("section_key", F.explode(F.sequence(F.col("own") + 1, "last")).alias("slab"), F.lit(0).alias("flag"), "copies", *_ROW[1:])
        ordered = judged.unionByName(entering).repartition("section_key", "slab").sortWithinPartitions("section_key", "slab", "flag", "recorded_at", "version_no", "valid_from", "valid_to")
        found = ordered.mapInArrow(_sweep, _REFUSED).persist()
        changed = found.count() if refused is None else found.exceptAll(refused).count() + refused.exceptAll(found).count()
        if refused is not None:
            refused.unpersist()
        refused = found
        if not changed:
            break
    times = F.sequence(F.lit(1), F.col("again") + F.col("first").cast("int"))
    return refused.select("section_key", "version_no", F.explode(times).alias("_")).drop("_")
