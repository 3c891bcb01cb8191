"""As-of joins for keys too large for one task: a sweep over recorded time in slabs of days.

Facts of a key are dealt to slabs by their day, and by hash where one day has too many; a version
goes to every slab that its validity reaches into, which carries the state across the edges.  In a slab
versions and facts come in order of their moment, and a sorted list of the ranges on record answers
each fact by bisection.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.hotfold import micros, places

_FAR = 1 << 62


class _OnRecord:
    """Versions on record, by validity; each with what it stands for."""

    def __init__(self) -> None:
        self.ranges: list[tuple[int, int, int]] = []
        self.ends: list[tuple[int, tuple]] = []
        self.rows: dict[int, dict] = {}

    def advance(self, t: int) -> None:
        while self.ends and self.ends[0][0] <= t:
            gone = heapq.heappop(self.ends)[1]
            self.ranges.pop(bisect_left(self.ranges, gone))
            del self.rows[gone[2]]

    def add(self, start: int, end: int, until: int, nth: int, row: dict) -> None:
        insort(self.ranges, (start, end, nth))
        heapq.heappush(self.ends, (until, (start, end, nth)))
        self.rows[nth] = row

    def at(self, day: int) -> dict | None:
        k = bisect_right(self.ranges, (day, _FAR, _FAR)) - 1
        return self.rows[self.ranges[k][2]] if k >= 0 and self.ranges[k][1] > day else None


def _sweep(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, live, nth = None, _OnRecord(), 0
        for b in batches:
            at, found = [], []
            columns = [b.column(c).to_pylist() for c in ("_key", "_slab", "_salt", "_kind", "_t", "_start", "_end", "_until", "_version")]
            for k, (key, slab, salt, kind, t, start, end, until, row) in enumerate(zip(*columns, strict=True)):
                if own != (key, slab, salt):
                    own, live = (key, slab, salt), _OnRecord()
                if kind == 0:
                    nth += 1
                    live.add(start, _FAR if end is None else end, _FAR if until is None else until, nth, row)
                    continue
                live.advance(t)
                row = live.at(start)
                if row is not None:
                    at.append(k)
                    found.append(row)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_fact").take(place), pa.array(found, schema.field("_version").type)], names=["_fact", "_version"])

    return run


def join_hot(facts: DataFrame, versions: DataFrame, key: str, day: str, known: str, counts: dict, size: int) -> DataFrame:
    """Each fact with the version that holds on its day as known at its moment, for keys with the numbers of facts ``counts``.

    Versions of a key must be disjoint at every moment, as the exclusion constraint demands.  A task
    holds the versions on record of one slab, whatever the number of facts.
    """
    stamp = versions.schema["recorded_at"].dataType.simpleString()
    whole = lambda c: micros(c, stamp) if stamp.startswith("timestamp") else F.col(c).cast("long")
    dated = facts.schema[day].dataType.simpleString() == "date"
    days = (lambda c: F.unix_date(c).cast("long")) if dated else (lambda c: F.col(c).cast("long"))
    f = facts.where(F.col(day).isNotNull() & F.col(known).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(1).alias("_kind"), whole(known).alias("_t") if facts.schema[known].dataType == versions.schema["recorded_at"].dataType else F.col(known).cast("long").alias("_t"),
        days(day).alias("_start"), F.struct(*facts.columns).alias("_fact"),
    )
    kept = [c for c in versions.columns if c not in facts.columns]
    v = versions.where("valid_from is not null and recorded_at is not null and (valid_to is null or valid_to > valid_from) and (recorded_until is null or recorded_until > recorded_at)").select(
        F.col(key).alias("_key"), F.lit(0).alias("_kind"), whole("recorded_at").alias("_t"), days("valid_from").alias("_start"), days("valid_to").alias("_end"), whole("recorded_until").alias("_until"), F.struct(*kept).alias("_version")
    )
    most = max(-(-n // size) for n in counts.values())
    shares = F.array(*[F.lit(k / most) for k in range(1, most)]) if most > 1 else F.array().cast("array<double>")
    cuts = {r["_key"]: sorted(set(r["cuts"] or [])) for r in f.groupBy("_key").agg(F.percentile_approx("_start", shares, 100 * most).alias("cuts")).collect()}

    def slabs(lower: str, upper: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                low = b.column(lower).to_numpy(zero_copy_only=False)
                high = low if upper is None else b.column(upper).fill_null(_FAR).to_numpy(zero_copy_only=False) - 1
                first, last = places(b.column("_key"), cuts, low, high)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first), pa.array(last)], names=[*b.schema.names, "_slab", "_last"])

        return run

    typed = lambda df: ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in df.schema)
    dealt = f.mapInArrow(slabs("_start", None), typed(f) + ", _slab int, _last int")
    full = dealt.groupBy("_key", "_slab").count().where(F.col("count") > 2 * size)
    salts = {(r["_key"], r["_slab"]): -(-r["count"] // size) for r in full.collect()}  # days that alone have too many facts
    many = F.lit(1)
    for (k, s), n in salts.items():
        many = F.when((F.col("_key") == k) & (F.col("_slab") == s), n).otherwise(many)
    spread = dealt.withColumn("_salt", F.pmod(F.xxhash64("_fact"), many).cast("int"))
    reached = v.mapInArrow(slabs("_start", "_end"), typed(v) + ", _slab int, _last int").withColumn("_slab", F.explode(F.sequence("_slab", "_last")))
    copied = reached.withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1)))
    both = copied.drop("_last").unionByName(spread.drop("_last"), allowMissingColumns=True)
    ordered = both.repartition("_key", "_slab", "_salt").sortWithinPartitions("_key", "_slab", "_salt", "_t", "_kind")
    schema = ordered.select("_fact", "_version").schema
    found = ordered.mapInArrow(_sweep(to_arrow_schema(schema)), typed(ordered.select("_fact", "_version")))
    return found.select("_fact.*", "_version.*")
