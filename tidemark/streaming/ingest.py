"""Versions kept up to date from a stream of clauses."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import constraints
from tidemark.operators.versions import LOG, _Section, rebuild_versions
from tidemark.plans.ingest import bucket, stored

CHANGES = "section_key string, version_no int, text string, valid_from date, valid_to date, recorded_at timestamp, recorded_until timestamp, document_id string, supersedes string, change string"


def _day(d: object) -> int | None:
    return None if d is None or d is pd.NaT else (pd.Timestamp(d) - pd.Timestamp(0)).days


def _rows(found: list, change: str) -> pd.DataFrame:
    names = [c.split()[0] for c in CHANGES.split(", ")]
    out = pd.DataFrame([(*r, change) for r in found], columns=names)
    for c in ("valid_from", "valid_to"):
        out[c] = [None if x is None or x != x else (pd.Timestamp(0) + pd.Timedelta(days=int(x))).date() for x in out[c]]
    for c in ("recorded_at", "recorded_until"):
        out[c] = pd.to_datetime(pd.Series([None if x is None or x != x else int(x) for x in out[c]], dtype="Int64"), unit="us")
    return out


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    section, last = pickle.loads(state.get[0]) if state.exists else (_Section(key[0]), None)
    new = pd.concat(list(batches)).sort_values(["recorded_at", "document_id", "clause_no"], kind="stable")
    closed, late, opened, since = [], [], [], last
    for r in new.itertuples(index=False):
        t = int(pd.Timestamp(r.recorded_at).value // 1000)
        row = (_day(r.valid_from), _day(r.valid_to))
        if since is not None and t <= since:
            late.append((key[0], None, r.text, *row, t, None, r.document_id, None))
            continue
        before = section.count
        section.apply(r.kind, t, r.document_id, r.text, *row, closed)
        opened += [(key[0], *x[:5], None, *x[5:]) for x in section.rows if x[0] > before]
        last = t if last is None else max(last, t)
    state.update((pickle.dumps((section, last)),))
    for found, change in ((opened, "open"), (closed, "close"), (late, "refused")):
        if found:
            yield _rows(found, change)


def version_changes(log: DataFrame) -> DataFrame:
    """Changes of versions from a stream of clauses (columns ``LOG``), keyed by section.

    The state of a section is its current timeline.  ``open`` rows are new versions, ``close`` rows
    the same ones with ``recorded_until``; for the present store take the last row of each version.
    A document recorded no later than one an earlier batch brought is ``refused``, not merged: valid
    time may run backwards, recorded time may not.
    """
    return log.select(*LOG).groupBy("section_key").applyInPandasWithState(_advance, CHANGES, "section binary", "append", GroupStateTimeout.NoTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """Versions from their changes: closed where a close was seen."""
    kept = changes.where("change <> 'refused'")
    return kept.groupBy("section_key", "version_no").agg(F.max_by(F.struct("text", "valid_from", "valid_to", "recorded_at", "recorded_until", "document_id", "supersedes"), F.col("change") == "close").alias("v")).select("section_key", "version_no", "v.*")


def rebuild_on_arrival(spark: SparkSession, stream: DataFrame, log_path: str, versions_path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Append each batch of clauses to the log and rebuild the versions of the sections it touches.

    A batch that is run again after a failure appends nothing twice: clauses are keyed by section,
    document and number.  Versions are written by bucket of sections, so untouched ones stay.  The
    rebuilt buckets are checked before anything is written: a batch that breaks a constraint fails
    the stream and leaves log and versions as they were.
    """
    key = ["section_key", "document_id", "clause_no"]

    def apply(batch: DataFrame, _: int) -> None:
        part = bucket(F.col("section_key"), parts).alias("part")
        new = batch.select(*LOG, part).dropDuplicates(key)
        touched = [r[0] for r in new.select("part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        before = stored(spark, log_path)
        if before is not None:
            before = before.where(F.col("part").isin(touched))
            new = new.join(before.select(*key), key, "left_anti").select(*LOG, "part")
        log = new if before is None else before.select(*LOG, "part").unionByName(new)
        rebuilt = rebuild_versions(log).withColumn("part", part).persist()
        try:
            found = constraints.counted(
                overlap=constraints.overlaps(rebuilt), interval=constraints.bad_intervals(rebuilt),
                version_no_unique=constraints.duplicates(rebuilt, "section_key", "version_no"), superseded_exists=constraints.orphans(rebuilt, "supersedes", rebuilt, "version_id"),
            )
            broken = [f"{r['constraint_name']} ({r['violations']})" for r in found.where("violations > 0").collect()]
            if broken:
                raise ValueError("the clauses would break: " + ", ".join(sorted(broken)))
            new.write.mode("append").partitionBy("part").parquet(log_path)
            rebuilt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(versions_path)
        finally:
            rebuilt.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
