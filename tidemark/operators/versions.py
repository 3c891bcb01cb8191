"""Version histories from an append-only log of clauses: the write rules as one sorted pass.

A section's log is folded in order of recording.  Its state is the current timeline, rows with
disjoint validity in order, so an amendment touches only the end of it and the whole pass is linear
in the log.  Spark shuffles by section once and sorts within partitions; a task streams its sections
through Arrow batches and holds one timeline at a time, never a whole section.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("base", "amendment", "correction")
LOG = ["section_key", "kind", "recorded_at", "document_id", "clause_no", "text", "valid_from", "valid_to"]


class _Section:
    """The current timeline of a section; closed versions go to ``out``.

    A row is ``[version_no, text, valid_from, valid_to, recorded_at, document_id, supersedes]``.
    """

    def __init__(self, key: str) -> None:
        self.key, self.rows, self.count, self.document = key, [], 0, None

    def number(self) -> object:
        self.count += 1
        return self.count

    def name(self, row: list) -> object:
        return f"{self.key}@v{row[0]}"

    def add(self, row: list) -> None:
        row[0] = self.number()
        at = len(self.rows)
        while at and self.rows[at - 1][2] > row[2]:
            at -= 1
        self.rows.insert(at, row)

    def apply(self, kind: str, t: int, document: str, text: str, start: int, end: int | None, out: list) -> None:
        if kind == "correction" and document != self.document:
            self.close(len(self.rows), t, out)
        self.document = document
        supersedes = None
        if kind == "amendment":
            end, at = None, len(self.rows)
            while at and (self.rows[at - 1][3] is None or self.rows[at - 1][3] > start):
                at -= 1
            closed = self.close(len(self.rows) - at, t, out)
            for r in closed:
                if r[2] <= start:
                    supersedes = self.name(r)
                if r[2] < start:  # what it still covers is recorded anew, with its own source
                    self.add([0, r[1], r[2], start, t, r[5], None])
        self.add([0, text, start, end, t, document, supersedes])

    def close(self, n: int, t: int | None, out: list) -> list:
        at = len(self.rows) - n
        closed, self.rows = self.rows[at:], self.rows[:at]
        out += [(self.key, *r[:5], t, *r[5:]) for r in closed]
        return closed


def _columns(out: list, stamp: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    cast = {3: pa.date32(), 4: pa.date32(), 5: stamp, 6: stamp}
    cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
    names = ["section_key", "version_no", "text", "valid_from", "valid_to", "recorded_at", "recorded_until", "document_id", "supersedes"]
    return pa.RecordBatch.from_arrays([c.cast(cast[k]) if k in cast else c for k, c in enumerate(cols)], names=names)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    section, stamp, out = None, None, []
    for b in batches:
        stamp = b.schema.field("recorded_at").type
        col = {name: b.column(name) for name in LOG}
        ints = {"recorded_at": pa.int64(), "valid_from": pa.int32(), "valid_to": pa.int32()}
        rows = zip(*((c.cast(ints[n]) if n in ints else c).to_pylist() for n, c in col.items()), strict=True)
        for key, kind, t, document, _, text, start, end in rows:
            if section is None or key != section.key:
                if section is not None:
                    section.close(len(section.rows), None, out)
                section = _Section(key)
            section.apply(kind, t, document, text, start, end, out)
        yield _columns(out, stamp)
        out = []
    if section is not None:
        section.close(len(section.rows), None, out)
        yield _columns(out, stamp)


def _given(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} is null in the log")).cast(kind)).alias(name)


def rebuild_versions(log: DataFrame, hot: int | None = None) -> DataFrame:
    """Clause versions with both clocks from a log of clauses (columns ``LOG``).

    * ``base`` clauses start a section; nothing is closed.
    * An ``amendment`` holds from ``valid_from`` on, open-ended.  Rows that end by then stay; every
      other current row is closed, and what it covers before ``valid_from`` is recorded anew.
    * A ``correction`` closes all current rows of its section and restates the timeline.

    Both ranges are half-open and null is open.  Closing sets ``recorded_until``; no row is deleted.
    Versions are numbered by section in the order they are recorded.  ``supersedes`` names the
    version an amendment replaces at its start.  Equal times of one section are taken in order of
    document_id.  A null section is a section of its own; a null ``valid_from`` or
    ``recorded_at`` is an error; an empty log gives no versions.

    A section is folded by one task; with ``hot``, sections of more clauses than that are cut into
    spans of time of about ``hot`` clauses and folded by many, see ``hotfold``, with the same rows.
    Where that would make more spans than the driver should hold, spans are longer and fewer sections cut.
    """
    stamp = log.schema["recorded_at"].dataType.simpleString()
    schema = f"section_key string, version_no int, text string, valid_from date, valid_to date, recorded_at {stamp}, recorded_until {stamp}, document_id string, supersedes string"
    typed = log.select(F.col("section_key").cast("string"), "kind", "recorded_at", F.col("document_id").cast("string"), F.col("clause_no").cast("int"), "text", _given("valid_from", "date"), "valid_to").withColumn("recorded_at", _given("recorded_at", stamp))
    hot_rows, cold, large, size = None, typed, {}, hot
    if hot is not None:
        from tidemark.operators.hotfold import apart, fold_hot, large_sections

        large, size = large_sections(typed, hot)
        if large:
            hot_rows, cold = apart(typed, large)
    ordered = cold.repartition("section_key").sortWithinPartitions("section_key", "recorded_at", "document_id", "clause_no")
    out = ordered.mapInArrow(_fold, schema)
    if large:
        out = out.unionByName(fold_hot(hot_rows, large, size))
    return out.withColumn("version_id", F.concat("section_key", F.lit("@v"), "version_no"))


def ingest_new(log: DataFrame, documents: DataFrame, content_hash: str = "content_hash") -> DataFrame:
    """Documents not yet in the log, once each: idempotence by content hash."""
    return documents.dropDuplicates([content_hash]).join(log.select(content_hash).distinct(), content_hash, "left_anti")
