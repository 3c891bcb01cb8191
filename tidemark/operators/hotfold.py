"""The version fold of sections too large for one task.

What a span of a section's log does to the timeline before it needs only three facts: whether it
restates the section, the earliest day it amends (``cut``), and the rows it leaves behind.  Such
effects compose: of two spans in turn the cut is the smaller one, and the rows left are the first's
up to the second's cut and then the second's.  So

1. every span is folded by itself; its effect is one row, the rows it leaves are its survivors;
2. a survivor is closed in the first later span that restates or cuts below its end, found in a
   table of minima over the effects; the one row that straddles a cut lives on, shortened, and goes to
   the next span that cuts below that; these remnants, one a span at most, are followed on the driver;
3. every span is folded once more, starting from the rows that it closes.

No span sees the part of the timeline it leaves alone, so together they read the log twice and every
survivor once, however long the timeline is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.versions import LOG, _Section

_FAR, _NEVER, _LATER = 1 << 40, -(1 << 40), -(1 << 62)
_KEY = ("span", "place", "fresh")
#: Spans whose effects and cuts the driver and every task hold, about; beyond that spans are made longer.
SPANS = 10_000
_ROW = "section_key string, span int, place int, fresh int, text string, valid_from int, valid_to int, t long, document_id string"
_EVENT = f"{_ROW}, until long, old_span int, old_place int, old_fresh int"
_MERGED = f"{_EVENT}, nth int"


class _Span(_Section):
    """A section over one span: rows are known by where they were recorded instead of a number.

    The key of a row is its span, the place of its clause in it, and 1 for the clause's own row or 0
    for the remainder of a row that it cut.
    """

    def __init__(self, key: str | None, span: int, rows: list | None = None) -> None:
        super().__init__(key)
        self.span, self.place, self.rows = span, -1, rows or []

    def number(self) -> tuple:
        return self.span, self.place, 0

    def name(self, row: list) -> tuple:
        return row[0]

    def add(self, row: list) -> None:
        super().add(row)
        self.latest = row

    def apply(self, kind: str, t: int, document: str, text: str, start: int, end: int | None, out: list) -> None:
        self.place += 1
        super().apply(kind, t, document, text, start, end, out)
        self.latest[0] = self.span, self.place, 1  # the clause's own row comes last


@dataclass
class Effects:
    """What the spans of one section do, by span: ``cut`` is the earliest day amended, ``_NEVER`` where the section is restated."""

    cut: np.ndarray
    place: np.ndarray
    t: np.ndarray

    def __post_init__(self) -> None:
        self.minima = [self.cut]
        while 2 ** len(self.minima) <= len(self.cut):
            low, step = self.minima[-1], 2 ** (len(self.minima) - 1)
            self.minima.append(np.minimum(low[:-step], low[step:]))

    def closing(self, spans: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For rows of ``spans`` that end at ``ends``, the first later span that cuts below; the number of spans if none does."""
        at, n = spans + 1, len(self.cut)
        for k in range(len(self.minima) - 1, -1, -1):
            fits = at + 2**k <= n
            low = self.minima[k][np.where(fits, at, 0)]
            at = np.where(fits & (low >= ends), at + 2**k, at)
        return at


def _by_span(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list]]:
    """The rows of each span in turn, as lists of the columns after section and span."""
    own, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own != row[:2]:
                if own is not None:
                    yield *own, rows
                own, rows = row[:2], []
            rows.append(row[2:])
    if own is not None:
        yield *own, rows


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


_EFFECT = "section_key string, span int, cut long, place int, t long"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, span, clauses in _by_span(batches):
        cut, place, at = _FAR, -1, 0
        for k, (_, kind, t, _, _, _, start, _) in enumerate(clauses):
            if kind == "correction":
                cut = _NEVER
                break
            if kind == "amendment" and start < cut:
                cut, place, at = start, k, t
        yield _batch([(key, span, cut, place, at)], _EFFECT)


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, span, clauses in _by_span(batches):
        fold, closed = _Span(key, span), []
        for _, kind, t, document, _, text, start, end in clauses:
            fold.apply(kind, t, document, text, start, end, closed)
            closed.clear()
        yield _batch([(key, *r[0], r[1], r[2], r[3], r[4], r[5]) for r in fold.rows], _ROW)


def _straddling(effects: dict):
    """Survivors that live on, shortened, in the span that closes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _batch_rows(b)
            found = [(r[0], *r[1:4], int(j), r[5]) for r, j in zip(rows, _closing(rows, effects), strict=True) if j < len(effects[r[0]].cut) and r[5] < effects[r[0]].cut[j]]
            yield _batch(found, "section_key string, span int, place int, fresh int, closing int, valid_from int")

    return run


def _batch_rows(b: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in b.columns), strict=True))


def _closing(rows: list[tuple], effects: dict) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for key in {r[0] for r in rows}:
        own = [k for k, r in enumerate(rows) if r[0] == key]
        ends = np.array([_FAR + 1 if rows[k][6] is None else rows[k][6] for k in own], np.int64)
        spans = np.array([rows[k][1] for k in own], np.int64)
        # a span without an amendment has the cut _FAR, which closes nothing
        out[own] = effects[key].closing(spans, np.minimum(ends, _FAR))
    return out


def _remnants(straddling: list, effects: dict) -> dict[tuple, list[tuple]]:
    """For the key of a survivor, the shortened rows it becomes: ``(span, place, t, end, closing span)``."""
    out: dict[tuple, list[tuple]] = {}
    for key, span, place, fresh, j, start in straddling:
        e = effects[key]
        while j < len(e.cut) and start < e.cut[j]:
            end = int(e.cut[j])
            following = int(e.closing(np.array([j]), np.array([end]))[0])
            out.setdefault((key, span, place, fresh), []).append((int(j), int(e.place[j]), int(e.t[j]), end, following))
            j = following
    return out


def _entering(effects: dict, remnants: dict):
    """Rows as they enter the span that closes them: the span's number, then the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = _batch_rows(b), []
            for r, j in zip(rows, _closing(rows, effects), strict=True):
                n = len(effects[r[0]].cut)
                if j < n:
                    found.append((r[0], int(j), *r[1:]))
                for span, place, t, end, following in remnants.get(r[:4], ()):
                    if following < n:
                        found.append((r[0], following, span, place, 0, r[4], r[5], end, t, r[8]))
            yield _batch(found, "section_key string, into int, span int, place int, fresh int, text string, valid_from int, valid_to int, t long, document_id string")

    return run


def _folded(effects: dict):
    """Births and closings of a span, from the rows that enter it and its clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, span, rows in _by_span(batches):
            entering = sorted(([(r[8], r[9], r[10]), r[5], r[6], r[7], r[2], r[3], None] for r in rows if r[0] == 0), key=lambda r: r[2])
            fold, closed = _Span(key, span, entering), []
            for _, kind, t, document, _, text, start, end, *_ in (r for r in rows if r[0] == 1):
                fold.apply(kind, t, document, text, start, end, closed)
            e = effects[key]
            ends = np.array([_FAR if r[3] is None else r[3] for r in fold.rows], np.int64)
            later = e.closing(np.full(len(ends), span), ends)
            found = [(c[1], *c[2:6], c[6], c[7], c[8]) for c in closed]
            found += [(r[0], r[1], r[2], r[3], r[4], None, r[5], r[6]) for r in fold.rows]
            open_here = {r[0] for r, j in zip(fold.rows, later, strict=True) if j < len(e.cut)}
            out = []
            for where, text, start, end, t, until, document, old in found:
                until = _LATER if where in open_here else until  # closed by a later span, which says when
                out.append((key, *where, text, start, end, t, document, until, *(old or (None, None, None))))
            yield _batch(out, _EVENT)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once, numbered within its span: one closed by a later span is said twice, born and closed."""
    for key, span, rows in _by_span(batches):
        out: list[tuple] = []
        for r in rows:  # (place, fresh, text, from, to, t, document, until, old...)
            if out and out[-1][2:4] == r[:2]:
                same = out.pop()
                born, closed = (same, r[7]) if same[9] == _LATER else ((key, span, *r), same[9])
                out.append((*born[:9], closed, *born[10:13], len(out)))
            else:
                out.append((key, span, *r, len(out)))
        yield _batch(out, _MERGED)


def micros(column: str, stamp: str) -> F.Column:
    """A timestamp of either kind as microseconds."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', {column})") if stamp == "timestamp_ntz" else F.unix_micros(column)


def places(keys: pa.Array, cuts: dict, *values: np.ndarray) -> list[np.ndarray]:
    """For each array of values, how many of its key's cuts lie below: the span, or slab, a row belongs to."""
    coded = keys.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    code = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    out = [np.zeros(len(code), np.int32) for _ in values]
    for low, high in zip(starts, [*starts[1:], len(order)], strict=True):
        own = order[low:high]
        cut = np.array(cuts.get(names[code[own[0]]], []), np.int64)
        for v, o in zip(values, out, strict=True):
            o[own] = np.searchsorted(cut, v[own], "left")
    return out


def large_sections(rows: DataFrame, hot: int, most: int | None = None) -> tuple[dict[str | None, int], int]:
    """The sections of ``rows`` too large for one task, with their sizes, and how many rows a span of them takes.

    That is ``hot``, unless the sections above it had more than ``most`` spans (``SPANS``); then it is
    as much as makes ``most`` spans of all their rows, and smaller sections are left whole.  So what
    is held for the sections and for their spans is bounded by ``most`` (twice it at worst, as each
    section ends a span), however many sections the table has.
    """
    most = SPANS if most is None else most
    counts = rows.groupBy("section_key").count().where(F.col("count") > hot).persist()
    try:
        total, spans, largest = counts.agg(F.sum("count"), F.sum(F.ceil(F.col("count") / hot)), F.max("count")).first()
        size = hot if spans is None or spans <= most else max(hot, -(-total // most))
        if largest is None or largest <= size:
            return {}, size
        return {r["section_key"]: r["count"] for r in counts.where(F.col("count") > size).collect()}, size
    finally:
        counts.unpersist()


def apart(rows: DataFrame, sections: dict[str | None, int]) -> tuple[DataFrame, DataFrame]:
    """The rows of the sections named, and all others."""
    keys = rows.sparkSession.createDataFrame([(k,) for k in sections], "_large string").coalesce(1)
    on = F.col("section_key").eqNullSafe(F.col("_large"))
    return rows.join(F.broadcast(keys), on, "left_semi"), rows.join(F.broadcast(keys), on, "left_anti")


def cuts_between(rows: DataFrame, moment: str, sections: dict[str | None, int], size: int) -> dict[str | None, list[int]]:
    """Where the moments of each section are cut into spans of about ``size`` rows; a section gets as many as its size asks for."""
    most = max(-(-n // size) for n in sections.values())
    if most < 2:
        return {}
    shares = F.array(*[F.lit(k / most) for k in range(1, most)])
    found = rows.groupBy("section_key").agg(F.percentile_approx(moment, shares, 100 * most).alias("cuts"), F.ceil(F.count("*") / size).alias("spans"))
    own = F.transform(F.sequence(F.lit(1).cast("long"), F.col("spans") - 1), lambda k: F.get("cuts", (F.floor(k * most / F.col("spans")) - 1).cast("int")))
    return {r["section_key"]: r["own"] for r in found.where("spans > 1").select("section_key", F.array_sort(F.array_distinct(own)).alias("own")).collect()}


def fold_hot(log: DataFrame, counts: dict[str | None, int], clauses: int) -> DataFrame:
    """Versions, without version_id, of the sections of ``log``, whose sizes are ``counts``, in spans of about ``clauses`` clauses.

    Spans end where recorded time does, so a document is never cut; clauses of one moment stay
    together.  Rows of a section must be disjoint at every moment, as the exclusion constraint demands.
    """
    stamp = log.schema["recorded_at"].dataType.simpleString()
    timed = log.withColumn("t", micros("recorded_at", stamp))
    bounds = cuts_between(timed, "t", counts, clauses)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (span,) = places(b.column("section_key"), bounds, b.column("t").to_numpy(zero_copy_only=False))
            columns = {n: b.column(n) for n in LOG if n != "recorded_at"}
            days = {n: columns[n].cast(pa.int32()) for n in ("valid_from", "valid_to")}
            columns |= days | {"span": pa.array(span), "flag": pa.array(np.ones(b.num_rows, np.int32)), "recorded_at": b.column("t")}
            order = ["section_key", "span", "flag", *LOG[1:]]
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)

    columns = "section_key string, span int, flag int, kind string, recorded_at long, document_id string, clause_no int, text string, valid_from int, valid_to int"
    spans = timed.mapInArrow(placed, columns)
    ordered = spans.repartition("section_key", "span").sortWithinPartitions("section_key", "span", "recorded_at", "document_id", "clause_no")
    seen: dict = {}
    for r in sorted(ordered.mapInArrow(_effects, _EFFECT).collect(), key=lambda r: r["span"]):  # one row a span
        seen.setdefault(r["section_key"], []).append(r)
    effects = {}
    for key, rows in seen.items():
        n = rows[-1]["span"] + 1
        cut, place, t = np.full(n, _FAR, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r in rows:
            cut[r["span"]], place[r["span"]], t[r["span"]] = r["cut"], r["place"], r["t"]
        effects[key] = Effects(cut, place, t)
    survivors = ordered.mapInArrow(_survivors, _ROW)
    straddling = survivors.mapInArrow(_straddling(effects), "section_key string, span int, place int, fresh int, closing int, valid_from int").collect()  # one a span at most
    remnants = _remnants([tuple(r) for r in straddling], effects)
    entering = survivors.mapInArrow(_entering(effects, remnants), "section_key string, into int, span int, place int, fresh int, text string, valid_from int, valid_to int, t long, document_id string")
    as_rows = entering.select(
        "section_key", F.col("into").alias("span"), F.lit(0).alias("flag"), F.lit("entering").alias("kind"), F.col("t").alias("recorded_at"), "document_id", F.lit(-1).alias("clause_no"), "text", "valid_from", "valid_to",
        F.col("span").alias("born_span"), F.col("place").alias("born_place"), F.col("fresh").alias("born_fresh"),
    )
    none = {c: F.lit(None).cast("int") for c in ("born_span", "born_place", "born_fresh")}
    second = spans.withColumns(none).unionByName(as_rows).repartition("section_key", "span").sortWithinPartitions("section_key", "span", "flag", "recorded_at", "document_id", "clause_no")
    events = second.mapInArrow(_folded(effects), _EVENT)
    # the last step takes all columns, so that the exchange below it is one for all who read these rows
    rows = events.repartition("section_key", "span").sortWithinPartitions("section_key", *_KEY).mapInArrow(_merged, _MERGED)
    before = Window.partitionBy("section_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("section_key", "span").agg(F.count("*").alias("n")).select(F.col("section_key").alias("_section"), F.col("span").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = rows.join(offset, [F.col("section_key").eqNullSafe(F.col("_section")), F.col("span") == F.col("_of")]).withColumn("version_no", (F.col("offset") + F.col("nth") + 1).cast("int")).drop("_section", "_of", "offset")
    older = numbered.select(F.col("section_key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in _KEY), F.col("version_no").alias("old_no"))
    on = [numbered["section_key"].eqNullSafe(F.col("_key")), *(F.col(f"old_{c}") == F.col(f"_{c}") for c in _KEY)]
    moment = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ '1970-01-01')") if stamp == "timestamp_ntz" else F.timestamp_micros(c)
    day = lambda c: F.date_from_unix_date(c)
    return numbered.join(older, on, "left").select(
        "section_key", "version_no", "text", day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"), moment("t").alias("recorded_at"),
        F.when(F.col("until") > _LATER, moment("until")).alias("recorded_until"), "document_id",
        F.when(F.col("old_no").isNotNull(), F.concat(F.coalesce("section_key", F.lit("None")), F.lit("@v"), "old_no")).alias("supersedes"),
    )
