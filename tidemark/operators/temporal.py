"""Reads of bitemporal rows: filters on the two clocks, and the three outcomes of a read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.clock import AsOf
from tidemark.operators.coverage import covered

IN_FORCE, NO_RULE, NO_RECORD = "in-force", "no-rule-in-force", "no-record"


def holds(lower: Column, upper: Column, at: Column) -> Column:
    """Half-open range that holds ``at``; a null upper end is open."""
    return (lower <= at) & (upper.isNull() | (upper > at))


def _day(at: AsOf) -> Column:
    return F.lit(at.valid_at)


def moment(at: AsOf, like: DataFrame, column: str = "recorded_at") -> Column:
    """``known_at`` as a literal of the column's own timestamp type, so that the filter is pushed down."""
    kind = like.schema[column].dataType.simpleString()
    return F.expr(f"TIMESTAMP_NTZ '{at.known_utc}'" if kind == "timestamp_ntz" else f"TIMESTAMP '{at.known_utc}+00:00'")


def believed(rows: DataFrame, at: AsOf) -> DataFrame:
    """Rows on record at ``known_at``, whatever day they hold for."""
    return rows.where(holds(F.col("recorded_at"), F.col("recorded_until"), moment(at, rows)))


def as_of(rows: DataFrame, at: AsOf) -> DataFrame:
    """Rows on record at ``known_at`` that hold on ``valid_at``."""
    return believed(rows, at).where(holds(F.col("valid_from"), F.col("valid_to"), _day(at)))


def one_clock(rows: DataFrame, at: AsOf) -> DataFrame:
    """Rows that hold on ``valid_at`` as believed now: what one clock can say."""
    return current_belief(rows).where(holds(F.col("valid_from"), F.col("valid_to"), _day(at)))


def current_belief(rows: DataFrame) -> DataFrame:
    """Rows never closed."""
    return rows.where(F.col("recorded_until").isNull())


def sections(rows: DataFrame) -> DataFrame:
    return rows.select("section_key").distinct()


def history(rows: DataFrame, section: str | None = None) -> DataFrame:
    """Versions in order of recording and validity."""
    rows = rows if section is None else rows.where(F.col("section_key") == section)
    return rows.orderBy("section_key", "recorded_at", "valid_from", "version_no")


def read_sections(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """One row a request ``(request_id, section_key, valid_at, known_at)``: outcome and version read.

    ``in-force`` with the version; ``no-rule-in-force`` if the section was on record but no version
    of it held that day; else ``no-record``.  Two versions in force are an error in the store.
    """
    asked = requests.alias("q")
    on_record = (F.col("q.section_key") == F.col("v.section_key")) & holds(F.col("v.recorded_at"), F.col("v.recorded_until"), F.col("q.known_at"))
    force = holds(F.col("v.valid_from"), F.col("v.valid_to"), F.col("q.valid_at"))
    found = F.struct("v.version_no", "v.text", "v.document_id")
    return (
        asked.join(versions.alias("v"), on_record, "left")
        .groupBy("q.request_id", "q.section_key", "q.valid_at", "q.known_at")
        .agg(F.count("v.version_no").alias("known"), F.count_if(force).alias("n"), F.max(F.when(force, found)).alias("read"))
        .select(
            "request_id", "section_key", "valid_at", "known_at",
            F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two versions in force: "), "section_key"))).when(F.col("n") == 1, IN_FORCE).when(F.col("known") > 0, NO_RULE).otherwise(NO_RECORD).alias("outcome"),
            F.col("read.version_no").alias("version_no"), F.col("read.text").alias("text"), F.col("read.document_id").alias("document_id"),
        )
    )


def coverage(rows: DataFrame, instants: Sequence[AsOf]) -> DataFrame:
    """``(valid_at, known_at, outcome)`` of the whole store for each instant of a list."""
    stamp = rows.schema["recorded_at"].dataType.simpleString()
    schema = "valid_at date, known_at string"
    asked = rows.sparkSession.createDataFrame([(at.valid_at, at.known_utc) for at in instants], schema)
    text = F.col("known_at") if stamp == "timestamp_ntz" else F.concat("known_at", F.lit("+00:00"))
    return coverage_of(rows, asked.select("valid_at", text.cast(stamp).alias("known_at")))


def coverage_of(rows: DataFrame, instants: DataFrame) -> DataFrame:
    """``(valid_at, known_at, outcome)`` for each distinct pair of ``instants(valid_at, known_at)``, by the sweep of ``covered``."""
    outcome = F.when(F.col("force"), IN_FORCE).when(F.col("live"), NO_RULE).otherwise(NO_RECORD)
    return covered(rows, instants).select("valid_at", "known_at", outcome.alias("outcome"))


def retroactive_changes(rows: DataFrame, valid_at: AsOf, before: AsOf) -> DataFrame:
    """Section texts for a day that are read otherwise at the first instant than at the second."""
    read = lambda at: as_of(rows, at).select("section_key", "text", "valid_from")
    return read(valid_at).exceptAll(read(before))


def as_of_join(facts: DataFrame, versions: DataFrame, key: str, day: str, known: str, hot: int | None = None) -> DataFrame:
    """Facts with the version of their key that held on their day as known at their moment: an interval join on the key.

    With ``hot``, keys of more facts than that are not joined but swept in slabs by many tasks, see
    ``hotasof``, with the same rows as long as versions of a key never overlap on both clocks.
    """
    large = {}
    if hot is not None:
        from tidemark.operators.hotasof import join_hot

        counts = facts.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot)
        large = {r[key]: r["count"] for r in counts.collect()}  # at most one in ``hot`` facts
    apart = F.coalesce(F.col(key).isin(list(large)), F.lit(False))
    f, v = ((facts.where(~apart), versions.where(~apart)) if large else (facts, versions))
    f, v = f.alias("f"), v.alias("v")
    on = (F.col(f"f.{key}") == F.col(f"v.{key}")) & holds(F.col("v.valid_from"), F.col("v.valid_to"), F.col(f"f.{day}")) & holds(F.col("v.recorded_at"), F.col("v.recorded_until"), F.col(f"f.{known}"))
    out = f.join(v, on).select("f.*", *(F.col(f"v.{c}").alias(c) for c in versions.columns if c not in facts.columns))
    return out.unionByName(join_hot(facts.where(apart), versions.where(apart), key, day, known, large, hot)) if large else out
