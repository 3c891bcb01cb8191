"""Versions from a stream of clauses equal those of one rebuild."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.operators.versions import rebuild_versions
from tidemark.sources.derived import event_log
from tidemark.streaming.ingest import latest, rebuild_on_arrival, version_changes

COLS = ["section_key", "version_no", "text", "valid_from", "valid_to", "recorded_at", "recorded_until", "document_id", "supersedes"]


def log_files(spark, path):
    """The log in four files by time, as a source that arrives in order."""
    log = event_log(spark, DATA).withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).where("section_key < '4'")
    for k, (lo, hi) in enumerate((("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-22"), ("2024-01-22", "2024-02-22"))):
        log.where(f"recorded_at >= '{lo}' and recorded_at < '{hi}'").coalesce(1).write.mode("append").parquet(path)
    return log


def rows(df):
    return sorted(str(tuple(r)) for r in df.select(*COLS).collect())


def test_foreach_batch_rebuild(spark, tmp_path):
    log = log_files(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        rebuild_on_arrival(spark, stream, f"{tmp_path}/log", f"{tmp_path}/versions", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/versions")) == rows(rebuild_versions(log))


def test_batch_that_breaks_a_constraint_stops_the_stream(spark, tmp_path):
    log = log_files(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda: rebuild_on_arrival(spark, stream, f"{tmp_path}/log", f"{tmp_path}/versions", f"{tmp_path}/cp").awaitTermination()
    run()
    had = rows(spark.read.parquet(f"{tmp_path}/versions")), spark.read.parquet(f"{tmp_path}/log").count()
    again = log.where("kind = 'base'").limit(1).withColumns({"document_id": F.lit("twice"), "recorded_at": F.lit("2024-03-01").cast("timestamp"), "valid_from": F.lit("2001-01-01").cast("date")})
    again.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="would break: overlap"):
        run()
    assert (rows(spark.read.parquet(f"{tmp_path}/versions")), spark.read.parquet(f"{tmp_path}/log").count()) == had


def test_stateful_changes(spark, tmp_path):
    log = log_files(spark, f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = version_changes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination()
    changes = spark.read.parquet(f"{tmp_path}/out")
    assert changes.where("change = 'refused'").count() == 0
    assert rows(latest(changes)) == rows(rebuild_versions(log))
    late = log.limit(3)
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    version_changes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("change = 'refused'").count() == 3
