"""Bitemporal relations derived from the star-schema test tables, the same in Spark and in SQL.

The strides, spans and shares of the clocks are fixed values that the SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a document on one section, its user: base first, signups correct, the rest amend."""
    e = table(spark, sf_dir, "events")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) == 1
    kind = F.when(first, "base").when(F.col("event_type") == "signup", "correction").otherwise("amendment")
    start = F.date_add(F.col("ts").cast("date"), (F.col("event_id") * 7 % 21 - 10).cast("int"))
    text = F.concat_ws(":", "event_type", "event_id")
    return e.select(F.col("user_id").cast("string").alias("section_key"), F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("document_id"), kind.alias("kind"), F.col("ts").alias("recorded_at"), start.alias("start"), text.alias("text"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause log of the events: a correction restates two spans, the second closed for every third."""
    d = event_documents(spark, sf_dir)
    correction = F.col("kind") == "correction"
    clause = lambda no, text, start, end: F.struct(F.lit(no).alias("clause_no"), text.alias("text"), start.alias("valid_from"), end.cast("date").alias("valid_to"))
    later = F.date_add("start", 10)
    one = clause(0, F.col("text"), F.col("start"), F.when(correction, later))
    two = clause(1, F.concat("text", F.lit(":b")), later, F.when(F.col("n") % 3 == 0, F.date_add("start", 20)))
    clauses = F.when(correction, F.array(one, two)).otherwise(F.array(one))
    return d.select("section_key", "kind", "recorded_at", "document_id", F.explode(clauses).alias("c")).select("section_key", "kind", "recorded_at", "document_id", "c.*")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as chunks with both clocks: 55 % end their validity, 45 % are closed."""
    v = F.col("vec_id")
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (v % 701).cast("int"))
    written = F.timestamp_add("DAY", (v * 13 % 701).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "embeddings").select(
        v.alias("chunk_id"), F.col("label").cast("string").alias("section_key"), F.concat(F.lit("Clause "), v.cast("string"), F.lit(" of section "), F.col("label").cast("string"), F.lit(". It holds for all.")).alias("text"),
        start.alias("valid_from"), F.when(v % 20 < 11, F.date_add(start, (30 + v % 471).cast("int"))).alias("valid_to"),
        written.alias("recorded_at"), F.when(v % 20 < 9, F.timestamp_add("DAY", (30 + v % 471).cast("int"), written)).alias("recorded_until"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


#: Question texts by ``vec_id / 20 % 5``, with what they resolve to at 2025-06-01 12:00.
QUESTIONS = ("What holds on 2025-03-01?", "What did you tell me on 1 March 2025?", "What is the rule?", "What was it back then?", "What held in 2024?")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks one of five questions with that vector."""
    v = F.col("vec_id")
    text = F.element_at(F.array(*map(F.lit, QUESTIONS)), ((v / 20).cast("int") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").where(v % 20 == 0).select(v.alias("question_id"), text.alias("question"), F.col("label").cast("string").alias("section_key"), F.col("embedding").cast("array<double>").alias("embedding"))
