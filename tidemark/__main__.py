"""python -m tidemark ingest|show|history|index|ask|replay: a corpus folder kept in a store and read as of two instants.

No command reads the wall clock: ``ask`` is told the moment of asking.
"""

from __future__ import annotations

import argparse
import hashlib
from datetime import UTC, date, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.clock import AsOf
from tidemark.operators import temporal
from tidemark.plans import ask as plan
from tidemark.plans.gate import replayed
from tidemark.plans.ingest import documents_of, ingest, stored, versions_of
from tidemark.plans.replay import replay
from tidemark.ship import ship
from tidemark.sources.corpus import append, read_documents
from tidemark.sources.embedding import embed, kept_vectors
from tidemark.sources.render import markdown

MODEL, SIZE = "word-hash-256", 256


def instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def build(spark: SparkSession, store: str, model: str = MODEL, size: int = SIZE) -> int:
    """Embed the texts that have no vector yet and write the index; returns how many were embedded."""
    versions = versions_of(spark, store)
    known = stored(spark, f"{store}/vectors")
    vectors = spark.createDataFrame([], "text_sha string, embedding array<double>") if known is None else kept_vectors(known, model)
    missing = plan.missing_vectors(versions, vectors).cache()
    count = missing.count()
    if count:
        append(embed(missing, model, size), f"{store}/vectors")
    vectors = kept_vectors(spark.read.parquet(f"{store}/vectors"), model)
    plan.build_index(versions, vectors, size, model=model).write.mode("overwrite").parquet(f"{store}/index")
    return count


def answer(spark: SparkSession, store: str, question: str, now: datetime, valid_at: date | None, known_at: datetime | None, floor: float) -> str:
    """Ask one question, record the answer with its citations, and return what to print."""
    key = hashlib.sha256(f"{now.isoformat()} {question}".encode()).hexdigest()[:12]
    asked = spark.createDataFrame([(key, question, question, valid_at, known_at)], "question_id string, question string, text string, valid_at date, known_at timestamp")
    vector = embed(asked.select(F.col("question_id").alias("text_sha"), "text"), MODEL, SIZE).select(F.col("text_sha").alias("question_id"), "embedding")
    at = F.lit(now).cast("timestamp")
    found = plan.ask(asked.drop("text").join(vector, "question_id"), spark.read.parquet(f"{store}/index"), documents_of(spark, store), at, plan.Options(floor=floor))
    append(found, f"{store}/asked/{key}")
    found = spark.read.parquet(f"{store}/asked/{key}")
    if not (known := stored(spark, f"{store}/answers")) or not known.where(F.col("question_id") == key).count():
        append(plan.answer_rows(found, at), f"{store}/answers")
        append(plan.citations(found), f"{store}/citations")
    row = found.first()
    cited = ", ".join(f"{c['section_key']} ({c['version_id']})" for c in row["citations"] or ()) if row["outcome"] == plan.ANSWERED else "-"
    return f"{key} {row['outcome']}: {row['answer_text'] or row['refusal_reason']}\ncited: {cited}"


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    own = {name: sub.add_parser(name) for name in ("ingest", "show", "history", "index", "ask", "replay")}
    own["ingest"].add_argument("corpus", help="folder of Markdown documents")
    for p in own.values():
        p.add_argument("store", help="folder the tables are kept in")
    for name in ("show", "history"):
        own[name].add_argument("section")
    own["ask"].add_argument("question")
    own["ask"].add_argument("--now", type=instant, required=True, help="the moment of asking")
    own["ask"].add_argument("--floor", type=float, default=0.8, help="greatest distance of a passage on the topic")
    for name in ("show", "ask"):
        own[name].add_argument("--valid-at", type=date.fromisoformat, required=name == "show")
        own[name].add_argument("--known-at", type=instant, required=name == "show")
    a = top.parse_args(args)
    spark = ship(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    if a.command == "ingest":
        try:
            print(f"{ingest(spark, read_documents(spark, a.corpus), a.store)} new documents, {versions_of(spark, a.store).count()} versions")
        except ValueError as e:
            raise SystemExit(str(e)) from e
    elif a.command == "history":
        print(markdown(temporal.history(versions_of(spark, a.store), a.section), 1000))
    elif a.command == "show":
        versions = versions_of(spark, a.store)
        at = AsOf(a.valid_at, a.known_at)
        request = spark.createDataFrame([(1, a.section)], "request_id int, section_key string").select("*", temporal.moment(at, versions).alias("known_at")).withColumn("valid_at", F.lit(at.valid_at))
        print(markdown(temporal.read_sections(request, versions)))
    elif a.command == "index":
        print(f"{build(spark, a.store)} texts embedded")
    elif a.command == "ask":
        print(answer(spark, a.store, a.question, a.now, a.valid_at, a.known_at, a.floor))
    else:
        answers = spark.read.parquet(f"{a.store}/answers")
        verdicts = replay(answers.select("question_id"), answers, spark.read.parquet(f"{a.store}/citations"), spark.read.parquet(f"{a.store}/index")).cache()
        print(markdown(verdicts.orderBy("question_id"), 1000))
        print(markdown(replayed(verdicts)))


if __name__ == "__main__":
    main()
