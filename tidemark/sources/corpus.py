"""A corpus of Markdown documents with YAML front matter, and what else the engine reads and appends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.versions import KINDS

CLAUSE = "struct<section:string,heading:string,text:string,valid_from:date,valid_to:date>"
PARSED = f"doc_id string, kind string, title string, effective_from date, recorded_at timestamp, body string, clauses array<{CLAUSE}>, error string"


def _day(value: object) -> dt.date | None:
    if value is None:
        return None
    if isinstance(value, dt.datetime):
        return value.date()
    if not isinstance(value, dt.date):
        raise ValueError(f"{value!r} is not a date")
    return value


def _known_day(value: object, of: str) -> dt.date:
    day = _day(value)
    if day is None:
        raise ValueError(f"{of} has no date")
    return day


def _moment(value: object) -> dt.datetime:
    if not isinstance(value, dt.datetime):
        raise ValueError(f"{value!r} is not a timestamp")
    return value if value.tzinfo else value.replace(tzinfo=dt.UTC)


def _clauses(front: dict, kind: str) -> tuple[list[dict], dt.date]:
    row = lambda of, x, start, end: {"section": str(of["section"]), "heading": of.get("heading"), "text": x["text"].strip(), "valid_from": start, "valid_to": end}
    if kind == "correction":
        found = [row(of, v, _known_day(v["valid_from"], "valid_from"), _day(v.get("valid_to"))) for of in front["corrects"] for v in of["versions"]]
        return found, min(c["valid_from"] for c in found)
    start = _known_day(front["effective_from"], "effective_from")
    if kind == "amendment":
        return [row(of, of, start, None) for of in front["amends"]], start
    return [row(of, of, _known_day(of.get("valid_from", start), "valid_from"), _day(of.get("valid_to"))) for of in front["sections"]], start


def parse_document(raw: str) -> dict:
    """One document; ``error`` says what is wrong with it."""
    import yaml  # only here: no other source needs it

    out = dict.fromkeys(("doc_id", "kind", "title", "effective_from", "recorded_at", "body", "clauses", "error"))
    try:
        empty, front_text, body = raw.split("---\n", 2)
        front = yaml.load(front_text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        if empty or not isinstance(front, dict):
            raise ValueError("front matter is not a mapping at the start")
        kind = front["kind"]
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        clauses, start = _clauses(front, kind)
        return out | {"doc_id": str(front["id"]), "kind": kind, "title": str(front["title"]), "effective_from": start, "recorded_at": _moment(front["recorded_at"]), "body": body.strip(), "clauses": clauses}
    except (ValueError, KeyError, TypeError, AttributeError, yaml.YAMLError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


def read_documents(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """Documents of a folder of ``*.md`` files in order of recording, with ``content`` and ``content_hash``.

    A document that cannot be parsed is an error; with ``strict=False`` it has ``error`` and nulls.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").withColumnRenamed("value", "content")
    return parse_documents(files, strict).orderBy("recorded_at", "content_hash")


def parse_documents(raw: DataFrame, strict: bool = True) -> DataFrame:
    """``raw(content)`` parsed: the columns of ``PARSED``, content, its hash, and the id that follows from the hash."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([parse_document(t) for t in b["content"]], columns=["doc_id", "kind", "title", "effective_from", "recorded_at", "body", "clauses", "error"])
            yield found.assign(content=b["content"].to_numpy())

    # not a column expression: a filter on ``error`` would be pushed below it and parse every text twice
    docs = raw.select("content").mapInPandas(parsed, f"{PARSED}, content string")
    docs = docs.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    docs = docs.withColumns({"document_uid": document_uid(F.col("content_hash")), "effective_to": F.lit(None).cast("date")})
    if strict:
        docs = docs.withColumn("doc_id", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("doc_id")))
    return docs


def document_uid(content_hash: Column) -> Column:
    """An id in the form of a UUID that the content alone decides: the same text is the same document anywhere."""
    h = F.sha2(F.concat(F.lit("tidemark-document:"), content_hash).cast("binary"), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def clause_log(documents: DataFrame) -> DataFrame:
    """The log that ``rebuild_versions`` folds: one row a clause; equal contents are taken once."""
    once = documents.dropDuplicates(["content_hash"])
    each = once.select("doc_id", "kind", "recorded_at", F.posexplode("clauses").alias("clause_no", "c"))
    return each.select(F.col("c.section").alias("section_key"), "kind", "recorded_at", F.col("doc_id").alias("document_id"), "clause_no", F.col("c.text").alias("text"), F.col("c.valid_from").alias("valid_from"), F.col("c.valid_to").alias("valid_to"))


def published_index(documents: DataFrame) -> DataFrame:
    """Chunks as published, time ignored: base clauses under their heading, each memo once a section.

    A document holds all its clauses, so this is one pass without a shuffle.
    """
    whole = F.concat_ws("\n", "title", "body")

    def clause(c: Column) -> Column:
        headed = F.when(c["heading"].isNotNull(), F.concat_ws(" ", c["section"], c["heading"]))
        return F.struct(c["section"].alias("section"), F.concat_ws("\n", headed, c["text"]).alias("text"))

    base = F.transform("clauses", clause)
    memo = F.array_distinct(F.transform("clauses", lambda c: F.struct(c["section"].alias("section"), whole.alias("text"))))
    chunks = F.when(F.col("kind") == "base", base).otherwise(memo)
    each = documents.select("doc_id", F.explode(chunks).alias("c"))
    return each.select(F.concat_ws(":", "doc_id", "c.section").alias("chunk_id"), F.col("c.section").alias("section_key"), "c.text", F.col("doc_id").alias("document_id"))


def version_index(versions: DataFrame, *more: str) -> DataFrame:
    """A chunk for every version, closed ones too, with no filter at all; ``more`` columns of the version stay."""
    return versions.select(F.col("version_id").alias("chunk_id"), "section_key", "text", "document_id", "version_no", *more).orderBy("section_key", "version_no")


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Append rows to a Parquet table: documents, versions, chunks, answers, citations."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
