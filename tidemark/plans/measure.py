"""How well a retriever finds the rule in force: one measure for every index and every way to search it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.operators.retrieval import batch_nearest_once

#: From questions and a number of hits to ``question_id, rank, chunk_id, distance``: the place to plug another search in.
Retriever = Callable[[DataFrame, int], DataFrame]


def exact(chunks: DataFrame, scope: str = "all") -> Retriever:
    """Exact search of ``chunks(chunk_id, embedding, ...)``; scopes other than ``all`` need their clocks.

    Equal questions are searched once.
    """
    return lambda questions, k: batch_nearest_once(chunks, questions, k, scope)


def measure(index: DataFrame, retrieve: Retriever, cases: DataFrame, k: int = 5, by_version: bool = True) -> DataFrame:
    """Scores by class, as ``class_scores`` gives them, of what ``retrieve`` finds for ``cases`` in ``index``.

    ``index(chunk_id, section_key, document_id)`` says what a hit is; a case is ``(question_id, klass,
    section_key, chunk_id, document_id, embedding, valid_at, known_at)`` with the version in force and
    its document.  A hit is right if it is that version or, where an index knows no versions
    (``by_version=False``), if it has the section and comes from the version's document.  A case
    that finds nothing counts, with no hit.
    """
    found = retrieve(cases.select("question_id", "embedding", "valid_at", "known_at"), k)
    what = index.select("chunk_id", F.col("section_key").alias("section"), F.col("document_id").alias("_source"))
    right = cases.select("question_id", "klass", "section_key", F.col("chunk_id").alias("_version"), F.col("document_id").alias("_document"))
    same = F.coalesce(F.col("section") == F.col("section_key"), F.lit(False))
    hit = F.col("chunk_id") == F.col("_version") if by_version else same & (F.col("_source") == F.col("_document"))
    hits = right.join(found.join(what, "chunk_id"), "question_id", "left").select("question_id", "klass", "rank", "section", F.coalesce(hit, F.lit(False)).alias("correct"), same.alias("same_section"))
    return scoring.class_scores(scoring.question_scores(hits, k))


def headline(indexes: dict[str, tuple[DataFrame, Retriever, bool]], cases: DataFrame, k: int = 5) -> DataFrame:
    """One row an index, name to ``(index, retriever, by_version)``: how often the rule in force comes first, and what comes instead."""
    out = None
    for name, (index, retrieve, by_version) in indexes.items():
        total = measure(index, retrieve, cases.withColumn("klass", F.lit("all")), k, by_version).where("klass = 'total'")
        row = total.select(F.lit(name).alias("index_name"), "n", "top1", "recalled", "superseded", "blended")
        out = row if out is None else out.unionByName(row)
    return out
