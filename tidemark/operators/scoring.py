"""Scores of retrieval: ranks, blends, margins, recall, thresholds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import cosine


def question_scores(hits: DataFrame, k: int = 5) -> DataFrame:
    """Per question of ``hits(question_id, klass, rank, section, correct, same_section)``.

    ``correct_rank`` is the rank of the first correct hit; ``blended`` if a section is met twice in
    the first ``k``; ``superseded`` if the first hit has the section but not the version.
    """
    top = F.col("rank") <= k
    return hits.groupBy("question_id", "klass").agg(
        F.min(F.when(F.col("correct") & top, F.col("rank"))).alias("correct_rank"),
        (F.count(F.when(top, F.col("section"))) > F.count_distinct(F.when(top, F.col("section")))).alias("blended"),
        F.coalesce(F.bool_or((F.col("rank") == 1) & F.col("same_section") & ~F.col("correct")), F.lit(False)).alias("superseded"),
    )


def class_scores(scores: DataFrame) -> DataFrame:
    """Counts by class and, with class ``total``, over all."""
    return (
        scores.rollup("klass")
        .agg(
            F.count("*").alias("n"), F.count_if(F.col("correct_rank") == 1).alias("top1"), F.count("correct_rank").alias("recalled"),
            F.count_if("superseded").alias("superseded"), F.count_if("blended").alias("blended"),
        )
        .withColumn("klass", F.coalesce("klass", F.lit("total")))
    )


def margins(extremes: DataFrame) -> DataFrame:
    """Best minus second-best similarity by question of ``extremes(question_id, best, second)``; one row alone has none."""
    return extremes.where("second is not null").select("question_id", F.round(F.col("best") - F.col("second"), 6).alias("margin"))


def spread(extremes: DataFrame) -> DataFrame:
    """Best minus worst similarity among a section's versions by question of ``extremes(question_id, section_key, best, worst, versions)``."""
    return extremes.select("question_id", "section_key", F.round(F.col("best") - F.col("worst"), 6).alias("spread"), "versions")


def order_statistics(values: DataFrame, column: str, **shares: float) -> DataFrame:
    """One row: for each name the value at place ``min(int(share * n), n - 1)`` of the sorted column, and ``greatest``.

    Not interpolated; a share of a half is the upper median.  The aggregation keeps a count for each
    *different* value: two million at most for similarities rounded at six digits, whatever the
    number of rows.  Nulls are left out; no values give nulls.
    """
    rows = values.where(F.col(column).isNotNull())
    n = rows.count()
    at = {name: (min(int(share * n), n - 1) + 0.5) / max(1, n) for name, share in shares.items()}
    picked = [F.expr(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY {column})").alias(name) for name, p in at.items()] if n else [F.lit(None).cast("double").alias(name) for name in shares]
    return rows.agg(*picked, F.max(column).alias("greatest"))


def separation(chunks: DataFrame, centroids: DataFrame, other: Column) -> DataFrame:
    """One row ``(own, other)``: mean distances of chunks to the centroid of their section and to that of the section ``other`` names.

    ``centroids(section_key, centroid)`` has a row a section, far fewer than the chunks; Spark decides
    by its size whether to broadcast it.
    """
    mine, far = centroids.select(F.col("section_key").alias("_own"), F.col("centroid").alias("_a")), centroids.select(F.col("section_key").alias("_far"), F.col("centroid").alias("_b"))
    rows = chunks.withColumn("_other", other).join(mine, F.col("section_key") == F.col("_own")).join(far, F.col("_other") == F.col("_far"))
    mean = lambda v: F.round(F.avg(1 - cosine(F.col("embedding"), v)), 5)
    return rows.agg(mean(F.col("_a")).alias("own"), mean(F.col("_b")).alias("other"))


def judged_separation(distances: DataFrame) -> DataFrame:
    """``distances(own, other)`` with ``separates``: rows lie no further from their own centroid than half the way to another."""
    return distances.withColumn("separates", F.col("own") <= F.col("other") / 2)


def separated(distances: DataFrame) -> DataFrame:
    """``distances(own, other)`` as they are; an error where they do not separate.

    Figures of retrieval over vectors that do not separate say nothing, so a bench stops here.
    """
    message = F.concat(F.lit("clusters do not separate: own "), F.col("own").cast("string"), F.lit(", other "), F.col("other").cast("string"))
    return judged_separation(distances).select(F.when(F.col("separates"), F.col("own")).otherwise(F.raise_error(message).cast("double")).alias("own"), "other")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall of ``found`` against ``truth`` (``question_id, chunk_id, distance``) and the mean distance ratio."""
    hits = found.join(truth.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi").agg(F.count("*").alias("hits"))
    size = truth.agg(F.count("*").alias("size"))
    mean = lambda df, name: df.groupBy("question_id").agg(F.avg("distance").alias(name))
    ratio = mean(found, "mine").join(mean(truth, "exact"), "question_id").where("exact > 0").agg(F.round(F.avg(F.col("mine") / F.col("exact")), 6).alias("distance_ratio"))
    return hits.join(size).join(ratio).select(F.round(F.col("hits") / F.col("size"), 6).alias("recall"), "distance_ratio")


def threshold_sweep(distances: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Per floor: off-topic questions refused and on-topic ones answered, of ``distances(distance, on_topic)``."""
    each = distances.select(F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("floor"), "distance", "on_topic")
    return each.groupBy("floor").agg(
        F.count_if(~F.col("on_topic") & (F.col("distance") > F.col("floor"))).alias("off_topic_refused"),
        F.count_if(F.col("on_topic") & (F.col("distance") <= F.col("floor"))).alias("on_topic_answered"),
    )


def distance_stats(distances: DataFrame) -> DataFrame:
    """Least, median and greatest distance by topic; the median is exact and interpolated."""
    return distances.groupBy("on_topic").agg(F.min("distance").alias("least"), F.round(F.percentile("distance", F.lit(0.5)), 6).alias("median"), F.max("distance").alias("greatest"), F.count("*").alias("n"))


#: Hashes that travel together to the digest.
_PIECE = 16_384


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a sorted range as long strings, numbered."""
    part, nth = TaskContext.get().partitionId(), 0
    for b in batches:
        for at in range(0, b.num_rows, _PIECE):
            text = ",".join(b.column("content_hash").slice(at, _PIECE).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([text])], names=["part", "nth", "hashes"])
            nth += 1


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of all strings in turn: its state goes on from one to the next."""
    digest, any_yet = hashlib.md5(), False
    for text in (t for b in batches for t in b.column("hashes").to_pylist()):
        digest.update((("," if any_yet else "") + text).encode())
        any_yet = True
    if any_yet:
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()[:12]])], names=["corpus_rev"])


def corpus_revision(documents: DataFrame) -> DataFrame:
    """One row: the first 12 digits of the md5 of all content hashes in order of recording, joined by commas.

    Ranges of documents are sorted side by side and packed into strings of thousands of hashes; one
    task takes the strings in order and carries the digest on, 65 bytes a document, so that its
    memory does not grow with them.  Documents of one moment are in order of their hashes; those
    without a hash are left out; no documents give an empty text.
    """
    hashed = documents.where(F.col("content_hash").isNotNull()).select("recorded_at", F.col("content_hash").cast("string").alias("content_hash"))
    ordered = hashed.repartitionByRange("recorded_at", "content_hash").sortWithinPartitions("recorded_at", "content_hash")
    pieces = ordered.mapInArrow(_pieces, "part int, nth int, hashes string").repartition(1).sortWithinPartitions("part", "nth")
    return pieces.mapInArrow(_chained, "corpus_rev string").agg(F.coalesce(F.max("corpus_rev"), F.lit("")).alias("corpus_rev"))


def missing_needles(text: Column, must: Column, must_not: Column) -> Column:
    """Faults of a text: needles it lacks and needles it must not have."""
    lacks = F.transform(F.filter(must, lambda n: ~F.contains(text, n)), lambda n: F.concat(F.lit("missing "), n))
    has = F.transform(F.filter(must_not, lambda n: F.contains(text, n)), lambda n: F.concat(F.lit("blended with "), n))
    return F.concat(lacks, has)
