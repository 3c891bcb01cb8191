"""A clustered bitemporal corpus of any size, for measuring retrieval.

The strides, spans and shares of its clocks are fixed values: the baseline was measured on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def centroids(n: int, dimension: int, seed: int = 1) -> np.ndarray:
    """Random unit vectors."""
    x = np.random.default_rng(seed).normal(size=(n, dimension))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered_chunks(spark: SparkSession, rows: int, dimension: int = 768, clusters: int = 200, noise: float = 0.02, sections: int = 500, seed: int = 1) -> DataFrame:
    """``rows`` chunks about ``clusters`` centroids, 55 % with an end of validity, 45 % closed on record."""
    centre = spark.sparkContext.broadcast(centroids(clusters, dimension, seed))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("chunk_id").to_numpy()
            if not len(ids):
                continue
            x = centre.value[ids % clusters] + np.random.default_rng([seed, int(ids[0])]).normal(scale=noise, size=(len(ids), dimension))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            flat = pa.array(x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * dimension, pa.int32()), flat)], names=["chunk_id", "embedding"])

    i = F.col("chunk_id")
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (i * 31 % 701).cast("int"))
    written = F.timestamp_add("DAY", (i * 17 % 701).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    long = (30 + i * 7 % 471).cast("int")
    made = spark.range(rows).withColumnRenamed("id", "chunk_id").mapInArrow(vectors, "chunk_id long, embedding array<float>")
    return made.select(
        "chunk_id", (i % sections).cast("string").alias("section_key"), start.alias("valid_from"), F.when(i % 20 < 11, F.date_add(start, long)).alias("valid_to"),
        written.alias("recorded_at"), F.when(i * 3 % 20 < 9, F.timestamp_add("DAY", long, written)).alias("recorded_until"), "embedding",
    )


def clustered_questions(spark: SparkSession, n: int, valid_at: str, known_at: str, dimension: int = 768, clusters: int = 200, noise: float = 0.02, seed: int = 1) -> DataFrame:
    """Questions near the same centroids, all about one pair of instants."""
    rng = np.random.default_rng(seed + 1)
    x = centroids(clusters, dimension, seed)[rng.integers(0, clusters, n)] + rng.normal(scale=noise, size=(n, dimension))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "question_id long, embedding array<double>").withColumns({"valid_at": F.lit(valid_at).cast("date"), "known_at": F.lit(known_at).cast("timestamp_ntz")})
