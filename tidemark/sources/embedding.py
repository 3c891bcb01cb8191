"""Vectors of texts from a pluggable embedder, kept by model and text.

An embedder is a function of a list of texts that returns as many lists of floats.  There is no
fallback: an unknown model, a failing embedder or a wrong number or size of vectors is an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from string import ascii_lowercase

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
EMBEDDERS: dict[str, Embedder] = {}


def word_hash(texts: list[str], size: int = 256) -> list[list[float]]:
    """An embedder without a model: lower-cased words, and their first four letters, counted in ``size`` buckets."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in re.findall(r"\w+", text.lower()):
            for part in (word, word[:4]):
                v[zlib.crc32(part.encode()) % size] += 1.0
        out.append(v)
    return out


def letter_counts(texts: list[str]) -> list[list[float]]:
    """How often each letter a to z, of either case, occurs: the plainest embedder there is."""
    return [[float(t.count(c) + t.count(c.upper())) for c in ascii_lowercase] for t in texts]


def register(model: str, embedder: Embedder) -> None:
    EMBEDDERS[model] = embedder


register("word-hash-256", word_hash)
register("letters-26", letter_counts)


def embed(texts: DataFrame, model: str, dimension: int, batch: int = 256) -> DataFrame:
    """``(model, text_sha, embedding)`` for the distinct texts of ``texts(text_sha, text)``, in batches."""
    if model not in EMBEDDERS:
        raise ValueError(f"no embedder is registered as {model!r}")
    embedder = EMBEDDERS[model]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                vectors = embedder(part["text"].tolist())
                if len(vectors) != len(part) or any(len(v) != dimension for v in vectors):
                    raise ValueError(f"{model} did not return {len(part)} vectors of {dimension} dimensions")
                yield pd.DataFrame({"model": model, "text_sha": part["text_sha"].to_numpy(), "embedding": [list(map(float, v)) for v in vectors]})

    return texts.dropDuplicates(["text_sha"]).select("text_sha", "text").mapInPandas(run, "model string, text_sha string, embedding array<double>")


def kept_vectors(table: DataFrame, model: str) -> DataFrame:
    """Vectors of one model from the table of all."""
    return table.where(F.col("model") == model).select("text_sha", "embedding")


def dimension_of(chunks: DataFrame) -> int | None:
    """The vectors' size; several sizes are an error, no rows have none."""
    sizes = [r[0] for r in chunks.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of several sizes in one index")
    return sizes[0] if sizes else None
