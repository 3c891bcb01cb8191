"""What exact search over an index costs and what ranking before filtering loses, measured one question at a time."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.operators.retrieval import batch_nearest, centroids_by_section
from tidemark.operators.temporal import holds
from tidemark.plans.ask import broken, candidates


def at_place(seconds: list[float], share: float) -> float:
    """The value at place ``min(int(share * n), n - 1)`` in order, in milliseconds."""
    ordered = sorted(seconds)
    return round(1000 * ordered[min(int(share * len(ordered)), len(ordered) - 1)], 1)


def index_bench(chunks: DataFrame, scopes: dict[str, tuple[DataFrame, str]], other: F.Column, k: int = 5, singles: int = 15) -> dict[str, dict[str, float]]:
    """Figures by name for ``scopes``, name to ``(questions, scope)``; ``chunks`` should be cached.

    First the vectors must separate: chunks nearer to their section's centroid than half the way to
    that of section ``other``, else this is an error.  Then, for each scope: the milliseconds of a
    question in one batch of all, p50 and p95 of ``singles`` questions asked one at a time, the share
    of chunks that survives the clocks, and recall and distance ratio of ranking all chunks first
    and filtering their ``k`` nearest afterwards.
    """
    apart = scoring.separated(scoring.separation(chunks, centroids_by_section(chunks), other)).first()
    out = {"separation": {"own": apart["own"], "other": apart["other"]}}
    total = chunks.count()
    for name, (asked, scope) in scopes.items():
        questions = asked.cache()
        n = questions.count()
        truth = batch_nearest(chunks, questions, k, scope).cache()
        truth.count()
        began = time.perf_counter()
        batch_nearest(chunks, questions, k, scope).collect()
        batch = time.perf_counter() - began
        took = []
        ids = [r["question_id"] for r in questions.select("question_id").orderBy("question_id").limit(singles).collect()]
        for i in ids:  # one question is one plan: that is what is timed
            one = questions.where(F.col("question_id") == i)
            began = time.perf_counter()
            batch_nearest(chunks, one, k, scope).collect()
            took.append(time.perf_counter() - began)
        figures = {"batch_ms": round(1000 * batch / n, 2), "p50_ms": at_place(took, 0.5), "p95_ms": at_place(took, 0.95)}
        if scope == "as_of":
            at = questions.select("valid_at", "known_at").distinct()
            alive = holds(F.col("valid_from"), F.col("valid_to"), F.col("valid_at")) & holds(F.col("recorded_at"), F.col("recorded_until"), F.col("known_at"))
            if at.count() == 1:
                first = at.first()
                fixed = chunks.withColumns({"valid_at": F.lit(first["valid_at"]), "known_at": F.lit(first["known_at"]).cast(chunks.schema["recorded_at"].dataType)})
                figures["survives"] = round(fixed.where(alive).count() / total, 4)
            r = scoring.recall(candidates(chunks, questions, broken("post-filter", k=k)), truth).first()
            figures |= {"post_filter_recall": r["recall"], "post_filter_ratio": r["distance_ratio"]}
        out[name] = figures
        truth.unpersist()
        questions.unpersist()
    return out
