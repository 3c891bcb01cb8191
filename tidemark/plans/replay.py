"""Replay of recorded answers: is the prompt still what it was?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ask import ANSWERED, Options, digest, prompt_text

REPRODUCED, SYSTEM_CHANGED, PASSAGES_CHANGED, NOT_REPRODUCIBLE = "reproduced", "system-prompt-changed", "passages-changed", "not-reproducible"


def replay(requests: DataFrame, answers: DataFrame, cited: DataFrame, chunks: DataFrame, options: Options = Options()) -> DataFrame:
    """``question_id, verdict`` of every requested id.

    In this order: no such answer is not reproducible; a refusal is reproduced, it has nothing to
    rebuild; an answer without citations is not reproducible; an equal prompt hash is reproduced;
    another system prompt is named; else a cited text has changed.  Passages are rebuilt from the
    citations' own dates and the texts as they are now.
    """
    text = chunks.select(F.col("chunk_id").alias("version_id"), "text")
    passages = cited.join(text, "version_id").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", "section_key", "text", "valid_from", "valid_to"))).alias("passages"))
    rows = requests.select("question_id").join(answers, "question_id", "left").join(passages, "question_id", "left")
    user = prompt_text(F.col("question_id").cast("string"), F.col("question"), F.col("valid_at"), F.col("known_at"), F.col("passages"), options)
    verdict = (
        F.when(F.col("outcome").isNull(), NOT_REPRODUCIBLE)
        .when(F.col("outcome") != ANSWERED, REPRODUCED)
        .when(F.col("passages").isNull(), NOT_REPRODUCIBLE)
        .when(digest(options.system, user) == F.col("prompt_sha256"), REPRODUCED)
        .when(F.sha2(F.lit(options.system).cast("binary"), 256) != F.col("system_sha256"), SYSTEM_CHANGED)
        .otherwise(PASSAGES_CHANGED)
    )
    return rows.select("question_id", verdict.alias("verdict"))
