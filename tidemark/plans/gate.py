"""The merge gate: answers against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.operators.scoring import missing_needles
from tidemark.operators.temporal import as_of_join
from tidemark.plans.ask import ANSWERED


def gold_disagreements(cases: DataFrame, versions: DataFrame) -> DataFrame:
    """Cases ``(case_id, section_key, valid_at, known_at, must_contain, must_not_contain)`` that the store itself contradicts."""
    read = as_of_join(cases.where(F.col("section_key").isNotNull()), versions.select("section_key", "text", "valid_from", "valid_to", "recorded_at", "recorded_until"), "section_key", "valid_at", "known_at")
    joined = cases.join(read.select("case_id", F.col("text").alias("_text")), "case_id", "left").where(F.col("section_key").isNotNull() & (F.size("must_contain") > 0))
    faults = F.when(F.col("_text").isNull(), F.array(F.lit("nothing in force"))).otherwise(missing_needles(F.col("_text"), F.col("must_contain"), F.col("must_not_contain")))
    return joined.select("case_id", faults.alias("faults")).where(F.size("faults") > 0)


def scored(cases: DataFrame, answers: DataFrame, authored_rev: str | None = None) -> DataFrame:
    """``case_id, klass, expected, outcome, faults, status``: ok, or failed as REGRESSION or gold-stale.

    A failure is stale when the corpus is not the revision the expectations were written against.
    """
    rows = cases.join(answers.withColumnRenamed("question_id", "case_id").select("case_id", "outcome", "answer_text", "corpus_rev"), "case_id", "left")
    wrong = F.when(~F.col("outcome").eqNullSafe(F.col("expected")), F.array(F.concat(F.lit("outcome "), F.coalesce("outcome", F.lit("none"))))).otherwise(F.array().cast("array<string>"))
    text = F.when((F.col("expected") == ANSWERED) & (F.col("outcome") == ANSWERED), missing_needles(F.col("answer_text"), F.col("must_contain"), F.col("must_not_contain"))).otherwise(F.array().cast("array<string>"))
    faults = F.concat(wrong, text)
    stale = F.lit(False) if authored_rev is None else F.col("corpus_rev") != authored_rev
    status = F.when(F.size("faults") == 0, "ok").when(stale, "gold-stale").otherwise("REGRESSION")
    return rows.withColumn("faults", faults).select("case_id", "klass", "expected", "outcome", "faults", status.alias("status"))


def by_class(outcomes: DataFrame) -> DataFrame:
    """Cases and passes by class."""
    return outcomes.groupBy("klass").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("passed"))


def refusal_pair(outcomes: DataFrame) -> DataFrame:
    """Refused and answered when they should have been, over all that should."""
    refuse = F.col("expected") != ANSWERED
    return outcomes.agg(
        F.count_if(refuse).alias("should_refuse"), F.count_if(refuse & (F.col("outcome") != ANSWERED)).alias("refused"),
        F.count_if(~refuse).alias("should_answer"), F.count_if(~refuse & (F.col("outcome") == ANSWERED)).alias("answered"),
    )


def newly_failed(failures: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per break, failures that the whole engine does not have."""
    return failures.join(baseline.select("case_id"), "case_id", "left_anti").groupBy("break_name").agg(F.count_distinct("case_id").alias("newly_red"))


def ablation_matrix(cases: DataFrame, answers: DataFrame, whole: str) -> DataFrame:
    """``break_name, newly_red, changed`` of every engine of ``answers(engine, ...)`` but ``whole``.

    ``newly_red`` are cases that fail under the break and pass in the whole engine; ``changed`` are
    those whose record differs in any way: outcome, answer, prompt, fence or number of citations.
    """
    names = answers.select("engine").distinct()
    record = F.struct("outcome", "answer_text", "prompt_sha256", "fence_token", F.coalesce(F.size("citations"), F.lit(-1)).alias("cited"))
    told = answers.select("engine", "question_id", record.alias("record"))
    each = cases.crossJoin(F.broadcast(names)).withColumn("case_id", F.concat_ws("/", "engine", "case_id"))  # as many rows as answers
    keyed = answers.withColumn("question_id", F.concat_ws("/", "engine", "question_id"))
    red = scored(each, keyed).select("case_id", (F.col("status") != "ok").alias("red"))
    rows = told.withColumn("case_id", F.concat_ws("/", "engine", "question_id")).join(red, "case_id")
    base = rows.where(F.col("engine") == whole).select("question_id", F.col("red").alias("_red"), F.col("record").alias("_record"))
    compared = rows.where(F.col("engine") != whole).join(base, "question_id")
    return compared.groupBy(F.col("engine").alias("break_name")).agg(F.count_if(F.col("red") & ~F.col("_red")).alias("newly_red"), F.count_if(~F.col("record").eqNullSafe(F.col("_record"))).alias("changed"))


def resolution_scored(cases: DataFrame, now: Column) -> DataFrame:
    """Outcomes, in the columns of ``scored``, of cases ``(case_id, question, expected, valid_at, moves_known_at)``.

    A fault is another outcome than expected, another day where one is given, or a ``known_at`` that
    moved, or stayed, against expectation.  What a question's date is hangs on no corpus: a
    failure is a regression, never stale.
    """
    r = F.col("_r")
    none = F.array().cast("array<string>")
    moved = r["known_at"].isNotNull() & (r["known_at"] != now.cast("timestamp"))
    faults = F.concat(
        F.when(r["outcome"] != F.col("expected"), F.array(F.concat(F.lit("outcome "), r["outcome"]))).otherwise(none),
        F.when(F.col("valid_at").isNotNull() & ~r["valid_at"].eqNullSafe(F.col("valid_at")), F.array(F.concat(F.lit("day "), F.coalesce(r["valid_at"].cast("string"), F.lit("none"))))).otherwise(none),
        F.when(moved != F.coalesce("moves_known_at", F.lit(False)), F.array(F.when(moved, "known_at moved").otherwise("known_at stayed"))).otherwise(none),
    )
    rows = cases.withColumn("_r", dates.resolve(F.col("question"), now)).withColumn("faults", faults)
    status = F.when(F.size("faults") == 0, "ok").otherwise("REGRESSION")
    return rows.select("case_id", F.lit("resolution").alias("klass"), "expected", r["outcome"].alias("outcome"), "faults", status.alias("status"))


def all_outcomes(answers: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Outcomes of both kinds of cases, one after the other."""
    return answers.unionByName(resolutions)


def replayed(verdicts: DataFrame, reproduced: str = "reproduced") -> DataFrame:
    """How many answers were replayed, and how many of them reproduce."""
    return verdicts.agg(F.count("*").alias("replayed"), F.count_if(F.col("verdict") == reproduced).alias("reproduced"))
