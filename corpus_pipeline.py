"""From raw documents to a training mix: five stages, each written and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import delete, scratch, shared_dir
from tidemark.llm.decontam import decontaminate
from tidemark.llm.langid import fit_languages, identify
from tidemark.llm.mixing import mix
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.llm.subtree import remove_repeats
from tidemark.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject; learned from their own ``lang``.

    Null, empty and letterless texts are rejected, and texts in two languages; ``lang`` itself may
    be null.  Repeated rows stay repeated.  Where no row has a language, all are rejected.
    """
    ship(spark)
    model = fit_languages(docs.select("doc_id", "text", "lang"))
    judged = identify(docs.select("text", F.struct("*").alias("_whole")), model)
    return judged.where(~F.col("rejected")).select("_whole.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, null counting as the largest.  Null and empty texts are
    one group, as are repeated rows; texts under five words are one shingle.
    """
    ship(spark)
    return drop_near_duplicates(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur earlier; ``n_chars`` follows.

    No row goes, even if all its words do.  Untouched texts stay as they are, null and empty ones
    among them; a null doc_id is the earliest, and rows that share a doc_id are one place.
    """
    ship(spark)
    cut = remove_repeats(docs, length=50)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and short texts hold none; an empty benchmark lets all pass.  Repeated rows go or stay together.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with how many words the mix takes of each: ``size, source_size, target, taken``.

    A null source is a source of its own; null and empty texts have size 0 and give nothing.
    """
    return mix(docs, whole=True)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

#: No SQL expresses compression, fingerprints or components; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again.

    What a stage keeps on the way goes once its result is written, and so does the result before
    it; the last result stays for the caller.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
