"""Ingest: new documents into a store, the sections they touch folded anew, checked, and committed at once.

A store is a folder of data folders and manifests.  A manifest names every folder that counts, so it
is the store's state; a commit is the creation of the next manifest under its number, which only one
writer can do.  What no manifest names was never ingested.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.operators import constraints
from tidemark.operators.versions import KINDS, rebuild_versions
from tidemark.sources import files
from tidemark.sources.corpus import clause_log


#: Clauses of a section, and versions of one, beyond which many tasks share it.
HOT = 20_000_000


class StaleStore(RuntimeError):
    """Another writer committed first; nothing of this one's is in the store."""


@dataclass(frozen=True)
class Manifest:
    """Folders of a store: ``documents`` and ``log`` one a commit, ``versions`` one a bucket of sections."""

    number: int = 0
    buckets: int = 64
    documents: tuple[str, ...] = ()
    log: tuple[str, ...] = ()
    versions: dict[str, str] = field(default_factory=dict)

    def folders(self) -> set[str]:
        """Folders of commits that this state still needs."""
        return {p.split("/")[0] for p in (*self.documents, *self.log, *self.versions.values())}


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of the store, or None before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def latest(spark: SparkSession, store: str, buckets: int = 64) -> Manifest:
    """The state of the store; an empty one with ``buckets`` buckets before the first commit."""
    found = [n for n in files.names(spark, f"{store}/manifests") if n.endswith(".json") and not n.startswith(".")]
    if not found:
        return Manifest(buckets=buckets)
    m = json.loads(files.read_text(spark, f"{store}/manifests/{found[-1]}"))
    return Manifest(m["number"], m["buckets"], tuple(m["documents"]), tuple(m["log"]), m["versions"])


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def violations(versions: DataFrame, documents: DataFrame, sources: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """``(constraint_name, violations)`` of a store, every constraint one row; ``sources(doc_id)`` are the documents versions may come from."""
    return constraints.counted(
        overlap=constraints.overlaps(versions, hot),
        interval=constraints.bad_intervals(versions),
        version_no_unique=constraints.duplicates(versions, "section_key", "version_no"),
        version_id_unique=constraints.duplicates(versions, "version_id"),
        content_unique=constraints.duplicates(documents, "content_hash"),
        kind_known=constraints.outside(documents, "kind", KINDS),
        document_exists=constraints.orphans(versions, "document_id", documents if sources is None else sources, "doc_id"),
        superseded_exists=constraints.orphans(versions, "supersedes", versions, "version_id"),
    )


def refolded(versions: DataFrame, log: DataFrame, new: DataFrame, buckets: int = 64) -> DataFrame:
    """``versions`` of the clauses ``log`` brought up to date with the clauses ``new``.

    Sections fall into ``buckets`` by hash; those that ``new`` touches are folded from their whole
    log, the versions of all others stay as they are and are not read beyond their key.
    """
    touched = [r[0] for r in new.select(bucket(F.col("section_key"), buckets)).distinct().collect()]
    hit = bucket(F.col("section_key"), buckets).isin(touched)
    return versions.where(~hit).unionByName(rebuild_versions(log.where(hit).unionByName(new)))


@dataclass(frozen=True)
class Prepared:
    """An ingest that is written and checked but not committed."""

    base: Manifest
    next: Manifest
    folder: str
    new: int


def prepare(spark: SparkSession, documents: DataFrame, store: str, buckets: int = 64) -> Prepared | None:
    """Write what ``documents`` change into a folder of its own and check it; None if all of them are in the store.

    Contents are looked up in the hash parts that the new ones fall into.  Constraints are checked on
    the folded buckets and those parts: sections never meet across buckets, and what the rest of
    the store refers to was checked when it came.  An offence is a ``ValueError``.
    """
    base = latest(spark, store, buckets)
    own = f"commit-{base.number + 1:08d}-{uuid.uuid4().hex}"
    path = f"{store}/{own}"
    part = F.pmod(F.xxhash64("content_hash"), F.lit(base.buckets)).cast("int").alias("part")
    given = documents.drop("error").dropDuplicates(["content_hash"]).withColumn("part", part)
    held = None
    if base.documents:
        parts = [r[0] for r in given.select("part").distinct().collect()]
        held = _tables(spark, store, base.documents).where(F.col("part").isin(parts))
        given = given.join(held.select("content_hash"), "content_hash", "left_anti")
    try:
        given.write.partitionBy("part").parquet(f"{path}/documents")
        new = spark.read.schema(given.schema).parquet(f"{path}/documents")
        count = new.count()
        if not count:
            files.delete(spark, path)
            return None
        keyed = clause_log(new).withColumn("bucket", bucket(F.col("section_key"), base.buckets))
        keyed.write.partitionBy("bucket").parquet(f"{path}/log")
        touched = sorted(int(n.split("=")[1]) for n in files.names(spark, f"{path}/log") if n.startswith("bucket="))
        log = _tables(spark, store, (*base.log, f"{own}/log")).where(F.col("bucket").isin(touched))
        folded = rebuild_versions(log.drop("bucket"), HOT).withColumn("bucket", bucket(F.col("section_key"), base.buckets))
        folded.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{path}/versions")
        now = spark.read.schema(folded.schema).parquet(f"{path}/versions")
        before = [base.versions[str(b)] for b in touched if str(b) in base.versions]
        sources = new.select("doc_id")
        if before:
            sources = sources.unionByName(_tables(spark, store, before).select(F.col("document_id").alias("doc_id")))
        documents_now = new if held is None else new.unionByName(held.select(*new.columns))
        broken = [f"{r['constraint_name']} ({r['violations']})" for r in violations(now, documents_now, sources, HOT).where("violations > 0").collect()]
        if broken:
            raise ValueError("the documents would break: " + ", ".join(sorted(broken)))
        made = {n.split("=")[1]: f"{own}/versions/{n}" for n in files.names(spark, f"{path}/versions") if n.startswith("bucket=")}
    except BaseException:
        files.delete(spark, path)
        raise
    following = Manifest(base.number + 1, base.buckets, (*base.documents, f"{own}/documents"), (*base.log, f"{own}/log"), base.versions | made)
    return Prepared(base, following, own, count)


def commit(spark: SparkSession, store: str, prepared: Prepared, keep: int = 8) -> None:
    """Make ``prepared`` the store's state, or raise ``StaleStore`` if it is no longer the next one.

    Folders that none of the last ``keep`` manifests names are deleted, older manifests too.
    """
    name = f"{store}/manifests/{prepared.next.number:08d}.json"
    text = json.dumps(prepared.next.__dict__, indent=1)
    if latest(spark, store).number != prepared.base.number or not files.create_text(spark, name, text):
        files.delete(spark, f"{store}/{prepared.folder}")
        raise StaleStore(f"{store} is past number {prepared.base.number}")
    vacuum(spark, store, keep)


def vacuum(spark: SparkSession, store: str, keep: int = 8) -> None:
    """Delete manifests before the last ``keep``, and the folders of their commits that no kept one names."""
    found = [n for n in files.names(spark, f"{store}/manifests") if n.endswith(".json") and not n.startswith(".")]
    old, kept = found[:-keep], found[-keep:]
    if not old:
        return
    read = lambda n: json.loads(files.read_text(spark, f"{store}/manifests/{n}"))
    named = lambda m: {p.split("/")[0] + "/" + p.split("/")[1] for p in (*m["documents"], *m["log"])} | set(m["versions"].values())
    needed = set().union(*(named(read(n)) for n in kept))
    for n in old:
        for gone in named(read(n)) - needed:
            files.delete(spark, f"{store}/{gone}")
        files.delete(spark, f"{store}/manifests/{n}")


def ingest(spark: SparkSession, documents: DataFrame, store: str, *, buckets: int = 64, retries: int = 0) -> int:
    """Add ``documents`` to the store and return how many were new.

    A document whose content is in the store, or comes twice, is taken once.  Only the buckets of
    sections that it touches are folded and written; everything is checked before the commit, and an
    offence is a ``ValueError`` that leaves the store as it was.  If another writer commits in
    between, the work is done again up to ``retries`` times, then ``StaleStore`` is raised.
    """
    for left in range(retries, -1, -1):
        prepared = prepare(spark, documents, store, buckets)
        if prepared is None:
            return 0
        try:
            commit(spark, store, prepared)
            return prepared.new
        except StaleStore:
            if not left:
                raise
    return 0


def _tables(spark: SparkSession, store: str, paths: tuple[str, ...] | list[str]) -> DataFrame:
    """Tables of equal columns, each with its own partition folders."""
    out = None
    for p in paths:
        one = spark.read.parquet(f"{store}/{p}")
        out = one if out is None else out.unionByName(one)
    return out


def documents_of(spark: SparkSession, store: str) -> DataFrame:
    """The documents of the store's state."""
    return _tables(spark, store, _ingested(spark, store).documents).drop("part")


def versions_of(spark: SparkSession, store: str) -> DataFrame:
    """The versions of the store's state."""
    m = _ingested(spark, store)
    return spark.read.parquet(*(f"{store}/{p}" for p in m.versions.values()))


def _ingested(spark: SparkSession, store: str) -> Manifest:
    m = latest(spark, store)
    if not m.number:
        raise ValueError(f"nothing has been ingested into {store}")
    return m
