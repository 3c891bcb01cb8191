"""What the training-data operators share: words, row hashes and tables kept in the shared folder.

A *word* is a maximal run of characters other than space, tab, line feed, vertical tab, form feed
and carriage return: ``[^\\x20\\x09-\\x0D]+``.  On UTF-8 bytes that is exactly ``bytes.split()``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_dir: list[str] = []
#: Paths of the tables kept outside any ``scratch`` block, and those of the block that the running code is in.
_outside: list[str] = []
_scope: ContextVar[list[str]] = ContextVar("tidemark_scratch", default=_outside)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session may leave it unset; it then gets a temporary folder, because driver
    and executor are one process there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_dir:
        tmp = tempfile.TemporaryDirectory(prefix="tidemark-")
        atexit.register(tmp.cleanup)
        _local_dir.append(tmp.name)
    return _local_dir[0]


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    It cuts lineage as ``checkpoint()`` does, but stays columnar and compressed, and survives the
    loss of any executor.  ``scratch`` and ``release`` remove such tables once their results are consumed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scope.get().append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._kept_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` returned, before their scope ends: nothing that is still to run may read them."""
    for table in tables:
        delete(table.sparkSession, table._kept_path)
        for paths in (_scope.get(), _outside):
            if table._kept_path in paths:
                paths.remove(table._kept_path)


def release(spark: SparkSession) -> None:
    """Delete the tables ``kept`` has written in the present scope; call it after the last result was consumed."""
    paths = _scope.get()
    while paths:
        delete(spark, paths.pop())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies; a missing one is fine."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Release what is kept inside the block when it ends, also by an error.

    The block has a list of its own, seen by its thread only: tables kept before it, around it or by
    another thread stay.
    """
    token = _scope.set([])
    try:
        yield
    finally:
        release(spark)
        _scope.reset(token)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_case(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null value counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def binary_text(col: str = "text") -> Column:
    """Text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows and fail beyond: the size check before any broadcast."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows
