"""Small files of a store on whatever file system Spark has: listed, read, written, renamed, deleted."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; a missing folder is empty."""
    fs, path = _system(spark, folder), _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole or not at all; False, and nothing changed, if there is one of that name already.

    The text goes to a file of its own, which is renamed without overwriting: of several writers one wins.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    folder, _, name = path.rpartition("/")
    fs, temporary = _system(spark, path), _path(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    fs.mkdirs(_path(spark, folder))
    out = fs.create(temporary)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(temporary, _path(spark, path), options)
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; a missing one is fine."""
    _system(spark, path).delete(_path(spark, path), True)
