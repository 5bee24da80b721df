"""Files through Hadoop's file system API, so that any storage Spark can write to serves."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has taken the version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create_json(spark: SparkSession, path: str, value: object) -> None:
    """Write ``value`` to ``path`` if nothing is there; the file appears whole or not at all.

    The text goes to a hidden file first and is renamed without overwriting, which fails for all writers but one.
    """
    import uuid

    jvm, p, fs = _fs(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(json.dumps(value), "utf-8"))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(hidden, p, none)
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise CommitConflict(path) from None
        raise


def read_json(spark: SparkSession, path: str) -> object:
    jvm, p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def walk(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, modified ms)`` of every file below ``path``."""
    _, p, fs = _fs(spark, path)
    out: list[tuple[str, int, int]] = []
    if not fs.exists(p):
        return out
    it = fs.listFiles(p, True)
    while it.hasNext():
        x = it.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return out


def delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.mkdirs(p)
