"""Small metadata files and pointers on whatever file system Spark reads, through Hadoop's API."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, where, fs = _context(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    _, where, fs = _context(spark, path)
    return fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    _, where, fs = _context(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def size(spark: SparkSession, path: str) -> int:
    _, where, fs = _context(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def head(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of a file, or of the first file of a folder."""
    jvm, where, fs = _context(spark, path)
    if fs.getFileStatus(where).isDirectory():
        inner = [s.getPath() for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", "."))]
        where = sorted(inner, key=lambda p: p.getName())[0]
    stream = fs.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, fs.getFileStatus(where).getLen())))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Written beside and renamed over the old file, so that a reader sees one or the other."""
    jvm, where, fs = _context(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(beside), fs.makeQualified(where), options)


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """A file that was not there before, whole or not at all; False if there is one."""
    import uuid

    from py4j.protocol import Py4JJavaError

    jvm, where, fs = _context(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(where), spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError:
        fs.delete(beside, False)
        if fs.exists(where):
            return False
        raise


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(head(spark, path, 1 << 30)) if exists(spark, path) else None


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_bytes(spark, path, json.dumps(value, indent=1, sort_keys=True).encode())


def merge(spark: SparkSession, folder: str, target: str, first: bytes = b"") -> None:
    """The part files of ``folder`` one after another in one file, behind ``first``; copied as streams."""
    jvm, where, fs = _context(spark, folder)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(target), True)
    try:
        out.write(bytearray(first))
        for part in sorted((s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            stream = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
    finally:
        out.close()
