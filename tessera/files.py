"""Files and folders through Hadoop's file systems, so that a path may be on any of them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_file(spark: SparkSession, path: str) -> bool:
    _, fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def is_folder(spark: SparkSession, path: str) -> bool:
    _, fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    _, fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []


def below(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``(relative path, bytes)`` of all files under a folder."""
    if os.path.isdir(path):  # on this machine: no call to the JVM for each file
        each = ((os.path.join(at, n), os.path.relpath(os.path.join(at, n), path)) for at, _, found in os.walk(path) for n in found)
        return [(rel.replace(os.sep, "/"), os.path.getsize(full)) for full, rel in each]
    _, fs, p = _at(spark, path)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        s = it.next()
        out.append((s.getPath().toUri().getPath().removeprefix(base), s.getLen()))
    return out


def read(spark: SparkSession, path: str) -> str:
    jvm, fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    _, fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    _, fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    jvm, fs, p = _at(spark, old)
    if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{old} can't be renamed to {new}")
