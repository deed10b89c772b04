"""Small files and folders in whatever store Spark reads: found, read line by line, written whole, renamed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system of ``path``, the path as it knows it)."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that match a path or a pattern, in order of their paths."""
    fs, place = _system(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(place) or [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _system(spark, path)
    return fs.exists(place)


def lines(spark: SparkSession, path: str) -> Iterator[str]:
    """Lines of a UTF-8 text, without a byte-order mark; what isn't asked for isn't read."""
    fs, place = _system(spark, path)
    jvm = spark.sparkContext._jvm
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(place), "UTF-8"))
    try:
        first = True
        while (line := reader.readLine()) is not None:
            yield line.removeprefix("﻿") if first else line
            first = False
    finally:
        reader.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """``text`` under ``path``, in place of what is there; written beside it first, so a reader finds the old text or the new one."""
    draft = f"{path}._draft"
    fs, place = _system(spark, draft)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    replace(spark, draft, path)


def replace(spark: SparkSession, draft: str, path: str) -> None:
    """Renames a file over another in one step."""
    sc = spark.sparkContext
    at = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), sc._jsc.hadoopConfiguration()) if at(path).toUri().getScheme() else sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(sc._jsc.hadoopConfiguration())
    over = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(at(draft), at(path), over)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes ``text`` under ``path`` unless something is there; whether it did.  Of two writers one succeeds."""
    draft = f"{path}._draft-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    fs, place = _system(spark, draft)
    out = fs.create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    sc = spark.sparkContext
    at = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), sc._jsc.hadoopConfiguration()) if at(path).toUri().getScheme() else sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(sc._jsc.hadoopConfiguration())
    try:
        context.rename(at(draft), at(path), sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:  # noqa: BLE001  whatever class the store throws
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(place, False)
        return False
    return True
