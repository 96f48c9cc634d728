"""Small files in whatever store Spark writes to, through its own file system interface."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, at, fs = _fs(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _put(jvm, fs, at, text: str, overwrite: bool) -> None:
    stream = fs.create(at, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


_one = threading.Lock()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that isn't there yet, and whole: it is written beside and renamed, which fails if it is there. Of two
    writers one has True and the other False."""
    jvm, at, fs = _fs(spark, path)
    at = fs.makeQualified(at)
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}.tmp")
    _put(jvm, fs, beside, text, True)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        with _one:  # on a local disk the check and the renaming are two steps
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, none)
        return True
    except Py4JJavaError as e:
        fs.delete(beside, False)
        kind = e.java_exception.getClass().getSimpleName()
        if kind == "FileAlreadyExistsException":
            return False
        if kind != "UnsupportedFileSystemException":
            raise
    try:  # a store without renaming of that kind, in which creating is exclusive
        _put(jvm, fs, at, text, False)
        return True
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool, float]]:
    """Name, whether it is a directory, and the time of the last change in seconds, of what is in a directory; nothing if
    there is none."""
    _, at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    return sorted((s.getPath().getName(), s.isDirectory(), s.getModificationTime() / 1000) for s in fs.listStatus(at))


def write_lines(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Writes one file from parts, as they come."""
    _, at, fs = _fs(spark, path)
    stream = fs.create(at, True)
    held, size = [], 0
    try:
        for part in parts:
            held.append(part)
            size += len(part)
            if size > 1 << 20:
                stream.write(bytearray("".join(held).encode()))
                held, size = [], 0
        stream.write(bytearray("".join(held).encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    _, at, fs = _fs(spark, path)
    fs.delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    _, at, fs = _fs(spark, path)
    return fs.getContentSummary(at).getLength()
