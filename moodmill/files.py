"""Small file-system steps over whatever store Spark's paths name."""

from __future__ import annotations

from typing import Any

from pyspark.errors.exceptions.captured import convert_exception
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, milliseconds of the last change) of what a folder holds, in name order; none if it does not exist."""
    fs = _fs(spark, path)
    if not fs.exists(_path(spark, path)):
        return []
    found = fs.listStatus(_path(spark, path))
    return sorted((f.getPath().getName(), f.getModificationTime()) for f in found)


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place as a whole, or return False if there is one already.

    It is written beside its place and renamed, which fails if another writer
    was first; a crash leaves at most a hidden leftover that nobody reads.
    """
    jvm, folder, name = spark._jvm, *path.rsplit("/", 1)
    draft = f"{folder}/.{name}.{jvm.java.util.UUID.randomUUID()}"
    stream = _fs(spark, path).create(_path(spark, draft), True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, draft), _path(spark, path), options)
    except Py4JJavaError as e:
        delete(spark, draft)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise convert_exception(e.java_exception) from e
    return True
