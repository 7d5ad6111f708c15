"""Names of folders and files in the store that all executors share, by the file system Spark itself uses for the path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, hidden ones left out; a missing folder is an empty one."""
    fs, place = _at(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(n for n in found if not n.startswith((".", "_")))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, place = _at(spark, path)
    return fs.getContentSummary(place).getLength()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder or file with all it holds, if it exists."""
    fs, place = _at(spark, path)
    fs.delete(place, True)


def copy(spark: SparkSession, path: str, target: str) -> None:
    """Copy a file."""
    fs, place = _at(spark, path)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, place, *_at(spark, target), False, spark._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file. It is there or not, never in part, so it can commit what was written before."""
    fs, place = _at(spark, path)
    fs.create(place, True).close()


def set_time(spark: SparkSession, path: str, millis: int) -> None:
    """Set the time of a file's last change, by which a stream takes up files."""
    fs, place = _at(spark, path)
    fs.setTimes(place, millis, -1)
