"""Datasets that are replaced as a whole: readers keep the old version until the new one is committed.

A dataset is a folder of versions, ``v00000001`` and so on, each a Parquet table.  A version
exists for readers once the empty file ``committed`` lies in it; creating that file is the
only step that changes what they see.  So a dataset can be read, enriched and written back
under one name, and a run that fails leaves the version before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

MARK = "committed"


def _system(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """(all versions begun, those committed), in order."""
    system, there = _system(spark, path)
    if not system.exists(there):
        return [], []
    names = [f.getPath().getName() for f in system.listStatus(there) if f.isDirectory()]
    begun = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    marked = [n for n in begun if system.exists(_system(spark, f"{version_path(path, n)}/{MARK}")[1])]
    return begun, marked


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:08d}"


def current_version(spark: SparkSession, path: str) -> int | None:
    """The last committed version, or None."""
    return max(_versions(spark, path)[1], default=None)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version of the dataset, by default the last."""
    _, committed = _versions(spark, path)
    version = max(committed, default=None) if version is None else version
    if version not in committed:
        raise ValueError(f"{path} has no committed version{'' if version is None else f' {version}'}")
    return spark.read.parquet(f"{version_path(path, version)}/data")


def write_version(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> int:
    """Write ``df`` as the next version and commit it; return its number.

    ``df`` may read the dataset itself.  Of two writers at a time the second fails: a
    version's folder can be begun once.
    """
    spark = df.sparkSession
    version = max(_versions(spark, path)[0], default=0) + 1
    folder = version_path(path, version)
    system, begun = _system(spark, f"{folder}/begun")
    system.create(begun, False).close()
    df.write.partitionBy(*partition_by).parquet(f"{folder}/data")
    system.create(_system(spark, f"{folder}/{MARK}")[1], False).close()
    return version


def replace_dataset(
    spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], partition_by: Iterable[str] = ()
) -> DataFrame:
    """Write ``change`` of the current version as the next one; return it, re-read."""
    return read_version(spark, path, write_version(change(read_version(spark, path)), path, partition_by))


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the last ``keep`` committed versions, and what was begun before them without an end.

    Return the versions deleted.  Readers of those must be done.
    """
    begun, committed = _versions(spark, path)
    kept = committed[-max(1, keep) :]
    old = [n for n in begun if kept and n < kept[0]]
    for version in old:
        system, folder = _system(spark, version_path(path, version))
        system.delete(folder, True)
    return old
