"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None
) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own.

    Intermediate tables go to ``checkpoint_dir``, by default a new temporary folder.
    """
    checkpoint_dir = checkpoint_dir or tempfile.mkdtemp(prefix="pitchframe-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitchframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", checkpoint_dir)
        .getOrCreate()
    )


def _folder_of(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach: ``spark.checkpoint.dir``."""
    folder = _folder_of(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle_if_shared(df: DataFrame) -> DataFrame:
    """``settle`` a step that several later ones read, where there is a shared folder; else leave it to the plan."""
    return settle(df, None) if _folder_of(df.sparkSession) else df


def settle(df: DataFrame, by: str | None = "season", dealt: bool = True) -> DataFrame:
    """Write a frame that is read many times (model training) and return it re-read.

    It lands as Parquet in the shared folder, in folders by ``by``, so later reads prune
    columns and folders and a lost executor costs a re-read and not a recomputation.
    Adaptive execution cuts large folders and joins small ones (``REBALANCE``).  Without
    ``by`` the parts stay as they are.  Without ``dealt`` every task writes a file in each folder
    it has rows of, which saves the shuffle.
    """
    spark = df.sparkSession
    path = new_folder(spark, "settled")
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    (df.hint("rebalance", by) if dealt else df).write.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
