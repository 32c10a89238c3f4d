"""Tables that cut lineage and survive lost executors.

Intermediate results go as Parquet to the shared folder that the cluster names in ``spark.checkpoint.dir``; any executor can
read them again. Each table has a folder of its own, removed when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes an execution's shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder; Hadoop deletes it when the application ends."""
    path = f"{shared_root(spark)}/lodestone-{uuid.uuid4().hex}/{label}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: same rows, no lineage.

    What was shuffled to make it is deleted as soon as the table stands; nothing reads that again.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later result needs."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables on the way to a result. ``drop`` removes those that were read for the last time, leaving the block removes the rest.

    What leaves the block must be ``written`` apart from these.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(written(df, label))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(t)
        self.tables = [x for x in self.tables if not any(x is t for t in tables)]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.tables)
