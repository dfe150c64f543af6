"""Storage that driver and executors share: where lineage is cut and tables are put between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A local session without one gets a temporary folder of its own; on a cluster that
    would be a folder nobody else can read, so an error is raised instead.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for small tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Spark's setting by which a query's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, codec: str = "snappy", clean: bool = False) -> DataFrame:
    """Written as Parquet in the shared folder and read again: compressed, and later reads take only their columns.

    ``clean``: the write's own shuffle files go when it has ended, not only when their plan is forgotten.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    write = df.write.option("compression", codec)
    if clean:
        was = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            write.parquet(path)
        finally:
            spark.conf.set(CLEANUP, was)
    else:
        write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
