"""Per-document rules on documents that keep arriving.

The rules look at one document at a time, so they run on a stream as they are, without
state.  Reference rules need a whole pack and stay a batch job over the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators.rules import with_file_errors
from packloom.schemas import DOCS_DDL


def read_docs(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(DOCS_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def file_errors(docs: DataFrame) -> DataFrame:
    return with_file_errors(docs).select("pack", "rel", F.explode("file_errors").alias("message"))


def write_errors(errors: DataFrame, path: str, checkpoint: str):
    """Append error rows as Parquet, each document's once, also after a restart."""
    return errors.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
