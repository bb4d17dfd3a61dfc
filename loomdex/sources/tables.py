"""Readers of the engine's own Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of a single file that is spread over the cores: below, one task has done it sooner; above, its row groups are splits enough.
SPREAD = (256 << 10, 64 << 20)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the engine. A small table in one file is one task's work however many cores wait, so it is spread by a shuffle of that small file,
    which column pruning and filters pass. A table in a folder of files, as all large ones are, is read as it is."""
    at = f"{root}/{name}.parquet"
    df = spark.read.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.isFile() and SPREAD[0] <= status.getLen() < SPREAD[1]:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def children(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Rows of chunks that are no parents. Repeated rows of one chunk_id are kept: callers fold them where it is cheap."""
    return table(spark, root, "chunks").where(~F.col("is_parent")).select(*columns)
