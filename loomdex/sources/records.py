"""JSON records around the tables: the cache of pseudo-documents, evaluation cases, error logs, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "query string, doc string, ts bigint"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, ts) of a JSON-lines cache: lines that can't be read are skipped, of one query the row of the greatest ts stays."""
    rows = spark.read.schema(CACHE).option("mode", "DROPMALFORMED").json(path).where("query is not null")
    return rows.groupBy("query").agg(F.max_by(F.struct("doc", "ts"), F.struct("ts", "doc")).alias("x")).select("query", "x.doc", "x.ts")


def write_cache(cache: DataFrame, path: str) -> None:
    """Replace the cache as a whole. The new one is complete before the old one is moved aside, and that is deleted last: a crash leaves one of them to ``read_cache``'s path or beside it."""
    spark = cache.sparkSession
    mark = uuid.uuid4().hex
    staged, old = f"{path}.{mark}", f"{path}.{mark}.old"
    cache.select("query", "doc", "ts").write.json(staged)
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_class(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(path_class(path))
    if had and not fs.rename(path_class(path), path_class(old)):
        raise RuntimeError(f"{path} could not be moved")
    if not fs.rename(path_class(staged), path_class(path)):
        fs.rename(path_class(old), path_class(path))
        raise RuntimeError(f"{path} could not be replaced")
    if had:
        fs.delete(path_class(old), True)


def clear_cache(spark: SparkSession, path: str) -> None:
    write_cache(spark.createDataFrame([], CACHE), path)


def cache_stats(cache: DataFrame) -> DataFrame:
    """(n, n_empty, oldest, newest) of a cache."""
    return cache.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("doc", F.lit("")) == "").alias("n_empty"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def write_report(rates: DataFrame, path: str) -> None:
    """Rates of an evaluation as one JSON line for each group."""
    rates.coalesce(1).write.mode("overwrite").json(path)


def missing_columns(table: DataFrame, needed: list[str]) -> list[str]:
    return [c for c in needed if c not in table.columns]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, category, difficulty, ground_truth_file) of a JSON object with an array ``cases``; the older name of the last field is read too."""
    case = "struct<id:string,question:string,category:string,difficulty:string,ground_truth_file:array<string>,ground_truth_doc:array<string>>"
    rows = spark.read.schema(f"cases array<{case}>").option("multiLine", True).json(path).select(F.explode("cases").alias("c")).select("c.*")
    return rows.withColumn("ground_truth_file", F.coalesce("ground_truth_file", "ground_truth_doc")).drop("ground_truth_doc")


def append_errors(errors: DataFrame, path: str) -> None:
    """One JSON line {ts, file, error} for each failed file (file_path, error_msg)."""
    errors.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("file_path").alias("file"), F.col("error_msg").alias("error")).write.mode("append").json(path)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON, one folder for each document."""
    chunks.write.mode("overwrite").partitionBy("doc_id").json(path)


def lookup(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a table by ids; unknown ids give none."""
    return table.join(ids.select(key).distinct(), key, "left_semi")
