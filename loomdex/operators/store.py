"""Chunk, vector and manifest tables: keyed upserts, deletes, migration, atomic replacement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.operators.commits import Commits

# Columns that older tables lack or name otherwise.
RENAMED = {"page_number": "page_start", "heading_path": "section_path"}
ADDED = {
    "page_start": "int", "page_end": "int", "section_path": "string", "doc_id": "string", "doc_title": "string", "chunk_type": "string", "parent_chunk_id": "string",
    "is_parent": "boolean", "language": "string", "created_at": "string", "has_code": "boolean", "has_warning": "boolean",
}


def latest_rows(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) if isinstance(c, str) else c for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the rows of ``changes`` in place of those with their keys; changes have one row for each key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows of these keys. Rows of a null key stay."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def migrated(table: DataFrame) -> DataFrame:
    """A table of any older layout with today's names and all columns; sentinels of -1 become null."""
    for old, new in RENAMED.items():
        if old in table.columns and new not in table.columns:
            table = table.withColumnRenamed(old, new)
    for name, kind in ADDED.items():
        if name not in table.columns:
            table = table.withColumn(name, F.lit(None).cast(kind))
    for c in ("page_start", "page_end"):
        table = table.withColumn(c, F.nullif(F.col(c), F.lit(-1)))
    return table


def marked_done(files: DataFrame, at: float) -> DataFrame:
    """Manifest rows of files (file_path, file_hash, size, mtime, ext, chunk_count) that are indexed."""
    return files.select("file_path", "file_hash", "size", "mtime", "ext", "chunk_count", F.lit("done").alias("status"), F.lit("").alias("error_msg"), F.lit(at).alias("indexed_at"))


def marked_error(files: DataFrame, at: float) -> DataFrame:
    """Manifest rows of files (file_path, file_hash, error_msg) that failed: size and mtime 0, no chunks."""
    zero = {"size": "bigint", "mtime": "double", "chunk_count": "int"}
    return files.select("file_path", "file_hash", *[F.lit(0).cast(t).alias(c) for c, t in zero.items()], F.lit("").alias("ext"), F.lit("error").alias("status"), "error_msg", F.lit(at).alias("indexed_at")).select(
        "file_path", "file_hash", "size", "mtime", "ext", "chunk_count", "status", "error_msg", "indexed_at"
    )


class Table:
    """A Parquet table in buckets by a hash of the column ``by``. A version is a commit that names the folder of each bucket; an upsert or delete by that column
    writes the touched buckets alone, one by any other column writes all."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str | None = None, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.by = by or schema.split()[0]
        self.commits = Commits(spark, self.path)

    def version(self) -> int:
        return self.commits.last()

    def _where(self, n: int) -> dict[str, str]:
        return self.commits.read(n)["buckets"] if n else {}

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(list(self._where(self.version()).values()))

    def _bucket(self):
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _commit(self, n: int, kept: dict[str, str], rows: DataFrame) -> int:
        at = self.commits.folder()
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names).withColumn("__bucket", self._bucket()).repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{at}")
        there = self.commits._path(f"{self.path}/{at}")
        made = [s.getPath().getName() for s in self.commits._fs.listStatus(there) if s.isDirectory()]
        self.commits.claim(n + 1, {"buckets": kept | {d.split("=")[1]: f"{at}/{d}" for d in made if "=" in d}})
        return n + 1

    def replace(self, rows: DataFrame) -> int:
        """Write all buckets; readers see the old version until it is complete. The number of the new version."""
        return self._commit(self.version(), {}, rows)

    def _change(self, keys: DataFrame, key: str, changed: Callable[[DataFrame], DataFrame]) -> int:
        n = self.version()
        where = self._where(n)
        touched = set(where)
        if key == self.by:
            touched = {str(r[0]) for r in keys.select(self._bucket()).distinct().collect()}  # at most the number of buckets
        old = self._rows([f for b, f in where.items() if b in touched])
        return self._commit(n, {b: f for b, f in where.items() if b not in touched}, changed(old))

    def upsert(self, changes: DataFrame, key: str) -> int:
        return self._change(changes, key, lambda old: upserted(old, changes, key))

    def delete(self, keys: DataFrame, key: str) -> int:
        return self._change(keys, key, lambda old: without(old, keys, key))

    def replace_groups(self, keys: DataFrame, rows: DataFrame) -> int:
        """All rows of the keys (of the column ``by``) are replaced by ``rows``, which may have any number for a key, in one version."""
        return self._change(keys, self.by, lambda old: without(old, keys, self.by).unionByName(rows, allowMissingColumns=True))

    def truncate(self) -> int:
        return self.replace(self.spark.createDataFrame([], self.schema))
