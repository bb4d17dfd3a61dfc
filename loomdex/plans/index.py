"""Incremental indexing: files to chunks and vectors, by what the manifest lacks."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.config import DEFAULT, Settings
from loomdex.operators import chunking, incremental, postings, store
from loomdex.operators.embedding import embed
from loomdex.session import cut
from loomdex.sources import files as source
from loomdex.sources.records import append_errors

MANIFEST = "file_path string, file_hash string, size bigint, mtime double, ext string, chunk_count int, status string, error_msg string, indexed_at double"


EVENT = "file_path string, file_hash string, shard int, seq bigint"
SHARDS = 16


@dataclass
class Index:
    """The tables below one folder. All are in buckets by file, so a run writes the buckets of the files that it touches."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def __post_init__(self) -> None:
        table = lambda name, schema: store.Table(self.spark, f"{self.root}/{name}", schema, "file_path", self.buckets)
        self.chunks = table("chunks", chunking.CHUNK)
        self.vectors = table("vectors", "id string, v array<float>, file_path string")
        self.postings = table("postings", postings.POSTING)
        self.lengths = table("lengths", postings.LENGTH)
        self.manifest = table("manifest", MANIFEST)
        self.events = table("events", EVENT)
        self.log = incremental.IntervalLog(self.spark, f"{self.root}/log")


def numbered_events(index: Index, listed: DataFrame) -> DataFrame:
    """(file_path, file_hash, shard, seq): what is there. A file whose bytes are as at the last run keeps its number; a new or changed one gets the next of its shard."""
    known = listed.join(index.events.read().withColumnRenamed("file_hash", "known_hash"), "file_path", "left")
    same = known.where("known_hash = file_hash").select("file_path", "file_hash", "shard", "seq")
    new = known.where("known_hash is null or known_hash <> file_hash").select("file_path", "file_hash")
    used = index.log.processed().select("shard", F.col("hi").alias("seq")).unionByName(index.events.read().select("shard", "seq")).groupBy("shard").agg(F.max("seq").alias("top"))
    made = incremental.numbered(new, "file_path", [F.col("file_path")], SHARDS).join(F.broadcast(used), "shard", "left")  # a row for each shard
    made = cut(made.select("file_path", "file_hash", "shard", (F.col("seq") + F.coalesce("top", F.lit(0))).alias("seq")))
    if not made.isEmpty():
        index.events.upsert(made, "file_path")
    return cut(same.unionByName(made))


def run(index: Index, roots: list[str], settings: Settings = DEFAULT, provider: str = "hash", dim: int = 64, force: bool = False, limit: int | None = None, tell: Callable[[str], None] | None = None) -> dict[str, int]:
    """Index what is new or changed, retry what failed, remove what vanished. The counts of each.

    Every change of a file has a number; the log holds the intervals of those that are indexed, and a run works on the gaps. Removals come from the whole scan, whatever
    ``limit`` says; files over the allowed size are counted as too_large and keep what is indexed of them. The tables are replaced first, then the manifest, the log last: a run
    that dies between is done again by the next, which replaces the same files' rows. A file that can't be parsed keeps its old chunks, is noted with its
    error in the manifest and the error log, and stays a gap."""
    tell = tell or (lambda said: None)
    every = cut(source.scan(index.spark, roots, settings, any_size=True).select("file_path", "size", "mtime", "ext"))
    listed = cut(source.hashed(source.scan(index.spark, roots, settings)).select("file_path", "file_hash", "size", "mtime", "ext"))
    events = numbered_events(index, listed.select("file_path", "file_hash"))
    wanted = (events if force else incremental.inside(events, index.log.gaps(events))).select("file_path")
    if limit is not None:
        wanted = wanted.orderBy("file_path").limit(limit)
    wanted = cut(wanted)
    tell(f"{every.count()} files, {wanted.count()} to index")
    work = listed.join(wanted, "file_path", "left_semi")
    parsed = cut(source.parse(source.contents(index.spark, roots, wanted, settings)))
    failed = parsed.where("error is not null").select(F.col("doc").alias("file_path"), F.substring("error", 1, 500).alias("error_msg"))
    made = chunking.split_documents(parsed.where("error is null").drop("error"), created_at=time.strftime("%Y-%m-%dT%H:%M:%S"), settings=settings)
    hashes = work.select("file_path", F.col("file_hash").alias("h"))
    chunks = cut(made.join(hashes, "file_path").withColumn("file_hash", F.col("h")).withColumn("doc_id", F.substring("h", 1, 16)).drop("h"))
    before = index.manifest.read()
    gone = cut(incremental.vanished_files(every, before))
    done = cut(work.join(failed, "file_path", "left_anti"))
    touched = cut(done.select("file_path").unionByName(gone).distinct())
    counts = chunks.groupBy("file_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    now = time.time()
    rows = store.marked_done(done.join(counts, "file_path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), now).unionByName(store.marked_error(failed.join(hashes.withColumnRenamed("h", "file_hash"), "file_path"), now))
    rows = cut(rows)
    known = before.where("status = 'done'").select("file_path")
    tell(f"{rows.count()} parsed and split, {gone.count()} vanished")
    report = {
        "new": rows.where("status = 'done'").join(known, "file_path", "left_anti").count(),
        "updated": rows.where("status = 'done'").join(known, "file_path", "left_semi").count(),
        "failed": rows.where("status = 'error'").count(),
        "removed": gone.count(),
        "skipped": listed.count() - rows.count(),
        "too_large": every.count() - listed.count(),
    }
    if not touched.isEmpty():
        kids = chunks.where("not is_parent")
        index.chunks.replace_groups(touched, chunks)
        index.vectors.replace_groups(touched, kids.select(F.col("chunk_id").alias("id"), embed(F.col("content"), provider, dim=dim).alias("v"), "file_path"))
        analysed = postings.analysed(kids.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), "file_path"), "file_path")
        index.postings.replace_groups(touched, postings.postings(analysed, "file_path"))
        index.lengths.replace_groups(touched, postings.lengths(analysed, "file_path"))
    if not (rows.isEmpty() and gone.isEmpty()):
        keys = rows.select("file_path").unionByName(gone)
        index.manifest.replace_groups(keys.distinct(), rows)
    if not gone.isEmpty():
        index.events.delete(gone, "file_path")
    if report["failed"]:
        append_errors(failed, f"{index.root}/errors")
    if not done.isEmpty():
        index.log.adopt(events.join(done, "file_path", "left_semi").select("shard", "seq"))
    return report
