"""Processing only what is new or changed, without skips or repeats when runs fail.

Every record has a sequence number inside a shard, which it keeps. What has been processed is stored as disjoint intervals of sequence numbers for
each shard; what is there is a set of ranges; a run subtracts the former from the latter and processes the gaps, among them
late commits that fell into ranges already passed. Output and merged intervals become visible together, by the one file of a
commit, so a run that dies leaves no trace and the next one finds the same gaps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.operators.commits import Commits
from loomdex.session import checkpoint_dir, cut

INTERVAL = "shard int, lo bigint, hi bigint"


def intervals(numbers: DataFrame) -> DataFrame:
    """(shard, seq) to disjoint, non-adjacent intervals (shard, lo, hi). Repeats and order don't matter; nulls are ignored."""
    w = Window.partitionBy("shard").orderBy("seq")
    distinct = numbers.select(F.col("shard").cast("int").alias("shard"), F.col("seq").cast("bigint").alias("seq")).where("shard is not null and seq is not null").distinct()
    return distinct.select("shard", "seq", (F.col("seq") - F.row_number().over(w)).alias("run")).groupBy("shard", "run").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("run")


def merge(*parts: DataFrame) -> DataFrame:
    """The union of sets of intervals as disjoint, non-adjacent intervals; overlapping, touching and repeated ones are merged."""
    every = parts[0].select("shard", "lo", "hi")
    for p in parts[1:]:
        every = every.unionByName(p.select("shard", "lo", "hi"))
    w = Window.partitionBy("shard").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = every.withColumn("opens", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    numbered = opens.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("shard", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """The parts of ``available`` that no interval of ``processed`` covers, as disjoint, non-adjacent intervals. Either set may overlap itself.

    A sweep over the ends of both sets, in one window by shard; no interval is joined with another.
    """

    def ends(df: DataFrame, have: int, done: int) -> DataFrame:
        both = F.array(F.struct(F.col("lo").alias("at"), F.lit(have).alias("have"), F.lit(done).alias("done")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-have).alias("have"), F.lit(-done).alias("done")))
        return df.select("shard", F.explode(both).alias("e")).select("shard", "e.*")

    steps = ends(available, 1, 0).unionByName(ends(processed, 0, 1)).groupBy("shard", "at").agg(F.sum("have").alias("have"), F.sum("done").alias("done"))
    w = Window.partitionBy("shard").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    open_ = steps.select("shard", F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"), F.sum("have").over(upto).alias("have"), F.sum("done").over(upto).alias("done"))
    return merge(open_.where("have > 0 and done = 0 and hi >= lo"))


def inside(records: DataFrame, gaps: DataFrame) -> DataFrame:
    """Records (with shard and seq) whose number lies in a gap: gap starts and records are swept in one window by shard."""
    w = Window.partitionBy("shard").orderBy("seq", F.col("__hi").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    own = records.withColumn("__hi", F.lit(None).cast("bigint")).withColumn("__rec", F.lit(True))
    marks = gaps.select("shard", F.col("lo").alias("seq"), F.col("hi").alias("__hi"), F.lit(False).alias("__rec"))
    swept = own.unionByName(marks, allowMissingColumns=True).withColumn("__upto", F.last("__hi", ignorenulls=True).over(w))
    return swept.where(F.col("__rec") & (F.col("seq") <= F.col("__upto"))).drop("__hi", "__rec", "__upto")


#: Records that a shard holds; the number of shards follows from it.
PER_SHARD = 500_000


def numbered(records: DataFrame, key: str, order: list[Column], shards: int) -> DataFrame:
    """Adds shard, from a hash of the key, and seq, the place of the record inside its shard by ``order``, which must be total. Where new records come last
    in the order, old ones keep their numbers."""
    sharded = records.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    return sharded.withColumn("seq", F.row_number().over(Window.partitionBy("shard").orderBy(*order)).cast("bigint"))


def folded_hash(value: Column) -> Column:
    """A file hash without outer blanks, letter case and a leading ``sha256:``."""
    return F.regexp_replace(F.lower(F.trim(value)), "^sha256:", "")


def latest_attempt(manifest: DataFrame) -> DataFrame:
    """(file_path, done_hash, at): one row for each path, from its attempt with the greatest indexed_at; done_hash is null unless that
    attempt is done and has a hash. Equal times: the attempt that is not done wins, so that no file is skipped."""
    done = F.lower(F.trim("status")) == "done"
    made = F.when(F.coalesce(done, F.lit(False)), folded_hash(F.col("file_hash")))
    order = F.struct(F.coalesce("indexed_at", F.lit(float("-inf"))).alias("at"), made.isNull().alias("open"), made.alias("done_hash"))
    return manifest.where("file_path is not null").groupBy("file_path").agg(F.max(order).alias("last")).select("file_path", F.col("last.done_hash").alias("done_hash"), F.col("last.at").alias("at"))


def versions(scan: DataFrame, manifest: DataFrame, shards: int | None = None) -> DataFrame:
    """(file_path, file_hash, done, shard, seq): what the scan sees, one row for each path and hash. A version that the manifest's last attempt for the path has done
    keeps the place that the time of the attempt gives it; all others are changes and come after them."""
    seen = scan.where("file_path is not null and file_hash is not null").select("file_path", folded_hash(F.col("file_hash")).alias("file_hash")).distinct()
    known = seen.join(latest_attempt(manifest), "file_path", "left").withColumn("done", F.coalesce(F.col("done_hash") == F.col("file_hash"), F.lit(False)))
    shards = shards or max(1, -(-scan.count() // PER_SHARD))
    order = [F.when(F.col("done"), F.col("at")).asc_nulls_last(), F.col("file_path"), F.col("file_hash")]
    return numbered(known.select("file_path", "file_hash", "done", "at"), "file_path", order, shards).drop("at")


def files_to_index(scan: DataFrame, manifest: DataFrame, shards: int | None = None, log: IntervalLog | None = None) -> DataFrame:
    """(file_path, file_hash): what this run has to index.

    The versions that the scan sees are the available ranges. The numbers of those that the history has done are committed to the log as processed intervals
    (a log of its own in the checkpoint folder, where none is given); the stored intervals are subtracted, and the gaps are read back. A path comes out once, with its
    least folded hash, if any of its versions is open.

    Defined cases: null hashes (unreadable files) are never indexed; files of the manifest that the scan lacks are ignored; repeated and late
    rows on both sides change nothing; an empty manifest makes everything new; an empty scan gives an empty result.
    """
    spark = scan.sparkSession
    log = log or IntervalLog(spark, f"{checkpoint_dir(spark)}/intervals-{uuid.uuid4().hex}")
    records = cut(versions(scan, manifest, shards))
    log.adopt(records.where("done").select("shard", "seq"))
    return inside(records.drop("done"), log.gaps(records)).groupBy("file_path").agg(F.min("file_hash").alias("file_hash"))


def vanished_files(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path): paths of the manifest that the whole scan no longer has."""
    return manifest.select("file_path").where("file_path is not null").distinct().join(scan.select("file_path"), "file_path", "left_anti")


class IntervalLog:
    """Processed intervals of a consumer, kept beside its output.

    Commit n names the folder that holds the output of run n and all intervals processed up to it. Two runs that begin at the same commit can't both
    commit: the second fails, and its folder is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, self.root)

    def processed(self, n: int | None = None) -> DataFrame:
        n = self.commits.last() if n is None else n
        return self.spark.read.schema(INTERVAL).parquet(f"{self.root}/{self.commits.read(n)['data']}/intervals") if n else self.spark.createDataFrame([], INTERVAL)

    def output(self) -> DataFrame | None:
        made = [c for c in map(self.commits.read, range(1, self.commits.last() + 1)) if c["output"]]
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{c['data']}/output" for c in made]) if made else None

    def gaps(self, records: DataFrame) -> DataFrame:
        """The intervals of the records' numbers (shard, seq) that aren't processed."""
        whole = records.groupBy("shard").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"))
        if whole.where("n <> hi - lo + 1").isEmpty():  # numbers without holes are one range
            return subtract(whole.drop("n"), self.processed())
        return subtract(intervals(records.select("shard", "seq")), self.processed())

    def adopt(self, numbers: DataFrame) -> int:
        """Commit numbers (shard, seq) as processed without any output, as from a history that was kept elsewhere."""
        n, at = self.commits.last(), self.commits.folder()
        merged = intervals(numbers) if n == 0 else merge(self.processed(n), intervals(numbers))
        merged.write.parquet(f"{self.root}/{at}/intervals")
        self.commits.claim(n + 1, {"data": at, "output": False})
        return n + 1

    def run(self, records: DataFrame, process: Callable[[DataFrame], DataFrame]) -> int:
        """Process the records (with shard and seq) in the gaps and commit; the number of the commit, or 0 where nothing is open.

        An exception inside ``process`` or while writing leaves the log as it was."""
        n = self.commits.last()
        gaps = self.gaps(records)
        if gaps.isEmpty():
            return 0
        at = self.commits.folder()
        # gaps are written first and read back: records that arrive while the run goes on can't slip into its intervals
        gaps.write.parquet(f"{self.root}/{at}/gaps")
        fixed = self.spark.read.schema(INTERVAL).parquet(f"{self.root}/{at}/gaps")
        process(inside(records, fixed)).write.parquet(f"{self.root}/{at}/output")
        merge(self.processed(n), fixed).write.parquet(f"{self.root}/{at}/intervals")
        self.commits.claim(n + 1, {"data": at, "output": True})
        return n + 1
