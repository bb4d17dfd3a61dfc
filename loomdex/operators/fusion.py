"""Rank fusion with a vote cap, merging of paths, and selection by relevance and diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def renumbered(lists: DataFrame) -> DataFrame:
    """Ranks from 1 without gaps, in the order that the lists (query_id, list_id, rank, ...) had."""
    w = Window.partitionBy("query_id", "list_id").orderBy("rank", "chunk_id")
    return lists.withColumn("rank", F.row_number().over(w))


def rank_fusion(lists: DataFrame, k: int = 60, cap: int = 0) -> DataFrame:
    """(query_id, chunk_id, rrf): the sum of 1 / (k + rank) over lists (query_id, list_id, rank, chunk_id, doc_id).

    With a cap, only the first ``cap`` chunks of a document vote in one list; the others keep their ranks but get nothing there. Sums run in
    the order of the lists, so that they don't depend on partitioning."""
    voting = lists
    if cap:
        w = Window.partitionBy("query_id", "list_id", "doc_id").orderBy("rank", "chunk_id")
        voting = lists.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap)
    votes = voting.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("list_id", "rank"))).alias("votes"))  # one for each list
    return votes.select("query_id", "chunk_id", F.aggregate("votes", F.lit(0.0), lambda acc, v: acc + F.lit(1.0) / (F.lit(k) + v["rank"])).alias("rrf"))


def fused_pool(lists: DataFrame, k: int = 60, cap: int = 3) -> DataFrame:
    """(query_id, pos, chunk_id, doc_id, rrf, dense_score, sparse_score, matched_by): all chunks of lists with ``path`` (dense or sparse) and score.

    Ordered by rrf, then by the first list and rank; chunks whose votes were all void stay, at the end. dense_score is the best over the dense lists."""
    fused = rank_fusion(lists, k, cap)
    seen = lists.groupBy("query_id", "chunk_id").agg(
        F.max("doc_id").alias("doc_id"),
        F.min(F.struct("list_id", "rank")).alias("first"),
        F.max(F.when(F.col("path") == "dense", F.col("score"))).alias("dense_score"),
        F.max(F.when(F.col("path") == "sparse", F.col("score"))).alias("sparse_score"),
    )
    matched = F.when(F.col("dense_score").isNotNull() & F.col("sparse_score").isNotNull(), "both").when(F.col("dense_score").isNotNull(), "dense").otherwise("sparse")
    pool = seen.join(fused, ["query_id", "chunk_id"], "left").withColumn("rrf", F.coalesce("rrf", F.lit(0.0))).withColumn("matched_by", matched)
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first", "chunk_id")
    columns = ["query_id", F.row_number().over(w).alias("pos"), "chunk_id", "doc_id", "rrf", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), "matched_by"]
    return pool.select(*columns)


def without_covered(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Fallback policy: sparse hits of the questions that have no dense hit at all."""
    return sparse.join(dense.select("query_id").distinct(), "query_id", "left_anti")


def diverse(pool: DataFrame, top_n: int = 4, lam: float = 0.6) -> DataFrame:
    """(query_id, rank, chunk_id, ...): of a pool with pos, doc_id, page and file_path, ``top_n`` by relevance less redundancy.

    Relevance is 1 - (pos - 1) / n. Redundancy with what is chosen: 0.9 for the same document and page (null pages are equal), 0.5 for the same document, 0.3 for
    the same file, else 0. The first of the best in order of pos is taken; a pool of at most top_n stays as it is. A pool holds what the
    search paths gave for one question, a bounded number of rows."""
    extra = [c for c in pool.columns if c not in ("query_id", "pos")]
    packed = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", *extra))).alias("pool"))
    n = F.size("pool")

    def redundancy(a, b):
        return F.when(a["doc_id"] == b["doc_id"], F.when(a["page"].eqNullSafe(b["page"]), 0.9).otherwise(0.5)).when(a["file_path"] == b["file_path"], 0.3).otherwise(0.0)

    def score(c, i, chosen):
        worst = F.aggregate(chosen, F.lit(0.0), lambda acc, s: F.greatest(acc, redundancy(c, s)))
        return F.lit(lam) * (F.lit(1.0) - i / n) - F.lit(1 - lam) * worst

    def step(chosen, _):
        left = F.filter(F.col("pool"), lambda c: ~F.exists(chosen, lambda s: s["pos"] == c["pos"]))
        scored = F.transform(left, lambda c: F.struct(score(c, c["pos"] - 1, chosen).alias("s"), (-c["pos"]).alias("p"), c.alias("c")))
        return F.concat(chosen, F.array(F.array_max(F.transform(scored, lambda x: F.struct(x["s"], x["p"], x["c"])))["c"]))

    empty = F.filter(F.col("pool"), lambda c: F.lit(False))
    picked = F.when(n <= top_n, F.col("pool")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(top_n)), empty, step))
    out = packed.select("query_id", picked.alias("picked")).select("query_id", F.posexplode("picked").alias("rank", "c"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("c.pos").alias("pos"), *[F.col(f"c.{c}").alias(c) for c in extra])
