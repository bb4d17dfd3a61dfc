"""Hit rates of retrieval, quality checks of chunks, reports of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import token_count

KINDS = ("text", "table", "formula", "figure_caption", "code", "heading")


def hit_flags(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases (id, category, difficulty, ground_truth_file) with hit1, hit3, hit10 and n_retrieved, from hits (query_id, rank, file_name): whether one of
    the first k names holds one of the true names. No true name: no hit."""
    got = hits.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "file_name"))).alias("got"))  # at most top-k rows
    truth = F.coalesce("ground_truth_file", F.array().cast("array<string>"))
    joined = cases.join(got, "id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<struct<rank:int,file_name:string>>"))).withColumn("__t", truth)

    def hit(k: int):
        return F.exists("got", lambda h: (h["rank"] <= k) & F.exists("__t", lambda t: F.contains(h["file_name"], t))).cast("int")

    return joined.select("id", "category", "difficulty", *[hit(k).alias(f"hit{k}") for k in (1, 3, 10)], F.size("got").alias("n_retrieved"))


def hit_rates(flags: DataFrame) -> DataFrame:
    """(category, difficulty, level, n, hit1, hit3, hit10) over all cases, by category and by difficulty; rates in percent, one place. Where the flags have them, also the means
    of latency_ms (one place) and of top1, the best dense score (three places)."""
    means = [F.bround(F.avg(c), n).alias(f"mean_{c}") for c, n in (("latency_ms", 1), ("top1", 3)) if c in flags.columns]
    rate = lambda k: F.bround(100 * F.avg(f"hit{k}"), 1).alias(f"hit{k}")
    c, d = F.col("category"), F.col("difficulty")
    grouped = flags.groupingSets([[], [c], [d]], c, d).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), rate(1), rate(3), rate(10), *means)
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "category").otherwise("difficulty")
    return grouped.select("category", "difficulty", level.alias("level"), "n", "hit1", "hit3", "hit10", *[f"mean_{c}" for c in ("latency_ms", "top1") if c in flags.columns])


def token_stats(chunks: DataFrame, limit: int = 512) -> DataFrame:
    """(is_parent, chunk_type, n, least, most, mean, n_over, n_fragments), by content; null contents are left out."""
    n = token_count(F.col("content"))
    return chunks.where("content is not null").select("is_parent", "chunk_type", n.alias("t")).groupBy("is_parent", "chunk_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("least"), F.max("t").alias("most"), F.round(F.avg("t"), 6).alias("mean"), F.count_if(F.col("t") > limit).alias("n_over"), F.count_if(F.col("t") < 50).alias("n_fragments")
    )


def quality(chunks: DataFrame, child_limit: int = 512, parent_limit: int = 2048) -> DataFrame:
    """(check, severity, n): how many chunks break each rule of acceptance. ``chunks`` has one row for each chunk_id."""
    t = token_count(F.col("content"))
    parents = chunks.where("is_parent").select(F.col("chunk_id").alias("pid"), F.col("content").alias("parent_content"))
    linked = chunks.where(~F.col("is_parent")).withColumn("link", F.nullif("parent_chunk_id", F.lit(""))).join(parents, F.col("link") == F.col("pid"), "left")
    rules = {
        ("child_over_limit", "fail"): ~F.col("is_parent") & (t > child_limit),
        ("parent_over_limit", "fail"): F.col("is_parent") & (t > parent_limit),
        ("unknown_type", "fail"): ~F.coalesce(F.col("chunk_type").isin(*KINDS), F.lit(False)),
        ("no_doc_id", "fail"): F.coalesce("doc_id", F.lit("")) == "",
        ("no_doc_title", "fail"): F.coalesce("doc_title", F.lit("")) == "",
        ("no_page", "warn"): ~F.col("is_parent") & F.col("page_start").isNull(),
        ("short_child", "warn"): ~F.col("is_parent") & (t < 20),
        ("malformed_table", "warn"): (F.col("chunk_type") == "table") & ~F.coalesce(F.col("content").rlike("\\|\\s*-{3}"), F.lit(False)),
    }
    links = {
        ("dangling_parent", "fail"): F.col("link").isNotNull() & F.col("pid").isNull(),
        ("unlinked_child", "warn"): F.col("link").isNull(),
        ("parent_lacks_child", "fail"): F.col("pid").isNotNull() & ~F.contains("parent_content", F.substring("content", 1, 80)),
    }
    counted = []
    for df, some in ((chunks, rules), (linked, links)):
        sums = df.agg(*[F.count_if(c).alias(name) for (name, _), c in some.items()])
        counted.append(sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.lit(s).alias("severity"), F.col(name).alias("n")) for name, s in some])).alias("x")).select("x.*"))
    return counted[0].unionByName(counted[1])


def error_kinds(manifest: DataFrame) -> DataFrame:
    """(kind, n): errors by what stands before the first colon, 60 characters at most; empty messages are unknown."""
    head = F.substring(F.trim(F.substring_index(F.coalesce("error_msg", F.lit("")), ":", 1)), 1, 60)
    return manifest.groupBy(F.when(head == "", "unknown").otherwise(head).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def throughput(files: DataFrame, pages: str, size: str, free_gb: float | None = None) -> DataFrame:
    """(n_files, chunks, seconds): three chunks a page, else one for each 700 bytes; 0.4 to 6 chunks a second, linear in the free memory between 2.5 and 4 GB."""
    rate = 0.4 if free_gb is None else 0.4 + 5.6 * min(1.0, max(0.0, (free_gb - 2.5) / 1.5))
    each = F.when(F.col(pages) > 0, 3 * F.col(pages)).otherwise(F.greatest(F.lit(1), F.floor(F.coalesce(F.col(size), F.lit(0)) / 700)))
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum(each).alias("chunks")).withColumn("seconds", F.round(F.col("chunks") / rate, 1))
