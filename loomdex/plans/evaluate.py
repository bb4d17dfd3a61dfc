"""The evaluation harness: hit rates of the retrieval plan under several settings, and of a plain baseline."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.config import DEFAULT, Settings
from loomdex.operators import evaluation, search
from loomdex.operators.embedding import embed
from loomdex.plans.retrieve import Corpus, retrieve
from loomdex.sources.records import missing_columns


def baseline(questions: DataFrame, corpus: Corpus, settings: Settings = DEFAULT, provider: str = "hash") -> DataFrame:
    """(query_id, rank, chunk_id, file_name): the best vectors over the threshold, else the best by words; no gate, no fusion."""
    n = settings.final_top_n
    vectors = questions.select("query_id", embed(F.col("text"), provider, dim=corpus.dim).alias("v"))
    dense = search.dense_top_k(vectors, corpus.vectors, n, corpus.dim).where(F.col("score") >= settings.dense_min)
    texts = corpus.chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    rest = questions.join(dense.select("query_id").distinct(), "query_id", "left_anti")
    hits = dense.unionByName(search.bm25_top_k(rest, texts, n))
    return hits.join(corpus.chunks.select(F.col("chunk_id").alias("id"), "file_name"), "id").select("query_id", "rank", F.col("id").alias("chunk_id"), "file_name")


def switches(settings: Settings = DEFAULT) -> dict[str, Settings]:
    """The plan as it is, and with each layer off."""
    return {
        "optimized": settings,
        "off_rewrite": dataclasses.replace(settings, rewrite=False),
        "off_hyde": dataclasses.replace(settings, hyde=False),
        "off_mmr": dataclasses.replace(settings, mmr=False),
        "off_cap": dataclasses.replace(settings, vote_cap=0),
        "fallback_only": dataclasses.replace(settings, sparse_fallback_only=True),
    }


def evaluate(cases: DataFrame, corpus: Corpus, runs: dict[str, Settings], with_baseline: bool = True, provider: str = "hash", pseudo: DataFrame | None = None, base: Settings = DEFAULT) -> DataFrame:
    """(tag, category, difficulty, level, n, hit1, hit3, hit10) of cases (id, question, category, difficulty, ground_truth_file) for each run."""
    questions = cases.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    hits = {tag: retrieve(questions, corpus, s, provider, pseudo)[0] for tag, s in runs.items()}
    if with_baseline:
        hits["baseline"] = baseline(questions, corpus, next(iter(runs.values()), base), provider)
    out = None
    for tag, h in hits.items():
        rates = evaluation.hit_rates(evaluation.hit_flags(cases, h.select("query_id", "rank", "file_name"))).withColumn("tag", F.lit(tag))
        out = rates if out is None else out.unionByName(rates)
    return out


NEEDED = ["chunk_id", "content", "doc_id", "file_name", "file_path", "page_start", "section_path"]


def smoke(corpus: Corpus, vectors: DataFrame, least: float, k: int = 20) -> DataFrame:
    """(query_id, n, n_over, best) for query vectors (query_id, v): how many of the k nearest there are, and how many reach the threshold. A corpus without the needed
    columns is an error that names them."""
    lacking = missing_columns(corpus.chunks, NEEDED)
    if lacking:
        raise ValueError(f"chunks lack {', '.join(lacking)}")
    near = search.dense_top_k(vectors, corpus.vectors, k, corpus.dim)
    return near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= least).alias("n_over"), F.round(F.max("score"), 6).alias("best"))
