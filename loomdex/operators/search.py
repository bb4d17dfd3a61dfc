"""Exact vector search, BM25, and substring frequencies for a batch of questions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.text import words
from loomdex.operators.postings import bm25, local_index

#: Queries that one pass over the corpus serves; more are dealt into groups and the corpus is read once for each.
QUERIES_AT_ONCE = 4000


def _top(rows: DataFrame, k: int, score: str, tie: str, by: str = "query_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _groups(queries: DataFrame, key: str) -> list[DataFrame]:
    n = max(1, math.ceil(queries.select(key).distinct().count() / QUERIES_AT_ONCE))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == g) for g in range(n)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def usable_vector(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, dim: int = 64) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, v) and vectors (id, v): exact cosine, in double precision.

    A group of queries is a matrix of at most QUERIES_AT_ONCE rows that goes to the tasks; each batch of vectors is one matrix product
    and keeps its own k best, so that only k rows for each query and batch are shuffled. Unusable vectors and queries are left out; ties go to
    the lesser id.
    """
    kind, qkind = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    fine = vectors.where(usable_vector(F.col("v"), dim)).select("id", "v")
    parts = []
    for group in _groups(queries.where(usable_vector(F.col("v"), dim)), "query_id"):
        rows = group.select("query_id", "v").collect()  # at most about QUERIES_AT_ONCE
        names = [r["query_id"] for r in rows]
        q = np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def scan(batches: Iterator[pa.RecordBatch], q: np.ndarray = q, names: list = names) -> Iterator[pa.RecordBatch]:
            name_array = np.array(names, dtype=object)
            for whole in batches:
                for at in range(0, whole.num_rows if names else 0, 1000):  # the matrix of scores stays below 32 MB
                    batch = whole.slice(at, 1000)
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                    ids = batch.column(0).to_numpy(zero_copy_only=False)
                    s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    m = min(k + 8, s.shape[1])  # a few more, for ties at the end
                    least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                    r, c = np.nonzero(s >= least)
                    yield pa.record_batch([pa.array(name_array[r].tolist()), pa.array(ids[c]), pa.array(s[r, c])], names=["query_id", "id", "score"])

        parts.append(fine.mapInArrow(scan, f"query_id {qkind}, id {kind}, score double"))
    return _top(_union(parts), k, "score", "id").select("query_id", "id", "score", "rank")


def bm25_top_k(queries: DataFrame, texts: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, analyse=words) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, text) and texts (id, text): BM25 of the queries' words, each once, without a stored index."""
    parts = []
    for group in _groups(queries, "query_id"):
        terms = group.select("query_id", F.explode(F.array_distinct(analyse(F.col("text")))).alias("phrase"))
        parts.append(bm25(terms, local_index(terms, texts, analyse), k, k1, b))
    return _union(parts)


def bm25_of_terms(terms: DataFrame, texts: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, id, score, rank) for terms (query_id, phrase): a term of several words is a phrase, and names count as a whole beside their parts."""
    parts = [bm25(g, local_index(g, texts), k) for g in _groups(terms, "query_id")]
    return _union(parts)


def substring_frequencies(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, df): how many texts (text) hold each term (term) as a substring, letter case apart; 0 where none does.

    One automaton of a group's terms passes over every text once, whatever the number of terms.
    """
    wanted = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    parts = []
    for group in _groups(wanted, "term"):
        own = [r["term"] for r in group.collect()]

        def scan(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            a = ahocorasick.Automaton()
            for i, t in enumerate(own):
                a.add_word(t, i)
            if own:
                a.make_automaton()
            n = np.zeros(len(own), dtype=np.int64)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    if own:
                        n[list({i for _, i in a.iter(t)})] += 1
            hit = np.flatnonzero(n)
            yield pa.record_batch([pa.array([own[i] for i in hit], pa.string()), pa.array(n[hit])], names=["term", "n"])

        parts.append(texts.where("text is not null").select(F.lower("text").alias("text")).mapInArrow(scan, "term string, n bigint"))
    counted = _union(parts).groupBy("term").agg(F.sum("n").alias("df"))
    return wanted.join(counted, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
