"""The stored index of words: postings, lengths of texts, and BM25 over them.

A term is a word as the analyser gives it. Words of ASCII letters and digits stand for themselves and once more for the token that they are part of, as names such
as ``svc_disk_dump`` are looked up by their parts and as a whole; a term of several words is a phrase, which counts where its words follow each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.text import words
from loomdex.session import cut

POSTING = "term string, id string, tf int, positions array<int>, file_path string"
LENGTH = "id string, len int, file_path string"


def doubled(text: Column) -> Column:
    """array<string>: the words of a text, then its ASCII tokens once more, cut into words. A token of one word so counts twice; phrases of a token's parts are found in both."""
    ascii_ = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_\\-.]{2,}"), F.lit(0))
    again = F.flatten(F.transform(ascii_, lambda t: F.filter(F.split(t, "[_\\-.]+"), lambda w: w != "")))
    return F.concat(words(text), again)


def analysed(texts: DataFrame, *kept: str, analyse=doubled) -> DataFrame:
    """(id, words, kept...) of texts (id, text); null texts are no rows of the index."""
    return texts.where("text is not null").select("id", *kept, F.explode(F.array(analyse(F.col("text")))).alias("words"))


def postings(analysed: DataFrame, *kept: str) -> DataFrame:
    """(term, id, tf, positions, kept...). The rows of a text are made inside its own row's task and grouped by (id, term)."""
    places = analysed.select("id", *kept, F.posexplode("words").alias("at", "term"))
    return places.groupBy("term", "id", *kept).agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))  # one text's places


def lengths(analysed: DataFrame, *kept: str) -> DataFrame:
    return analysed.select("id", F.size("words").alias("len"), *kept)


def phrase_terms(terms: DataFrame) -> DataFrame:
    """(query_id, phrase, n_words, k, term): each distinct phrase (column phrase) of a query cut into words, k from 0. Phrases without a word are left out."""
    cut = terms.select("query_id", F.lower("phrase").alias("phrase")).where("phrase is not null").distinct().withColumn("ws", words(F.col("phrase"))).where(F.size("ws") > 0)
    by_words = cut.groupBy("query_id", "ws").agg(F.min("phrase").alias("phrase"))
    return by_words.select("query_id", F.array_join("ws", " ").alias("phrase"), F.size("ws").alias("n_words"), F.posexplode("ws").alias("k", "term"))


def local_index(terms: DataFrame, texts: DataFrame, analyse=doubled) -> tuple[DataFrame, DataFrame]:
    """(postings with len, stats) of the words of terms (query_id, phrase) alone over texts (id, text), where no index is stored: written once to the checkpoint folder."""
    wanted = phrase_terms(terms).select("term").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    # every text has one row more, of an empty term, so that the counts of all texts need no second pass
    rows = analysed(texts, analyse=analyse).select("id", F.size("words").alias("len"), F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "term"))
    places = rows.join(F.broadcast(wanted), "term")
    found = cut(places.groupBy("id", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions")))  # one text's places
    return found.where("term <> ''"), found.where("term = ''").agg(F.count(F.lit(1)).alias("n_all"), F.avg("len").alias("avg_len"))


def stored_index(postings: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from stored tables."""
    return postings.join(lengths.select("id", "len"), "id"), lengths.agg(F.count(F.lit(1)).alias("n_all"), F.avg("len").alias("avg_len"))


def bm25(terms: DataFrame, index: tuple[DataFrame, DataFrame], k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) for terms (query_id, phrase), any of which may match, over an index.

    Only the postings of the queries' words are read on. Phrases of one word take its tf as it is; those of more count the places where all words follow
    each other, found by grouping the places less their offsets. idf = ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that isn't positive; ties go to the lesser id.

    The questions are a bounded group (search.QUERIES_AT_ONCE), so their phrases and weights fit into every task. What is shuffled is a row for each posting, however many
    questions share its phrase; a text's row then holds its weighted phrases, and the texts of a batch are scored for all questions at once and keep each
    question's k best."""
    spark = terms.sparkSession
    asked = phrase_terms(terms)
    phrases = asked.select("phrase", "n_words", "k", "term").distinct()
    hits = index[0].join(F.broadcast(phrases), "term")  # the words of a group of questions
    single = hits.where("n_words = 1").select("phrase", "id", "len", "tf")
    at = hits.where("n_words > 1").select("phrase", "n_words", "id", "len", "k", F.explode("positions").alias("p"))
    starts = at.groupBy("phrase", "n_words", "id", "len", (F.col("p") - F.col("k")).alias("start")).agg(F.count(F.lit(1)).alias("n")).where("n = n_words")
    found = single.unionByName(starts.groupBy("phrase", "id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf")))
    pairs = [tuple(r) for r in asked.select("query_id", "phrase").distinct().collect()]
    df = {r["phrase"]: r["df"] for r in found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).collect()}
    stats = index[1].first()
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((terms, "query_id"), (hits, "id"))]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if not df:
        return spark.createDataFrame([], schema + ", rank int")
    idf = {p: math.log((stats["n_all"] - n + 0.5) / (n + 0.5)) for p, n in df.items()}
    table = spark.createDataFrame([(p, i, x if x > 0 else 1e-6) for i, (p, x) in enumerate(idf.items())], "phrase string, no int, idf double")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["avg_len"])))
    texts = found.join(F.broadcast(table), "phrase").groupBy("id").agg(F.collect_list(F.struct("no", part.alias("part"))).alias("parts"))  # a text's phrases
    names = sorted({q for q, _ in pairs})
    score = _scored(list(df), [(q, p) for q, p in pairs if p in df], names, k)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    found = texts.select("id", "parts").mapInArrow(score, schema)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _scored(phrases: list[str], pairs: list[tuple], names: list, k: int, at_once: int = 4_000_000):
    number, place = {p: i for i, p in enumerate(phrases)}, {q: i for i, q in enumerate(names)}
    order = sorted((number[p], place[q]) for q, p in pairs)
    starts = np.searchsorted([o[0] for o in order], np.arange(len(phrases) + 1)) if order else np.zeros(len(phrases) + 1, np.int64)
    query, n = np.array([o[1] for o in order], dtype=np.int64), len(names)
    step = max(1, at_once // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array(names, dtype=object)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column(1)
                ends = lists.offsets.to_numpy().astype(np.int64)
                flat, ids = lists.flatten(), batch.column(0)
                no, part = flat.field("no").to_numpy(zero_copy_only=False), flat.field("part").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(ids)), np.diff(ends))
                counts = starts[no + 1] - starts[no]
                row = np.repeat(np.arange(len(no)), counts)
                q = query[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[no][row]]
                s = np.bincount(doc[row] * n + q, weights=part[row], minlength=len(ids) * n).reshape(len(ids), n)
                m = min(k + 8, len(ids))  # a few more, for ties at the end
                least = -np.partition(-s, m - 1, axis=0)[m - 1]
                d, c = np.nonzero((s >= least) & (s > 0))
                yield pa.record_batch([pa.array(labels[c].tolist()), ids.take(pa.array(d)), pa.array(s[d, c])], names=["query_id", "id", "score"])

    return run
