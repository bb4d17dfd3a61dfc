"""Evidence gates: which questions, and which hits, have words of the corpus behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import STOPWORDS, TERMS
from loomdex.functions.text import english_tokens


def chinese_terms(query: Column, terms: dict[str, str] = TERMS) -> Column:
    """array<string>: content terms of a Chinese question. Runs of Han characters are cut by the longest terms of the dictionary, what is
    left into pairs of characters; stop words and single characters are dropped."""
    known = sorted((t for t in terms if all("一" <= c <= "鿿" for c in t)), key=lambda t: (-len(t), t))
    stop = sorted((w for w in STOPWORDS if len(w) > 1), key=lambda t: (-len(t), t))
    found = F.regexp_extract_all(query, F.lit("|".join([*known, *stop, "[\\x{4e00}-\\x{9fff}]{2}"])), F.lit(0))
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(w) for w in STOPWORDS])))


def query_terms(query: Column) -> Column:
    """array<string>: Chinese terms, then ASCII tokens in lower case; distinct, in order."""
    ascii_ = F.transform(F.regexp_extract_all(query, F.lit("[A-Za-z0-9_\\-.]{2,}"), F.lit(0)), lambda t: F.lower(t))
    return F.array_distinct(F.concat(chinese_terms(query), ascii_))


def tokens_of(queries: DataFrame) -> DataFrame:
    """(query_id, token, kind): kind en for ASCII tokens (trailing full stops and hyphens off), zh for Chinese terms."""
    en = F.filter(F.transform(english_tokens(F.col("text")), lambda t: F.regexp_replace(t, "[.\\-]+$", "")), lambda t: F.length(t) >= 2)
    rows = queries.select("query_id", F.explode(F.array_distinct(en)).alias("token")).withColumn("kind", F.lit("en"))
    return rows.unionByName(queries.select("query_id", F.explode(chinese_terms(F.col("text"))).alias("token")).withColumn("kind", F.lit("zh")))


def discriminative(tokens: DataFrame, df: DataFrame, n_texts: Column | int, ratio: float = 0.10) -> DataFrame:
    """tokens with df and ``rare``: whether an ASCII token stands in at most max(1, floor(ratio * n_texts)) texts."""
    n = n_texts if isinstance(n_texts, Column) else F.lit(n_texts)
    limit = F.greatest(F.lit(1), F.floor(n * F.lit(ratio)))
    return tokens.join(df.select(F.col("term").alias("token"), "df"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rare", (F.col("kind") == "en") & (F.col("df") <= limit))


def evidence_gate(queries: DataFrame, judged: DataFrame, terms: dict[str, str] = TERMS) -> DataFrame:
    """(query_id, passes, reason, rare_tokens). A question is refused if one of its ASCII tokens stands nowhere, or if it has no
    discriminative token, but Chinese terms, all without a text and without an entry in the dictionary."""
    listed = F.col("token").isin(list(terms))
    per = judged.groupBy("query_id").agg(
        F.bool_or((F.col("kind") == "en") & (F.col("df") == 0)).alias("absent"),
        F.count_if(F.col("rare")).alias("n_rare"),
        F.count_if(F.col("kind") == "zh").alias("n_zh"),
        F.count_if((F.col("kind") == "zh") & ((F.col("df") > 0) | listed)).alias("n_zh_known"),
        F.array_sort(F.collect_set(F.when(F.col("rare"), F.col("token")))).alias("rare_tokens"),  # tokens of one question
    )
    refused = F.coalesce(F.col("absent") | ((F.col("n_rare") == 0) & (F.col("n_zh") > 0) & (F.col("n_zh_known") == 0)), F.lit(False))
    out = queries.select("query_id").join(per, "query_id", "left")
    return out.select("query_id", (~refused).alias("passes"), F.when(refused, "no_subject_evidence").otherwise("").alias("reason"), F.coalesce("rare_tokens", F.array().cast("array<string>")).alias("rare_tokens"))


def holds_any(content: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(F.lower(content), t))


def dense_gate(hits: DataFrame, least: float) -> DataFrame:
    """Hits (score, content, rare_tokens) of at least ``least``; where the question has rare tokens, the content must hold one."""
    return hits.where((F.col("score") >= least) & ((F.size("rare_tokens") == 0) | holds_any(F.col("content"), F.col("rare_tokens"))))


def sparse_gate(hits: DataFrame, least: float, require_token: bool = True) -> DataFrame:
    """Hits of at least ``least`` whose content holds a rare token; without rare tokens a question has none. ``require_token`` False: the
    score alone decides."""
    fine = F.col("score") >= least
    return hits.where(fine & holds_any(F.col("content"), F.col("rare_tokens"))) if require_token else hits.where(fine)
