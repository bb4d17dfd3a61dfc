"""One plan that answers a batch of questions: gate, variants, vector and BM25 search, fusion, selection, contexts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.config import DEFAULT, Settings
from loomdex.operators import fusion, gates, generation, rewrite, search
from loomdex.operators.embedding import embed
from loomdex.operators.postings import bm25, stored_index
from loomdex.session import cut


@dataclass
class Corpus:
    """chunks: one row for each child (chunk_id, content, doc_id, file_path, file_name, page_start, section_path); vectors: (id = chunk_id, v)."""

    chunks: DataFrame
    vectors: DataFrame
    dim: int = 64
    #: (postings, lengths) as the index job stores them; without them the words of the questions are looked for in all chunks
    stored: tuple[DataFrame, DataFrame] | None = None


def retrieve(questions: DataFrame, corpus: Corpus, settings: Settings = DEFAULT, provider: str = "hash", pseudo: DataFrame | None = None, where=None) -> tuple[DataFrame, DataFrame]:
    """(hits, verdicts) for questions (query_id, text).

    hits: (query_id, rank, chunk_id, doc_id, rrf, dense_score, sparse_score, matched_by, content, file_name, file_path, page, section); verdicts: (query_id, reason)
    with reason "", no_subject_evidence or below_threshold. Questions that carry a vector ``v`` are searched by it alone: no gate, no
    variants, no threshold on BM25. ``where`` is a condition on chunks that every hit must fulfil; ``pseudo`` has (query_id, doc).
    """
    injected = "v" in questions.columns
    chunks = corpus.chunks if where is None else corpus.chunks.where(where)
    vectors = corpus.vectors if where is None else corpus.vectors.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
    texts = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    if injected:
        gate = questions.select("query_id", F.lit(True).alias("passes"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("rare_tokens"))
        asked = questions.select("query_id", F.lit(0).alias("list_id"), "v")
    else:
        tokens = gates.tokens_of(questions)
        df = search.substring_frequencies(tokens.select(F.col("token").alias("term")), texts.select("text"))
        judged = gates.discriminative(tokens, df, texts.where("text is not null").count(), settings.ubiquitous_ratio)
        gate = cut(gates.evidence_gate(questions, judged))  # a row for each question
        open_ = questions.join(gate.where("passes").select("query_id"), "query_id")
        said = rewrite.variants(F.col("text")) if settings.rewrite else F.array(F.col("text"))
        listed = open_.select("query_id", F.posexplode(said).alias("list_id", "text"))
        if settings.hyde and pseudo is not None:
            extra = open_.select("query_id").join(pseudo.where("doc is not null"), "query_id")
            listed = listed.unionByName(extra.select("query_id", F.lit(900).alias("list_id"), F.col("doc").alias("text")))
        asked = listed.select("query_id", "list_id", embed(F.col("text"), provider, dim=corpus.dim).alias("v"))
    about = chunks.select(F.col("chunk_id").alias("id"), "content", "doc_id", "file_name", "file_path", F.col("page_start").alias("page"), F.col("section_path").alias("section"))
    keyed = asked.select(F.concat_ws("\x1f", "query_id", F.col("list_id").cast("string")).alias("query_id"), "v")
    dense = search.dense_top_k(keyed, vectors, settings.dense_top_k, corpus.dim)
    named = dense.select(F.substring_index("query_id", "\x1f", 1).alias("query_id"), F.substring_index("query_id", "\x1f", -1).cast("int").alias("list_id"), "id", "score", "rank")
    found = named.join(about.select("id", "content", "doc_id"), "id").join(gate.select("query_id", "rare_tokens"), "query_id")
    columns = ["query_id", "list_id", F.col("id").alias("chunk_id"), "doc_id", "score", "rank"]
    dense_lists = gates.dense_gate(found, settings.dense_min).select(*columns, F.lit("dense").alias("path"))
    open_texts = questions.select("query_id", "text") if injected and "text" in questions.columns else None if injected else questions.join(gate.where("passes").select("query_id"), "query_id").select("query_id", "text")
    dense_lists = cut(dense_lists)  # at most dense_top_k rows for each variant
    lists = dense_lists
    if open_texts is not None:
        terms = open_texts.select("query_id", F.explode(gates.query_terms(F.col("text"))).alias("phrase"))
        if corpus.stored and where is None:
            ranked = bm25(terms, stored_index(*corpus.stored), settings.sparse_top_k)
        else:
            ranked = search.bm25_of_terms(terms, texts, settings.sparse_top_k)
        sparse = ranked.withColumn("list_id", F.lit(1000)).join(about.select("id", "content", "doc_id"), "id").join(gate.select("query_id", "rare_tokens"), "query_id")
        kept = sparse if injected else gates.sparse_gate(sparse, settings.sparse_min, settings.require_token)
        sparse_lists = kept.select(*columns, F.lit("sparse").alias("path"))
        if settings.sparse_fallback_only:
            sparse_lists = fusion.without_covered(sparse_lists, dense_lists)
        lists = lists.unionByName(sparse_lists)
    pool = fusion.fused_pool(fusion.renumbered(lists), settings.rrf_k, settings.vote_cap)
    full = pool.join(about.withColumnRenamed("id", "chunk_id").drop("doc_id"), "chunk_id")
    if settings.mmr:
        hits = fusion.diverse(full, settings.final_top_n, settings.mmr_lambda).drop("pos")
    else:
        hits = full.where(F.col("pos") <= settings.final_top_n).withColumnRenamed("pos", "rank")
    hits = hits.select("query_id", "rank", "chunk_id", "doc_id", "rrf", "dense_score", "sparse_score", "matched_by", "content", "file_name", "file_path", "page", "section")
    some = hits.select("query_id").distinct().withColumn("__some", F.lit(True))
    verdicts = gate.join(some, "query_id", "left").select("query_id", F.when(~F.col("passes"), F.col("reason")).when(F.col("__some").isNull(), "below_threshold").otherwise("").alias("reason"))
    return hits, verdicts


def extract(contexts_of_hits: DataFrame) -> DataFrame:
    """An answer without a model: the first block's content. (query_id, answer, contents, names) from hits."""
    per = contexts_of_hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "file_name"))).alias("h"))  # at most final_top_n rows
    return per.select("query_id", F.get("h", 0)["content"].alias("answer"), F.transform("h", lambda x: x["content"]).alias("contents"), F.transform("h", lambda x: x["file_name"]).alias("names"))


def ask(questions: DataFrame, corpus: Corpus, settings: Settings = DEFAULT, generate=extract, **options) -> DataFrame:
    """(query_id, state, text, reason, context, citations): the whole way from questions to checked answers. ``generate`` maps hits to
    (query_id, answer, contents, names)."""
    hits, verdicts = retrieve(questions, corpus, settings, **options)
    answered = generation.responses(generate(hits))
    context = generation.contexts(hits, settings.max_context_tokens).select("query_id", "context")
    cited = generation.citations(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file_name", "page", "chunk_id", "uri", "excerpt"))).alias("citations"))
    out = verdicts.join(answered.withColumnRenamed("reason", "why"), "query_id", "left").join(context, "query_id", "left").join(cited, "query_id", "left")
    none = F.col("state").isNull()
    return out.select("query_id", F.when(none, "refusal").otherwise(F.col("state")).alias("state"), F.when(none, generation.REFUSAL).otherwise(F.col("text")).alias("text"), F.when(none, F.col("reason")).otherwise(F.col("why")).alias("reason"), "context", "citations")
