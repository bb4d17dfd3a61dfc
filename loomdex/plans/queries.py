"""Registered queries of the core. Their SQL stands in plans/oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.config import DEFAULT, Settings
from loomdex.functions import cleaning, text
from loomdex.operators import chunking, evaluation, fusion, gates, generation, incremental, postings, rewrite, search, store, structure
from loomdex.operators.embedding import embed
from loomdex.plans.evaluate import baseline, smoke
from loomdex.plans.retrieve import Corpus, ask, retrieve
from loomdex.session import cut
from loomdex.sources.records import CACHE, cache_stats, lookup
from loomdex.sources.tables import table
from loomdex.streaming.ingest import event_rates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def once(spark: SparkSession, sf: str) -> DataFrame:
    """Children, one row for each chunk_id; repeats of a chunk differ in created_at and token_estimate alone, so any row serves."""
    cols = ["content", "file_path", "file_name", "page_start", "chunk_index", "doc_id", "doc_title", "section_path", "chunk_type", "parent_chunk_id"]
    return table(spark, sf, "chunks").where(~F.col("is_parent")).groupBy("chunk_id").agg(F.max(F.struct(*cols)).alias("r")).select("chunk_id", "r.*")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_cases").select(F.col("id").alias("query_id"), F.col("question").alias("text"))


def lines(df: DataFrame, key: str, body: str) -> DataFrame:
    return df.where(F.col(body).isNotNull()).select(key, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


# --- incremental processing -----------------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.files_to_index(table(spark, sf, "file_scan"), table(spark, sf, "manifest")).select("file_path")


@query
def p3_vanished(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.vanished_files(table(spark, sf, "file_scan"), table(spark, sf, "manifest"))


@query
def i02_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Each scanned file's state: unreadable, new, retry (its last attempt isn't done), changed or unchanged."""
    seen = table(spark, sf, "file_scan").select("file_path", incremental.folded_hash(F.col("file_hash")).alias("h")).groupBy("file_path").agg(F.max("h").alias("h"))
    last = incremental.latest_attempt(table(spark, sf, "manifest"))
    state = F.when(F.col("h").isNull(), "unreadable").when(F.col("known").isNull(), "new").when(F.col("done_hash").isNull(), "retry").when(F.col("done_hash") != F.col("h"), "changed").otherwise("unchanged")
    return seen.join(last.withColumn("known", F.lit(True)), "file_path", "left").select("file_path", state.alias("state"))


@query
def a09_ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    gone = p3_vanished(spark, sf).select(F.lit("removed").alias("state"))
    return i02_manifest_diff(spark, sf).select("state").unionByName(gone).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query
def s13_manifest_latest(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.latest_attempt(table(spark, sf, "manifest")).select("file_path", "done_hash")


@query
def s02_newest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "file_scan").groupBy("file_path").agg(F.max("mtime").alias("mtime")).select(text.source_of(F.col("file_path")).alias("source"), "file_path", "mtime")
    w = Window.partitionBy("source").orderBy(F.desc("mtime"), "file_path")
    return files.withColumn("n", F.row_number().over(w)).where(F.col("n") <= DEFAULT.newest_per_root)


@query
def a08_error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.lower(F.trim(F.coalesce("status", F.lit("")))) != "done"
    return evaluation.error_kinds(table(spark, sf, "manifest").where(bad))


@query
def a12_status(spark: SparkSession, sf: str) -> DataFrame:
    s = F.lower(F.trim("status"))
    return table(spark, sf, "manifest").agg(F.count_if(s == "done").alias("n_done"), F.count_if(s == "error").alias("n_error"), F.count_if(s.isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"), F.sum("chunk_count").alias("n_chunks"))


@query
def e06_throughput(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "segments").groupBy(F.col("doc").alias("file_path")).agg(F.max(F.coalesce("page_end", "page")).alias("pages"))
    files = table(spark, sf, "file_scan").groupBy("file_path").agg(F.max("size").alias("size")).join(pages, "file_path", "left")
    return evaluation.throughput(files.withColumn("pages", F.coalesce("pages", F.lit(0))), "pages", "size")


@query
def k01_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of chunks as if they had come one after the other: the last by created_at (spellings folded) of each chunk_id stays."""
    at = F.substring(F.replace(F.replace(F.col("created_at"), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit("")), 1, 19)
    rows = table(spark, sf, "chunks").select("chunk_id", at.alias("at"), "file_path", "chunk_type", "is_parent")
    last = store.latest_rows(rows, "chunk_id", ["at", "chunk_type"])
    old = last.where("is_parent").withColumn("chunk_type", F.lit("old"))  # parents that are there already are replaced
    return store.upserted(old, last, "chunk_id").select("chunk_id", "at", "file_path", "chunk_type")


@query
def k03_delete_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks without those of files that vanished, counted by file."""
    left = store.without(table(spark, sf, "chunks").select("file_path", "chunk_id"), p3_vanished(spark, sf), "file_path")
    return left.groupBy("file_path").agg(F.countDistinct("chunk_id").alias("n"))


# --- cleaning -------------------------------------------------------------------------------------------------------------


@query
def s03_content_hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    h = F.sha2(F.col("text"), 256)
    return table(spark, sf, "documents").where("text is not null").groupBy(h.alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query
def c01_norm_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = text.norm_key(F.col("line"))
    return lines(table(spark, sf, "segments"), "doc", "text").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc").alias("n_docs"))


@query
def c02_noise_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "segments").select(F.concat("doc", F.lit("#"), "seg_no").alias("key"), "text").distinct()
    return lines(rows, "key", "text").where(cleaning.is_noise(F.col("line"))).select("key", "line_no", "line")


@query
def c03_learned_noise(spark: SparkSession, sf: str) -> DataFrame:
    """First and last lines of pages stand for the head and foot zones."""
    per = table(spark, sf, "segments").where("page is not null and text is not null").select("doc", "page", F.split("text", "\n").alias("l"))
    zone = per.select("doc", "page", F.explode(F.array(F.get("l", 0), F.element_at("l", -1))).alias("line"))
    return cleaning.learned_noise(zone)


@query
def c05_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", cleaning.clean_text(F.col("text")).alias("text"))


@query
def c06_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", cleaning.scrub(F.col("text")).alias("text"))


@query
def c07_dedup_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", cleaning.dedup_paragraphs(F.col("text")).alias("text"))


@query
def c08_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", cleaning.language_by_script(F.col("text")).alias("language"))


# --- tokens and chunks ----------------------------------------------------------------------------------------------------


@query
def t01_token_count(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf).where("content is not null").select("chunk_id", text.token_count(F.col("content")).alias("tokens"))


@query
def t02_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.truncate(F.col("text"), 256).alias("text"))


@query
def t04_tier(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "segments").groupBy("doc").agg(F.coalesce(F.max(F.coalesce("page_end", "page")), F.lit(0)).alias("pages"))
    return pages.select("doc", "pages", text.tier(F.col("pages")).alias("t")).select("doc", "pages", "t.*")


@query
def t06_units(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(chunking.units(F.col("text"))).alias("unit_no", "unit"))
    return d.select("doc_id", "unit_no", "unit")


@query
def t11_captions(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf).where(chunking.is_caption(F.col("content"))).select("chunk_id")


@query
def t13_child_ids(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf).select("chunk_id", chunking.child_id_column(F.col("file_path"), F.col("page_start"), F.col("chunk_index")).alias("made"))


@query
def t13_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf).where(chunking.has_warning(F.col("content"))).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n"))


@query
def t14_parent_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Children of each file, in order, grouped greedily up to 1536 tokens."""
    rows = once(spark, sf).where("content is not null").select("file_path", F.struct("chunk_index", "chunk_id", text.token_count(F.col("content")).alias("n")).alias("c"))
    per = rows.groupBy("file_path").agg(F.array_sort(F.collect_list("c")).alias("cs"))  # one file's ids and counts
    grouped = per.select("file_path", "cs", F.explode(F.array(chunking.parent_groups_column(F.transform("cs", lambda c: c["n"]), 1536))).alias("gs"))
    return grouped.select("file_path", F.posexplode("cs").alias("i", "c"), "gs").select("file_path", "c.chunk_id", F.get("gs", F.col("i")).alias("group_no"))


@query
def t15_split_documents(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "segments")
    return chunking.split_documents(segments, segments.groupBy("doc").agg(F.max(F.coalesce("page_end", "page")).alias("pages")))


@query
def p14_sections(spark: SparkSession, sf: str) -> DataFrame:
    """The section of every segment, from the headings before it."""
    rows = table(spark, sf, "segments").groupBy("doc", "seg_no").agg(F.max("kind").alias("kind"), F.max("level").alias("level"), F.max("text").alias("text"))
    return structure.section_paths(rows).select("doc", "seg_no", "path")


# --- questions ------------------------------------------------------------------------------------------------------------


@query
def f05_query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.posexplode(text.english_tokens(F.col("text"))).alias("n", "token"))


@query
def f06_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    tokens = f05_query_tokens(spark, sf).select(F.col("token").alias("term"))
    return search.substring_frequencies(tokens, once(spark, sf).select(F.col("content").alias("text")))


@query
def f07_discriminative(spark: SparkSession, sf: str) -> DataFrame:
    tokens = f05_query_tokens(spark, sf).select("query_id", "token").withColumn("kind", F.lit("en"))
    texts = once(spark, sf).where("content is not null").select(F.col("content").alias("text"))
    df = search.substring_frequencies(tokens.select(F.col("token").alias("term")), texts)
    return gates.discriminative(tokens, df, texts.count()).where("rare").select("query_id", "token", "df")


@query
def f10_evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    q = questions(spark, sf)
    tokens = gates.tokens_of(q)
    texts = once(spark, sf).where("content is not null").select(F.col("content").alias("text"))
    df = search.substring_frequencies(tokens.select(F.col("token").alias("term")), texts)
    return gates.evidence_gate(q, gates.discriminative(tokens, df, texts.count())).select("query_id", "passes", "reason")


@query
def w01_variants(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.posexplode(rewrite.variants(F.col("text"))).alias("n", "variant"))


@query
def w04_parts(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.posexplode(rewrite.parts(F.col("text"))).alias("n", "part"))


@query
def w07_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", text.cache_key(F.col("text")).alias("key"))


@query
def w08_lru(spark: SparkSession, sf: str) -> DataFrame:
    """Events as accesses of a cache of 200 users."""
    return rewrite.lru(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")), 200)


@query
def w08_put(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of 200 entries after all titles of documents were put into it, in the order of their ids."""
    made = table(spark, sf, "documents").where("title is not null").select(F.col("title").alias("query"), F.col("source").alias("doc"), F.col("doc_id").alias("ts"))
    return rewrite.put(spark.createDataFrame([], CACHE), made, 200)


@query
def k08_cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cache_stats(w08_put(spark, sf))


@query
def w09_first_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.first_words(F.col("text"), 45).alias("text"))


@query
def u03_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.posexplode(gates.query_terms(F.col("text"))).alias("n", "term"))


# --- search ---------------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_vectors").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "provider", "chunk_id")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")


@query
def r01_dense_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    v = _vectors(spark, sf)
    return search.dense_top_k(_asked(v), v, 20).withColumn("score", F.round("score", 6))


@query
def f01_filtered_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The same against vectors of one provider alone."""
    v = _vectors(spark, sf)
    return search.dense_top_k(_asked(v), v.where(F.lower("provider") == "cloud"), 5).withColumn("score", F.round("score", 6))


@query
def f03_dense_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return r01_dense_top_k(spark, sf).where(F.col("score") >= DEFAULT.dense_min).select("query_id", "id")


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", F.explode(gates.query_terms(F.col("text"))).alias("phrase"))


@query
def r02_bm25_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of the questions, names as phrases, over an index with doubled ASCII tokens."""
    texts = once(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    return search.bm25_of_terms(_terms(spark, sf), texts, 20).withColumn("score", F.round("score", 6))


@query
def k02_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The stored postings of all chunks, summed by term."""
    rows = postings.analysed(once(spark, sf).select(F.col("chunk_id").alias("id"), F.col("content").alias("text")))
    return postings.postings(rows).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max(F.element_at("positions", -1)).cast("bigint").alias("last_place"))


@query
def x14_mock_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """For each evaluation case, the vector of the chunk of its true files whose id has the least digest, as the vector of its question."""
    cases = table(spark, sf, "eval_cases").select(F.col("id").alias("query_id"), F.explode("ground_truth_file").alias("file_name"))
    files = table(spark, sf, "chunks").where(~F.col("is_parent")).select("chunk_id", "file_name").distinct()
    fine = _vectors(spark, sf).where(search.usable_vector(F.col("v"), 64)).select("chunk_id", F.col("id").alias("vec_id"))
    return cases.join(files, "file_name").join(fine, "chunk_id").groupBy("query_id").agg(F.min_by("vec_id", F.struct(F.md5(F.col("vec_id").cast("string")), "vec_id")).alias("vec_id"))


def _dense(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank): the nearest vectors of each case's mock vector, each chunk at its best one."""
    v = _vectors(spark, sf)
    asked = x14_mock_vectors(spark, sf).join(v.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v")
    near = search.dense_top_k(asked, v, k).join(v.select("id", "chunk_id"), "id").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    return near.where("chunk_id is not null").select("query_id", "chunk_id", "score", "rank")


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranked lists of chunks for each question: vectors, ranked anew where vectors share a chunk, and BM25."""
    chunks = cut(once(spark, sf).select("chunk_id", "content", "doc_id"))
    texts = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    a = fusion.renumbered(_dense(spark, sf).withColumn("list_id", F.lit(0))).withColumn("path", F.lit("dense"))
    b = search.bm25_of_terms(_terms(spark, sf), texts, 20).withColumnRenamed("id", "chunk_id").withColumn("list_id", F.lit(1)).withColumn("path", F.lit("sparse"))
    return cut(a.unionByName(b.select(*a.columns)).join(chunks.select("chunk_id", "doc_id"), "chunk_id"))


@query
def r05_rank_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_fusion(_lists(spark, sf)).withColumn("rrf", F.round("rrf", 9))


@query
def r06_vote_cap(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_fusion(_lists(spark, sf), cap=2).withColumn("rrf", F.round("rrf", 9))


@query
def r07_fused_pool(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fused_pool(_lists(spark, sf), cap=3).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "matched_by")


@query
def r09_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The fallback policy: sparse hits of the questions that no other vector answers with a cosine of 0.9."""
    lists = _lists(spark, sf).select("query_id", "chunk_id", "path", "score", "rank")
    return fusion.without_covered(lists.where("path = 'sparse'"), lists.where("path = 'dense' and rank > 1 and score >= 0.9")).select("query_id", "chunk_id")


@query
def f12_dense_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Dense hits over the threshold whose content holds a rare token of the question."""
    chunks = once(spark, sf).select("chunk_id", "content")
    rare = f07_discriminative(spark, sf).groupBy("query_id").agg(F.collect_set("token").alias("rare_tokens"))
    hits = _dense(spark, sf).join(chunks, "chunk_id").join(rare, "query_id", "left").withColumn("rare_tokens", F.coalesce("rare_tokens", F.array().cast("array<string>")))
    return gates.dense_gate(hits, 0.5).select("query_id", "chunk_id")


@query
def f13_sparse_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse hits of a score of 8 and more whose content holds a rare token of the question."""
    chunks = cut(once(spark, sf).select("chunk_id", "content"))
    rare = f07_discriminative(spark, sf).groupBy("query_id").agg(F.collect_set("token").alias("rare_tokens"))
    ranked = search.bm25_of_terms(_terms(spark, sf), chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), 20).withColumnRenamed("id", "chunk_id")
    hits = ranked.join(chunks, "chunk_id").join(rare, "query_id", "left").withColumn("rare_tokens", F.coalesce("rare_tokens", F.array().cast("array<string>")))
    return gates.sparse_gate(hits, 8.0).select("query_id", "chunk_id")


@query
def r10_diverse(spark: SparkSession, sf: str) -> DataFrame:
    chunks = once(spark, sf).select("chunk_id", F.col("page_start").alias("page"), "file_path")
    return fusion.diverse(fusion.fused_pool(_lists(spark, sf)).join(chunks, "chunk_id")).select("query_id", "rank", "chunk_id")


def _corpus(spark: SparkSession, sf: str) -> Corpus:
    chunks = cut(once(spark, sf))
    return Corpus(chunks, chunks.where("content is not null").select(F.col("chunk_id").alias("id"), embed(F.col("content"), dim=64).alias("v")))


#: The hashed vectors of the default provider give lower cosines than a model's.
HASHED = Settings(dense_min=0.35)


@query
def r12_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation's questions, most of which ask for names that no file has, and for each source the title of its first file, which should be found."""
    titles = table(spark, sf, "chunks").where("doc_title <> ''").groupBy(text.source_of(F.col("file_path")).alias("source")).agg(F.min("doc_title").alias("text"))
    asked = questions(spark, sf).unionByName(titles.where("source is not null").select(F.concat(F.lit("about "), "source").alias("query_id"), "text"))
    hits, verdicts = retrieve(asked, _corpus(spark, sf), HASHED)
    return verdicts.join(hits, "query_id", "left").select("query_id", "reason", "rank", "chunk_id", "matched_by", F.round("rrf", 6).alias("rrf"))


@query
def r04_hyde(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the reference answers as pseudo-documents from the cache."""
    q = questions(spark, sf)
    cache = table(spark, sf, "eval_cases").where("question is not null").select(text.cache_key(F.col("question")).alias("query"), F.col("reference_answer").alias("doc"), F.lit(1).cast("bigint").alias("ts"))
    pseudo = rewrite.pseudo_documents(q, cache).select("query_id", "doc")
    hits, _ = retrieve(q, _corpus(spark, sf), HASHED, pseudo=pseudo)
    return hits.select("query_id", "rank", "chunk_id", "matched_by")


@query
def x16_smoke(spark: SparkSession, sf: str) -> DataFrame:
    """For the mock vector of each case, the nearest vectors: how many, how many over 0.6, and the best cosine."""
    v = _vectors(spark, sf)
    asked = x14_mock_vectors(spark, sf).join(v.select(F.col("id").alias("vec_id"), "v"), "vec_id").select("query_id", "v")
    return smoke(Corpus(table(spark, sf, "chunks"), v.select("id", "v")), asked, 0.6)


@query
def r13_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The best by hashed vectors, else by words."""
    return baseline(questions(spark, sf), _corpus(spark, sf), HASHED).select("query_id", "rank", "chunk_id")


@query
def e01_embed(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that the default provider's vectors of all chunks fill, counted."""
    v = _corpus(spark, sf).vectors.select(F.posexplode("v").alias("column_no", "x")).where("x <> 0")
    return v.groupBy("column_no").agg(F.count(F.lit(1)).alias("n"))


@query
def s12_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The parents that children name, by id."""
    chunks = table(spark, sf, "chunks")
    wanted = chunks.where(~F.col("is_parent")).select(F.nullif("parent_chunk_id", F.lit("")).alias("chunk_id")).where("chunk_id is not null")
    return lookup(chunks.where("is_parent"), wanted, "chunk_id").groupBy("chunk_id").agg(F.max("file_path").alias("file_path"), F.max("chunk_index").alias("chunk_index"))


@query
def g11_ask(spark: SparkSession, sf: str) -> DataFrame:
    return ask(questions(spark, sf), _corpus(spark, sf), HASHED).select("query_id", "state", "text", "reason")


@query
def j04_child_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Children with the content of their parents."""
    chunks = table(spark, sf, "chunks")
    parents = chunks.where("is_parent").groupBy(F.col("chunk_id").alias("pid")).agg(F.max(F.length("content")).alias("parent_length"))
    kids = once(spark, sf).select("chunk_id", F.nullif("parent_chunk_id", F.lit("")).alias("pid"))
    return kids.join(parents, "pid", "left").select("chunk_id", "pid", "parent_length")


@query
def j11_orphans(spark: SparkSession, sf: str) -> DataFrame:
    kids = once(spark, sf).select("chunk_id", F.nullif("parent_chunk_id", F.lit("")).alias("pid")).where("pid is not null")
    return kids.join(table(spark, sf, "chunks").where("is_parent").select(F.col("chunk_id").alias("pid")), "pid", "left_anti").select("chunk_id", "pid")


# --- contexts and answers -------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf: str, k: int = 4) -> DataFrame:
    chunks = cut(once(spark, sf))
    texts = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))
    top = search.bm25_top_k(questions(spark, sf), texts, k).withColumnRenamed("id", "chunk_id")
    return top.join(chunks.select("chunk_id", "content", "file_name", "file_path", F.col("page_start").alias("page"), F.col("section_path").alias("section")), "chunk_id")


@query
def g01_context(spark: SparkSession, sf: str) -> DataFrame:
    return generation.contexts(_hits(spark, sf, 10), 1200).select("query_id", "n_blocks", "n_tokens", F.md5("context").alias("md5"))


@query
def g04_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Reference answers against the four best chunks of their questions."""
    per = _hits(spark, sf).groupBy("query_id").agg(F.collect_list("content").alias("contents"), F.collect_list("file_name").alias("names"))
    answers = table(spark, sf, "eval_cases").select(F.col("id").alias("query_id"), F.col("reference_answer").alias("answer"))
    return answers.join(per, "query_id", "left").select("query_id", generation.failure(F.col("answer"), F.coalesce("contents", F.array().cast("array<string>")), F.coalesce("names", F.array().cast("array<string>"))).alias("reason"))


@query
def g10_citations(spark: SparkSession, sf: str) -> DataFrame:
    return generation.citations(_hits(spark, sf))


# --- reports --------------------------------------------------------------------------------------------------------------


@query
def a06_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").groupBy("chunk_type", "is_parent").agg(F.countDistinct("chunk_id").alias("n"))


@query
def a07_token_stats(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.token_stats(table(spark, sf, "chunks"))


@query
def a10_hit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.hit_rates(a11_hit_flags(spark, sf))


@query
def a10_top1(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates of the dense list with the mean of its best scores."""
    names = table(spark, sf, "chunks").where(~F.col("is_parent")).select("chunk_id", "file_name").distinct()
    dense = _dense(spark, sf)
    flags = evaluation.hit_flags(table(spark, sf, "eval_cases"), dense.join(names, "chunk_id").select("query_id", "rank", "file_name"))
    best = dense.where("rank > 1").groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("top1"))
    return evaluation.hit_rates(flags.join(best, "id", "left"))


@query
def a11_hit_flags(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.hit_flags(table(spark, sf, "eval_cases"), _hits(spark, sf, 10))


@query
def f15_quality(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["content", "is_parent", "chunk_type", "doc_id", "doc_title", "page_start", "parent_chunk_id"]
    return evaluation.quality(table(spark, sf, "chunks").groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in cols]))


@query
def x01_event_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = event_rates(table(spark, sf, "events"), "1 day")
    return rates.select("start", "event_type", "n", F.round("total", 4).alias("total"))
