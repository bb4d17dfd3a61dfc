"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.boilerplate import Boilerplate
from loomdex.llm.encoding import decode, encode, encode_with_offsets
from loomdex.llm import languages, mojibake, scans
from loomdex.llm.leakage import leaks
from loomdex.llm.near_duplicates import NearDuplicates
from loomdex.llm.similar_vectors import SimilarVectors, usable
from loomdex.llm.splitting import split_oversized
from loomdex.sources.tables import children, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(table(spark, sf, "chunks")).where("n_pieces > 1").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    cols = table(spark, sf, "chunks").select("chunk_id", "content", "is_parent", "parent_chunk_id", "token_estimate")
    return split_oversized(cols, one_row_per_id=True)


def _boilerplate(spark: SparkSession, sf: str) -> Boilerplate:
    return Boilerplate(children(spark, sf, "chunk_id", "content", "file_path"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _boilerplate(spark, sf).occurrences().select("chunk_id", "line_no")


def p4_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return _boilerplate(spark, sf).cleaned()


def _near(spark: SparkSession, sf: str, threshold: float, size: int) -> NearDuplicates:
    return NearDuplicates(children(spark, sf, F.col("chunk_id").alias("id"), F.col("content").alias("text")), threshold, size)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 0.7, 3).pairs().select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf, 0.8, 5).groups()


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"))


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return decode(encode_with_offsets(table(spark, sf, "documents")))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_cases").select("id", "question", "reference_answer"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).where("n_windows > 0").select("doc_id", "case_id").distinct()


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items: how many documents hold a passage of each field."""
    return _leaks(spark, sf).where("n_windows > 0").groupBy("case_id", "field").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_windows").alias("most_windows"))


def p9_near(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an edited item, and no equal passage of that field."""
    return _leaks(spark, sf).where("n_windows = 0").select("doc_id", "case_id", "field", F.round("similarity", 6).alias("similarity"))


def _vectors(spark: SparkSession, sf: str) -> SimilarVectors:
    return SimilarVectors(usable(table(spark, sf, "chunk_vectors")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).pairs(0.9).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p2_top10(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all vectors."""
    return _vectors(spark, sf).top(10)


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    chunks, segments = table(spark, sf, "chunks"), table(spark, sf, "segments")
    texts = chunks.where(~F.col("is_parent")).select(F.col("content").alias("text")).unionByName(segments.select("text"))
    return scans.repaired(scans.scanned_records(chunks, segments), scans.lexicon(texts))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf).select("tab", "rec_key").distinct()


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf).dropDuplicates(["tab", "rec_key"])


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.col("chunk_type").isin("text", "figure_caption")
    return table(spark, sf, "chunks").where(~F.col("is_parent") & wanted).select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), F.col("language").alias("label"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = _labelled(spark, sf)
    return languages.corrections(texts, languages.fit(texts)).select(F.col("id").alias("chunk_id"), "lang")


def p7_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of one language of every text."""
    texts = _labelled(spark, sf)
    found = languages.detect(texts, languages.fit(texts)).dropDuplicates(["id"])
    return found.select(F.col("id").alias("chunk_id"), F.posexplode("segments").alias("segment_no", "s")).select("chunk_id", "segment_no", "s.start", "s.end", "s.lang", "s.confidence")


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return mojibake.repaired(documents, mojibake.train(documents))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_top10, p4_found, p4_cleaned, p5_found, p5_repaired, p6_found, p6_groups,
        p7_found, p7_segments, p8_ids, p8_round_trip, p9_found, p9_near, p9_report, p10_found, p10_restored,
    )
}

_TOKENS = "(length(regexp_replace({0}, '[^\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) + (length({0}) - length(regexp_replace({0}, '[^\\x{{4e00}}-\\x{{9fff}}]+', '', 'g'))) // 4)"

_FOLDED = (
    "regexp_replace(regexp_replace(regexp_replace(lower(l), '\\p{Nd}+', '0', 'g'), '[\\s\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{b}]+', ' ', 'g'),"
    " '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"
)

_WORDS = "regexp_extract_all(regexp_replace(lower({0}), '([\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+|[\\x{{3040}}-\\x{{30ff}}]')"

_REPEATED = f"""c AS (SELECT chunk_id, file_path, regexp_extract(file_path, '(?:^|[/\\\\])corpus[/\\\\]([^/\\\\]+)[/\\\\]', 1) AS src, content FROM chunks WHERE NOT is_parent),
        f AS (SELECT src, count(DISTINCT file_path) AS of FROM c GROUP BY src),
        s AS (SELECT chunk_id, file_path, src, string_split(content, chr(10)) AS ls FROM c WHERE content IS NOT NULL),
        u AS (SELECT chunk_id, file_path, src, unnest(ls) AS l, unnest(range(len(ls))) AS line_no FROM s),
        n AS (SELECT chunk_id, file_path, src, line_no, l, {_FOLDED} AS k FROM u),
        k AS (SELECT src, k FROM n JOIN f USING (src) WHERE regexp_matches(k, '\\p{{L}}') GROUP BY src, k, of HAVING count(DISTINCT file_path) >= 5 AND count(DISTINCT file_path) >= 0.2 * of)"""

_LEAKS = f"""d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents WHERE text IS NOT NULL),
        dw AS (SELECT doc_id, array_to_string(ws[i + 1:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(len(ws) - 11)) AS i FROM d WHERE len(ws) >= 12)),
        e AS (SELECT id AS case_id, 'question' AS field, {_WORDS.format('question')} AS ws FROM eval_cases UNION ALL SELECT id, 'reference_answer', {_WORDS.format('reference_answer')} FROM eval_cases),
        ew AS (SELECT case_id, field, array_to_string(ws[i + 1:i + 12], ' ') AS g FROM (SELECT case_id, field, ws, unnest(range(len(ws) - 11)) AS i FROM e WHERE len(ws) >= 12)),
        hit AS (SELECT doc_id, case_id, field, count(*) AS n FROM dw JOIN ew USING (g) GROUP BY ALL)"""

SQL: dict[str, str] = {
    "p2_found": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM chunk_vectors WHERE embedding IS NOT NULL AND len(embedding) = 64
            AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        u AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v) SELECT a.id AS vec_a, b.id AS vec_b FROM u a JOIN u b ON a.id < b.id AND list_dot_product(a.v, b.v) >= 0.9 * a.n * b.n""",
    "p4_cleaned": f"""WITH {_REPEATED}, g AS (SELECT DISTINCT n.chunk_id, n.line_no, n.l, k.k IS NOT NULL AS gone FROM n LEFT JOIN k ON k.src = n.src AND k.k = n.k)
        SELECT chunk_id, coalesce(string_agg(l, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS content, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed FROM g GROUP BY chunk_id HAVING bool_or(gone)""",
    "p6_found": f"""WITH c AS (SELECT DISTINCT chunk_id, {_WORDS.format('content')} AS ws FROM chunks WHERE NOT is_parent AND content IS NOT NULL),
        s AS (SELECT DISTINCT chunk_id, g FROM (SELECT chunk_id, array_to_string(ws[i + 1:i + 3], ' ') AS g FROM (SELECT chunk_id, ws, unnest(range(greatest(1, len(ws) - 2))) AS i FROM c))),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
        p AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT chunk_a, chunk_b FROM p JOIN n x ON x.chunk_id = chunk_a JOIN n y ON y.chunk_id = chunk_b WHERE c >= 0.7 * (x.n + y.n - c)""",
    "p9_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, case_id FROM hit",
    "p9_report": f"WITH {_LEAKS} SELECT case_id, field, count(*) AS n_documents, CAST(max(n) AS INTEGER) AS most_windows FROM hit GROUP BY case_id, field",
    "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE content IS NOT NULL AND {_TOKENS.format('content')} > CASE WHEN is_parent THEN 2048 ELSE 512 END",
    "p4_found": f"WITH {_REPEATED} SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM n JOIN k USING (src, k)",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
