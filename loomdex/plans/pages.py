"""Registered queries of page structures, sentences and packing. Their SQL stands in plans/oracle_pages.py.

The test tables hold no pages, so these are laid out from segments: every line of a segment is a block at a place that follows from its numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import cleaning
from loomdex.functions.text import token_count
from loomdex.operators import chunking, gates, structure
from loomdex.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "segments").groupBy("doc", "seg_no").agg(F.max(F.struct(F.coalesce("page", F.lit(0)).alias("page"), "text", "kind", "level")).alias("r"))
    return rows.select("doc", "seg_no", "r.*").where("text is not null")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, page, seg_no, line_no, x0, y0, x1, y1, text, size, bold, is_code): a line is 12 points high, every third stands in a right column and goes back to the top."""
    lines = _segments(spark, sf).select("doc", "page", "seg_no", "kind", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    right = F.when(F.col("line_no") % 3 == 2, 1).otherwise(0)
    x0, y0 = 50.0 + 250.0 * right, 40.0 + 12.0 * F.col("line_no") + 5.0 * (F.col("seg_no") % 7) - 18.0 * right
    size = 9.0 + 0.7 * (F.length("text") % 6)
    return lines.select("doc", "page", "seg_no", "line_no", x0.alias("x0"), y0.alias("y0"), (x0 + 200.0).alias("x1"), (y0 + 10.0).alias("y1"), "text", size.alias("size"), (F.length("text") % 7 == 0).alias("bold"), (F.col("kind") == "code").alias("is_code"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, page, blocks)."""
    fields = ["x0", "y0", "x1", "y1", "text", "size", "bold", "is_code"]
    rows = _blocks(spark, sf).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("seg_no", "line_no", F.struct(*fields).alias("b")))).alias("l"))  # one page
    return rows.select("doc", "page", F.transform("l", lambda x: x["b"]).alias("blocks"))


@query
def lay01_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with an image (every second) and little text."""
    pages = _segments(spark, sf).groupBy("doc", "page").agg(F.sum(F.length("text")).alias("n"), F.max("text").alias("text"), F.count(F.lit(1)).alias("k"))
    return pages.select("doc", "page", (structure.is_scan(F.col("text"), F.col("page") % 2 == 0, 400) & (F.col("k") == 1)).alias("scan"))


@query
def lay02_ocr_wanted(spark: SparkSession, sf: str) -> DataFrame:
    pages = lay01_scans(spark, sf).select("doc", F.col("page").alias("no"), "scan")
    return structure.ocr_wanted(pages, 2).select("doc", "no", "ocr")


@query
def lay03_ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words of segments, seven to a line in a slightly slanted row, some of them with little or unknown confidence."""
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    spot = lambda w, i: F.struct(((i % 7) * 10.0).alias("x"), (F.floor(i / 7) * 20.0 + i % 3).alias("y"), w.alias("text"), F.when(i % 11 == 0, None).otherwise((i % 10) / 10.0).alias("conf"))
    rows = _segments(spark, sf).select("doc", "seg_no", F.posexplode(structure.ocr_lines(F.transform(words, spot))).alias("n", "line"))
    return rows.select("doc", "seg_no", "n", "line")


@query
def lay06_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks outside of a table that covers a part of every page."""
    area = F.array(F.struct(F.lit(40.0).alias("x0"), F.lit(70.0).alias("y0"), F.lit(190.0).alias("x1"), F.lit(130.0).alias("y1")))
    kept = _pages(spark, sf).select("doc", "page", structure.outside_tables(F.col("blocks"), area).alias("b"))
    return kept.select("doc", "page", F.size("b").alias("n"), F.md5(F.array_join(F.transform("b", lambda b: b["text"]), "|")).alias("md5"))


@query
def lay07_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = _pages(spark, sf).select("doc", "page", F.posexplode(structure.reading_order(F.col("blocks"))).alias("n", "b"))
    return ordered.select("doc", "page", "n", "b.x0", "b.y0")


@query
def lay08_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's nations as a table, with a cell that is null and rows that are too short."""
    cells = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.concat(F.lit(" "), F.col("n_name")), F.lit(None).cast("string"))).otherwise(F.array("n_name"))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("r")))).alias("l"))
    head = F.array(F.array(F.lit("name"), F.lit("note\nof it")))
    return rows.select("n_regionkey", structure.markdown_table(F.concat(head, F.transform("l", lambda x: x["r"]))).alias("md"))


@query
def lay09_merged_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of orders as tables: an order is a table on the page of its day, its head is its priority; tables that go on over days are merged for each customer."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("doc"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("int").alias("day"), F.substring("o_orderpriority", 1, 1).alias("p"))
    w_pages = o.groupBy("doc", "day").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "p"))).alias("l"))  # one customer's day
    t = w_pages.select("doc", F.floor(F.col("day") / 30).cast("int").alias("page"), "day", F.explode("l").alias("x"))
    ranked = t.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("day", "x"))).alias("l")).select("doc", "page", F.size("l").alias("n_on_page"), F.posexplode("l").alias("pos", "y"))
    rows = F.array(F.array(F.when(F.col("y.x.p") < "4", "A").otherwise("B"), F.lit("key")), F.array(F.col("y.x.p"), F.col("y.x.o_orderkey").cast("string")))
    merged = structure.merge_tables(ranked.select("doc", "page", "pos", "n_on_page", rows.alias("rows")))
    return merged.select("doc", "page_start", "page_end", F.size("rows").alias("n_rows"))


@query
def lay10_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are a table of contents: a line is an entry that ends in dots if its number of characters is divisible by three."""
    line = F.when(F.length("text") % 3 == 0, F.concat("text", F.lit(" ........ "), F.col("line_no").cast("string"))).otherwise(F.col("text"))
    pages = _blocks(spark, sf).groupBy("doc", "page").agg(F.collect_list(line).alias("lines"))
    return pages.select("doc", "page", structure.is_toc(F.col("lines")).alias("toc"))


@query
def lay11_formulas(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).where(structure.is_formula(F.col("text"))).select("doc", "seg_no")


@query
def lay12_heading_sizes(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _blocks(spark, sf).select("doc", (F.col("seg_no") * 10_000 + F.col("line_no")).alias("seq"), "size")
    return structure.heading_sizes(blocks).select("doc", "body", F.array_join(F.transform("sizes", lambda x: F.round(x, 1).cast("string")), " ").alias("sizes"))


@query
def lay13_levels(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocks of each document have each heading level."""
    blocks = _blocks(spark, sf).withColumn("seq", F.col("seg_no") * 10_000 + F.col("line_no"))
    sizes = structure.heading_sizes(blocks.select("doc", "seq", "size"))
    return blocks.join(sizes, "doc").select("doc", structure.heading_level(F.col("size"), F.col("sizes")).alias("level")).groupBy("doc", "level").agg(F.count(F.lit(1)).alias("n"))


@query
def lay15_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of segments by their texts, with the level that the table gives for headings."""
    s = _segments(spark, sf)
    level = F.when(F.col("kind") == "heading", F.greatest(F.col("level"), F.lit(1))).otherwise(0)
    return s.select("doc", "seg_no", structure.segment_kind(F.col("text"), F.col("kind") == "code", level).alias("made"))


@query
def c04_clean_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of pages without learned head and foot lines and without noise. The first line of a page's first segment is followed by its document's running head."""
    pages = _pages(spark, sf)
    mark = lambda y0, text: F.struct(F.lit(50.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(250.0).alias("x1"), F.lit(y0 + 8.0).alias("y1"), text.alias("text"), F.lit(8.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("is_code"))
    running = F.concat(F.lit("Manual of "), F.substring_index(F.replace("doc", F.lit("\\"), F.lit("/")), "/", -1))
    foot = F.concat(F.lit("Copy "), F.col("page").cast("string"))
    pages = pages.select("doc", "page", F.concat(F.array(mark(5.0, running)), F.col("blocks"), F.array(mark(780.0, foot))).alias("blocks"))
    zone = F.filter("blocks", lambda b: cleaning.in_zone(b, F.lit(800.0)))
    lines = pages.select("doc", "page", F.explode(F.transform(zone, lambda b: F.get(F.split(b["text"], "\n"), 0))).alias("line"))
    noise = cleaning.learned_noise(lines).groupBy("doc").agg(F.collect_set("key").alias("noise"))  # head and foot lines of one document
    cleaned = pages.join(noise, "doc", "left").select("doc", "page", cleaning.clean_blocks(F.col("blocks"), F.col("noise"), F.lit(800.0)).alias("t"))
    return cleaned.select("doc", "page", F.size("t").alias("n"), F.md5(F.array_join("t", "\n")).alias("md5"))


@query
def c03_page_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Learned head and foot lines of the same pages."""
    pages = _segments(spark, sf).select("doc", "page").distinct()
    running = F.concat(F.lit("Manual of "), F.substring_index(F.replace("doc", F.lit("\\"), F.lit("/")), "/", -1))
    lines = pages.select("doc", "page", F.explode(F.array(running, F.concat(F.lit("Copy "), F.col("page").cast("string")), F.md5(F.concat("doc", F.col("page").cast("string"))))).alias("line"))
    return cleaning.learned_noise(lines)


@query
def t05_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(chunking.sentences_column(F.col("text"))).alias("n", "sentence")).select("doc_id", "n", "sentence")


@query
def t07_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of documents packed into windows of 128 tokens without overlap."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", chunking.units(F.col("text")).alias("u"))
    return chunking.packed(d, "u", 128, 0).select("doc_id", "window_no", "first", "last")


@query
def t08_oversize(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of documents with more than 24 tokens, without their white space, cut as runs without any boundary: nothing may be lost, and no piece be too long."""
    big = t05_sentences(spark, sf).where(token_count(F.col("sentence")) > 24).select("doc_id", "n", F.regexp_replace("sentence", "(?U)\\s+", "").alias("run"))
    made = chunking.split_column(big, "run", lambda t: chunking.cut_run(t, 24))
    return made.select("doc_id", "n", F.size(F.filter("pieces", lambda p: token_count(p) > 24)).alias("n_over"), F.md5(F.array_join("pieces", "")).alias("md5"))


@query
def t09_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of chunks cut into pieces of 128 tokens under their heads."""
    rows = table(spark, sf, "chunks").where("chunk_type = 'table' and not is_parent and content is not null").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    made = chunking.split_column(rows, "content", lambda t: chunking.split_table(t, 128))
    return made.select("chunk_id", F.posexplode("pieces").alias("n", "piece")).select("chunk_id", "n", "piece")


@query
def t10_code(spark: SparkSession, sf: str) -> DataFrame:
    """Code of chunks cut into pieces of 128 tokens, each but the first under a mark."""
    rows = table(spark, sf, "chunks").where("chunk_type = 'code' and not is_parent and content is not null").select("chunk_id", "content").dropDuplicates(["chunk_id"])
    made = chunking.split_column(rows, "content", lambda t: chunking.split_code(t, 128))
    return made.select("chunk_id", F.posexplode("pieces").alias("n", "piece")).select("chunk_id", "n", "piece")


@query
def f04_has_rare_token(spark: SparkSession, sf: str) -> DataFrame:
    """Which cases' reference answers hold which long words of their own questions, letter case apart."""
    e = table(spark, sf, "eval_cases").where("question is not null and reference_answer is not null")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 7))
    return e.select(F.col("id").alias("case_id"), F.size(words).alias("n"), gates.holds_any(F.col("reference_answer"), words).alias("holds"))
