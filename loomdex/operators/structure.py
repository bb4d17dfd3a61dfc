"""Page structures of PDF files: predicates, tables, columns, headings, sections. Pages are rows of nested structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "struct<x0:double,y0:double,x1:double,y1:double,text:string,size:double,bold:boolean,is_code:boolean>"

# Characters and patterns of formulas, lines of tables of contents, fonts of code.
MATH = "∑∏∫∝∈∉∀∃∇≤≥≠±×÷√∞αβγδεθλμπσφψωΔΣΩΦΨ⊂⊃∪∩→←⇒⇔"
FORMULA = (
    r"\$[^$]{1,120}\$",
    r"\\(?:begin|frac|sum|int|sqrt|alpha|beta|delta|sigma|omega)\b",
    r"[A-Za-z]\s*(?:\^\{?\d|\_\{?\d)",
    r"(?:^|\s)[A-Za-z]{1,3}\s*=\s*[^=]{1,40}(?:$|\s)",
)
CODE_FONT = "mono|courier|consolas|code|terminal"
TOC_HEAD, TOC_NUMBER, TOC_DOTS = r"^(?:table\s+of\s+)?contents?$", r"^\d+(?:\.\d+)+\.?$", r"\.{4,}\s*\d+\s*$"


def is_scan(text: Column, has_image: Column, least: int = 80) -> Column:
    """A page with an image and under ``least`` characters of text."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < least) & F.coalesce(has_image, F.lit(False))


def ocr_wanted(pages: DataFrame, most: int = 80) -> DataFrame:
    """pages (doc, no, scan) with ``ocr``: scanned pages of documents that have at most ``most`` of them."""
    n = F.sum(F.col("scan").cast("int")).over(Window.partitionBy("doc"))
    return pages.withColumn("ocr", F.col("scan") & (n <= most))


def ocr_lines(words: Column, gap: float = 8.0, least_confidence: float = 0.5) -> Column:
    """array<string>: recognised words (x, y, text, conf) to lines. A line takes the words within ``gap`` of its first word's y; unknown
    confidences count as 1."""
    kept = F.array_sort(F.transform(F.filter(words, lambda w: F.coalesce(w["conf"], F.lit(1.0)) >= least_confidence), lambda w: F.struct(w["y"].alias("y"), w["x"].alias("x"), w["text"].alias("text"))))
    kind = "array<struct<y:double,words:array<struct<x:double,text:string>>>>"

    def step(acc, w):
        own = F.struct(w["x"].alias("x"), w["text"].alias("text"))
        fits = (F.size(acc) > 0) & (F.abs(w["y"] - F.element_at(acc, -1)["y"]) <= gap)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["y"].alias("y"), F.concat(F.element_at(acc, -1)["words"], F.array(own)).alias("words"))))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(F.struct(w["y"].alias("y"), F.array(own).alias("words")))))

    rows = F.aggregate(kept, F.array().cast(kind), step)
    return F.transform(rows, lambda r: F.array_join(F.transform(F.array_sort(r["words"]), lambda w: w["text"]), " "))


def overlap_ratio(a: Column, b: Column) -> Column:
    """The part of rectangle a inside rectangle b; areas below 1 count as 1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / F.greatest(F.lit(1.0), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]))


def outside_tables(blocks: Column, tables: Column) -> Column:
    """Blocks of which at most half lies in one table's rectangle."""
    return F.filter(blocks, lambda b: ~F.exists(tables, lambda t: overlap_ratio(b, t) > 0.5))


def reading_order(blocks: Column) -> Column:
    """Blocks column by column: sorted by (y0, x0), a block that begins over two points above the lowest edge so far opens a column; columns
    are ordered by their least x0. Fewer than six blocks stay in order of (y0, x0)."""
    keyed = F.array_sort(F.transform(blocks, lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b.alias("b"))))
    plain = F.transform(keyed, lambda k: k["b"])
    kind = f"array<struct<bottom:double,left:double,blocks:array<{BLOCK}>>>"

    def step(acc, b):
        last = F.element_at(acc, -1)
        opens = (F.size(acc) == 0) | (b["y0"] < last["bottom"] - 2)
        fresh = F.concat(acc, F.array(F.struct(b["y1"].alias("bottom"), b["x0"].alias("left"), F.array(b).alias("blocks"))))
        grown = F.struct(F.greatest(last["bottom"], b["y1"]).alias("bottom"), F.least(last["left"], b["x0"]).alias("left"), F.concat(last["blocks"], F.array(b)).alias("blocks"))
        return F.when(opens, fresh).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    columns = F.aggregate(plain, F.array().cast(kind), step)
    ordered = F.array_sort(F.transform(columns, lambda c, i: F.struct(c["left"].alias("left"), i.alias("i"), c["blocks"].alias("blocks"))))
    return F.when(F.size(blocks) < 6, plain).otherwise(F.flatten(F.transform(ordered, lambda c: c["blocks"])))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> to a Markdown table: nulls empty, line breaks blanks, rows padded or cut to the width of the head."""
    cell = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    width = F.size(F.get(rows, 0))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width)), 1, width), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.concat(F.array(line(F.get(rows, 0)), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("")


def merge_tables(tables: DataFrame) -> DataFrame:
    """(doc, page_start, page_end, rows): tables (doc, page, pos, n_on_page, rows) that go on over pages made one.

    A table goes on if it is the last of its page, the next page's first has as many columns and the same non-empty head; whole runs are merged,
    the repeated heads dropped."""
    head = F.transform(F.get("rows", 0), lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    t = tables.withColumn("head", head).withColumn("last", F.col("pos") == F.col("n_on_page") - 1)
    w = Window.partitionBy("doc").orderBy("page", "pos")
    before = {c: F.lag(c).over(w) for c in ("page", "head", "last")}
    goes_on = (F.col("pos") == 0) & before["last"] & (F.col("page") == before["page"] + 1) & (F.col("head") == before["head"]) & (F.array_join("head", "") != "")
    runs = t.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(F.col("new") == 1, F.col("rows")).otherwise(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))))
    grouped = runs.groupBy("doc", "run").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_sort(F.collect_list(F.struct("page", "pos", body.alias("body")))).alias("parts"))
    return grouped.select("doc", "page_start", "page_end", F.flatten(F.transform("parts", lambda p: p["body"])).alias("rows"))


def is_toc(lines: Column, ratio: float = 0.35) -> Column:
    """Whether the lines of a page are a table of contents: its heading, or enough entries."""
    bare = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    entries = F.size(F.filter(bare, lambda x: x.rlike(TOC_NUMBER) | x.rlike(TOC_DOTS)))
    return F.exists(bare, lambda x: x.rlike("(?i)" + TOC_HEAD)) | ((F.size(bare) > 0) & (entries >= ratio * F.size(bare)))


def is_formula(text: Column, density: float = 0.04) -> Column:
    found = text.rlike(FORMULA[0])
    for p in FORMULA[1:]:
        found = found | text.rlike(p)
    signs = F.length(F.regexp_replace(text, f"[^{MATH}]+", ""))
    return found | ((F.length(text) > 0) & (signs > density * F.length(text)))


def heading_sizes(blocks: DataFrame, most: int = 6) -> DataFrame:
    """(doc, body, sizes): the commonest font size of a document's blocks (doc, seq, size), the first seen among equals, and the distinct sizes
    over 1.06 of it, the largest first."""
    rounded = blocks.where("size is not null").select("doc", "seq", F.bround("size", 1).alias("size"))
    counted = rounded.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    body = counted.groupBy("doc").agg(F.max_by("size", F.struct("n", (-F.col("first")).alias("f"))).alias("body"), F.collect_set("size").alias("sizes"))
    large = F.sort_array(F.filter("sizes", lambda s: s > 1.06 * F.col("body")), asc=False)
    return body.select("doc", "body", F.slice(large, 1, most).alias("sizes"))


def heading_level(size: Column, sizes: Column) -> Column:
    """From 1 for the largest heading; 0 for text. The size is compared as it is with the rounded sizes."""
    return F.coalesce(F.array_position(F.transform(sizes, lambda s: size >= s), True), F.lit(0)).cast("int")


def section_paths(segments: DataFrame, levels: int = 6) -> DataFrame:
    """segments (doc, seg_no, kind, level, text) with ``path``: the open headings, joined by " > ". A heading closes those of its level and below.

    One window for each level: the last heading of the level counts if no shallower one came after it."""
    w = Window.partitionBy("doc").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.substring(F.regexp_replace(F.trim(F.split("text", "\n")[0]), "\\s+", " "), 1, 120)
    out = segments.withColumn("__t", F.when(F.col("kind") == "heading", title))
    names = []
    for n in range(1, levels + 1):
        at = F.last(F.when((F.col("kind") == "heading") & (F.col("level") == n), F.struct("seg_no", "__t")), ignorenulls=True).over(w)
        closed = F.max(F.when((F.col("kind") == "heading") & (F.col("level") < n), F.col("seg_no"))).over(w)
        out = out.withColumn(f"__a{n}", at).withColumn(f"__c{n}", closed)
        names.append(F.when(F.col(f"__c{n}").isNull() | (F.col(f"__a{n}.seg_no") > F.col(f"__c{n}")), F.col(f"__a{n}.__t")))
    return out.withColumn("path", F.concat_ws(" > ", *names)).select(*segments.columns, "path")


def segment_kind(text: Column, is_code: Column, level: Column) -> Column:
    return F.when(level > 0, "heading").when(is_code, "code").when(is_formula(text), "formula").otherwise("text")
