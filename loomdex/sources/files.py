"""Files to segments: scan, hash, decode, and parsers for text, Markdown, HTML and DOCX. PDF and others plug in."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from io import BytesIO
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.config import DEFAULT, Settings
from loomdex.functions.cleaning import clean_text

SEGMENT = "doc string, seg_no int, page int, page_end int, heading string, text string, kind string, level int"
Segment = tuple  # page, page_end, heading, text, kind, level
Parser = Callable[[bytes], list[Segment]]
_parsers: dict[str, Parser] = {}


def parser(*extensions: str):
    """Register a parser for file endings."""

    def add(f: Parser) -> Parser:
        _parsers.update(dict.fromkeys(extensions, f))
        return f

    return add


def scan(spark: SparkSession, roots: list[str], settings: Settings = DEFAULT, any_size: bool = False) -> DataFrame:
    """(root, file_path, size, mtime, ext, content): all files of the allowed endings and, unless ``any_size``, of the allowed size; directories with an excluded
    name below the root are left out. Missing roots have no files."""
    out = None
    for root in roots:
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        glob = "*.{" + ",".join(x for e in settings.extensions for x in (e, e.upper())) + "}"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        below = F.split(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")), ""), "/")
        fine = (F.lit(any_size) | (F.col("length") <= settings.max_file_bytes)) & ~F.arrays_overlap(below, F.array(*[F.lit(x) for x in settings.excluded]))
        rows = files.where(fine).select(F.lit(root).alias("root"), F.col("path").alias("file_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("ms"), F.lower(F.substring_index("path", ".", -1)).alias("ext"), "content")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "root string, file_path string, size bigint, mtime double, ext string, content binary")
    return out.select("root", "file_path", "size", (F.col("ms") / 1000).alias("mtime"), "ext", "content")


def hashed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_hash", F.sha2("content", 256))


#: So many files are opened by their paths; more are read by another pass over the roots.
OPENED = 10_000


def contents(spark: SparkSession, roots: list[str], wanted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(file_path, ext, content) of the wanted files (file_path); the bytes of others aren't read where the wanted ones are few."""
    few = [r["file_path"] for r in wanted.select("file_path").distinct().limit(OPENED + 1).collect()]
    if len(few) > OPENED:
        return scan(spark, roots, settings).select("file_path", "ext", "content").join(wanted.select("file_path").distinct(), "file_path", "left_semi")
    if not few:
        return spark.createDataFrame([], "file_path string, ext string, content binary")
    # a path is a pattern to the reader, so the signs of patterns are escaped
    files = spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{},])", r"\\\1", p) for p in few])
    return files.select(F.col("path").alias("file_path"), F.lower(F.substring_index("path", ".", -1)).alias("ext"), "content")


def decode(raw: bytes) -> str:
    """By byte order mark UTF-16, else UTF-8, else the first codec that takes all bytes - double-byte ones only where most bytes beyond ASCII stand
    next to each other -, else UTF-8 with U+FFFD."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        pass
    high = np.frombuffer(raw, dtype=np.uint8) > 0x7F
    beside = high.copy()
    beside[1:-1] &= high[:-2] | high[2:]
    beside[:1] &= high[1:2] if len(high) > 1 else False
    beside[-1:] &= high[-2:-1] if len(high) > 1 else False
    for codec in (*(("gb18030", "cp932") if 2 * beside.sum() > high.sum() else ()), "cp1252"):
        try:
            return raw.decode(codec)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


@parser("txt")
def text_segments(raw: bytes) -> list[Segment]:
    text = decode(raw).replace("\r\n", "\n").strip()
    return [(None, None, "", text, "text", 0)] if text else []


@parser("md")
def markdown_segments(raw: bytes) -> list[Segment]:
    """Fenced blocks are code, lines with one to six hashes headings, what stands between them text under the open headings. A fence without an end is
    code up to the end of the file."""
    out: list[Segment] = []
    stack: list[tuple[int, str]] = []
    buf: list[str] = []
    fenced = False

    def flush(kind: str) -> None:
        text = "\n".join(buf).strip("\n" if kind == "code" else None)
        buf.clear()
        if text.strip():
            out.append((None, None, " > ".join(t for _, t in stack), text, kind, len(stack)))

    for line in decode(raw).replace("\r\n", "\n").split("\n"):
        if line.strip().startswith("```"):
            flush("code" if fenced else "text")
            fenced = not fenced
        elif not fenced and (m := re.match(r"^(#{1,6})\s+(.+)$", line)):
            flush("text")
            level, title = len(m[1]), m[2].strip()
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
            out.append((None, None, " > ".join(t for _, t in stack), title, "heading", level))
        else:
            buf.append(line)
    flush("code" if fenced else "text")
    return out


class _Text(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "header", "aside"}

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.open, self.parts = 0, [], {"article": [], "main": [], "body": [], "": []}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.SKIP
        if tag in self.parts:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.SKIP and self.depth > 0
        if tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data: str) -> None:
        if not self.depth and data.strip():
            for k in {*self.open, ""}:
                self.parts[k].append(data.strip())


@parser("html", "htm")
def html_segments(raw: bytes) -> list[Segment]:
    """The text of the article, else main, else body, else all, without scripts, styles and page furniture."""
    p = _Text()
    p.feed(decode(raw))
    text = "\n".join(next((v for k in ("article", "main", "body", "") if (v := p.parts[k])), []))
    return [(None, None, "", text, "text", 0)] if text else []


@parser("docx")
def docx_segments(raw: bytes) -> list[Segment]:
    """Paragraphs as one text, then each table in Markdown."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(raw)).read("word/document.xml")).find(f"{ns}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{ns}t"))
    text = "\n".join(s for p in body.findall(f"{ns}p") if (s := said(p).strip()))
    out: list[Segment] = [(None, None, "", text, "text", 0)] if text else []
    for t in body.findall(f"{ns}tbl"):
        rows = [[said(c).replace("\n", " ").strip() for c in r.findall(f"{ns}tc")] for r in t.findall(f"{ns}tr")]
        if rows:
            width = len(rows[0])
            lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
            out.append((None, None, "", "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]), "table", 0))
    return out


def parse(files: DataFrame) -> DataFrame:
    """Segments of files (file_path, ext, content), with ``error``: a file that can't be parsed gives one row with its error and no text. Running text is cleaned
    of noise lines and scrubbed; a segment that has nothing else is left out. Code, tables and headings stay as they are."""
    schema = SEGMENT + ", error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import loomdex.sources.pdf  # noqa: F401 - its parser registers itself

        for frame in frames:
            rows = []
            for path, ext, content in zip(frame["file_path"], frame["ext"], frame["content"], strict=True):
                try:
                    if ext not in _parsers:
                        raise ValueError(f"unsupported_format: {ext}")
                    rows += [(path, i, *s, None) for i, s in enumerate(_parsers[ext](bytes(content)))]
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                    said = str(e) if str(e).startswith("unsupported_format") else f"{type(e).__name__}: {e}"
                    rows.append((path, 0, None, None, None, None, None, None, said))
            made = pd.DataFrame(rows, columns=["doc", "seg_no", "page", "page_end", "heading", "text", "kind", "level", "error"])
            for c in ("seg_no", "page", "page_end", "level"):
                made[c] = made[c].astype("Int32")
            yield made

    made = files.select("file_path", "ext", "content").mapInPandas(run, schema)
    cleaned = made.withColumn("text", F.when(F.col("kind") == "text", clean_text(F.col("text"))).otherwise(F.col("text")))
    return cleaned.where("error is not null or text <> '' or kind = 'scan'")
