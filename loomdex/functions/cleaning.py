"""Cleaning expressions: noise lines, scrubbing, paragraphs, language by script."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import NOISE_PATTERNS
from loomdex.functions.text import cjk_count, norm_key


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def is_noise(line: Column) -> Column:
    """Whether a line is page furniture or a legal notice; blank lines are not."""
    bare = strip(line)
    return (F.length(bare) > 0) & reduce(lambda a, b: a | b, [bare.rlike(f"(?iU){p}") for p in NOISE_PATTERNS])


def scrub(text: Column) -> Column:
    """Control characters and U+FFFD off, no-break blanks to blanks, words cut at a line end joined, runs of blanks to one, lines stripped,
    three and more newlines to two."""
    t = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{fffd}]", "")
    t = F.regexp_replace(t, "\\x{a0}", " ")
    t = F.regexp_replace(t, "([A-Za-z])-\\n([a-z])", "$1$2")
    lines = F.transform(F.split(t, "\n"), lambda x: strip(F.regexp_replace(x, "[ \\t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"))


def clean_text(text: Column) -> Column:
    return scrub(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_noise(x)), "\n"))


def paragraphs(text: Column) -> Column:
    """array<string>: what stands between blank lines, stripped, empty ones off."""
    return F.filter(F.transform(F.split(text, "(?U)\\n\\s*\\n"), strip), lambda x: F.length(x) > 0)


def dedup_paragraphs(text: Column) -> Column:
    """Paragraphs without those whose key equals that of the paragraph before."""
    ps = paragraphs(text)
    kept = F.filter(ps, lambda p, i: (i == 0) | (norm_key(p) != norm_key(F.coalesce(F.get(ps, i - 1), F.lit("")))))
    return F.array_join(kept, "\n\n")


def language_by_script(text: Column) -> Column:
    """zh if over five in a hundred of the first 4000 characters are CJK, else en; en for an empty text."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    return F.when(cjk_count(head) > F.lit(0.05) * F.length(head), "zh").otherwise("en")


def learned_noise(lines: DataFrame, ratio: float = 0.30) -> DataFrame:
    """(doc, key, n_pages): keys of lines (doc, page, line) in the head or foot zone that recur on enough pages of their document.

    A document of fewer than three pages has none; a key must stand on max(3, floor(ratio * pages)) pages."""
    keyed = lines.select("doc", "page", norm_key(F.col("line")).alias("key")).where("key <> ''")
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    counted = keyed.groupBy("doc", "key").agg(F.countDistinct("page").alias("n_pages"))
    return counted.join(pages, "doc").where("pages >= 3").where(F.col("n_pages") >= F.greatest(F.lit(3), F.floor(F.col("pages") * ratio))).select("doc", "key", "n_pages")


def in_zone(block: Column, height: Column, zone: float = 0.12) -> Column:
    """Whether a block lies wholly in the head or the foot of its page."""
    return (block["y1"] <= height * zone) | (block["y0"] >= height * (1 - zone))


def clean_blocks(blocks: Column, noise: Column, height: Column, zone: float = 0.12) -> Column:
    """array<string>: the texts of a page's blocks. Blocks of the head or foot zone whose first line has a learned key are dropped, then noise lines;
    what is left is scrubbed, and empty texts are dropped."""
    kept = F.filter(blocks, lambda b: ~(in_zone(b, height, zone) & F.array_contains(F.coalesce(noise, F.array().cast("array<string>")), norm_key(F.get(F.split(b["text"], "\n"), 0)))))
    return F.filter(F.transform(kept, lambda b: clean_text(b["text"])), lambda t: t != "")
