"""Text expressions that stay inside whole-stage codegen, and the pattern of a word that Python operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One Han character or kana, or an unbroken run of other letters and digits (Python syntax).
WORD = "[\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff]|[^\\W_\u3400-\u4dbf\u4e00-\u9fff\u3040-\u30ff]+"


def cjk_count(text: Column) -> Column:
    """Characters in U+4E00-9FFF."""
    return F.length(F.regexp_replace(text, "[^\\x{4e00}-\\x{9fff}]+", ""))


def token_count(text: Column) -> Column:
    """floor(c + n / 4) for c characters in U+4E00-9FFF and n others; null for null."""
    c = cjk_count(text)
    return F.floor(c + (F.length(text) - c) * F.lit(0.25)).cast("int")


def over_limit(text: Column, limit: Column) -> Column:
    """token_count(text) > limit. A token takes three bytes at least, so most texts are settled by their size."""
    return (F.octet_length(text) > 3 * limit) & (token_count(text) > limit)


def norm_key(line: Column) -> Column:
    """Lower case, runs of digits to ``#``, runs of blanks to one blank, outer white space off."""
    folded = F.regexp_replace(F.lower(line), "(?U)\\d+", "#")
    return F.regexp_replace(F.regexp_replace(folded, "[ \\t]+", " "), "(?U)^\\s+|\\s+$", "")


def source_of(path: Column) -> Column:
    """The directory just below ``corpus``, with either slash; null where the path has none."""
    found = F.regexp_extract(path, "(?:^|[/\\\\])corpus[/\\\\]([^/\\\\]+)[/\\\\]", 1)
    return F.nullif(found, F.lit(""))


def truncate(text: Column, most: int) -> Column:
    """The text where it has at most ``most`` tokens, else its first floor(3.6 * most) characters."""
    return F.when(token_count(text) <= most, text).otherwise(F.substring(text, 1, int(most * 3.6)))


def first_words(text: Column, n: int) -> Column:
    """The first n words between white space, joined by blanks; a text with no more words as it is."""
    ws = F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")
    return F.when(F.size(ws) <= n, text).otherwise(F.array_join(F.slice(ws, 1, n), " "))


def words(text: Column) -> Column:
    """array<string>: each Han character or kana, and each other run of letters and digits, in lower case."""
    apart = F.regexp_replace(F.lower(text), "([\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{3040}-\\x{30ff}])", " $1 ")
    return F.filter(F.split(apart, "[^\\p{L}\\p{N}\\x{3040}-\\x{30ff}]+"), lambda w: w != "")


def english_tokens(query: Column) -> Column:
    """Distinct tokens of ASCII letters, digits and ``_ - .``, of two characters and more, in lower case and order."""
    found = F.regexp_extract_all(query, F.lit("[A-Za-z0-9][A-Za-z0-9_\\-.]*"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) >= 2), lambda t: F.lower(t)))


def cache_key(query: Column) -> Column:
    """White space to single blanks, lower case, outer punctuation off."""
    folded = F.lower(F.regexp_replace(F.regexp_replace(query, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " "))
    return F.regexp_replace(folded, "^[?？!！。，,、;；:：.·\\-_ ]+|[?？!！。，,、;；:：.·\\-_ ]+$", "")


def tier(pages: Column) -> Column:
    """struct<name, size, overlap, parent> by page count."""
    from loomdex.config import TIERS

    out = None
    for name, most, size, overlap, parent in TIERS:
        s = F.struct(F.lit(name).alias("name"), F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), F.lit(parent).alias("parent"))
        out = F.when(pages <= most, s) if out is None else out.when(pages <= most, s)
    return out
