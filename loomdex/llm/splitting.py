"""Problem 1: cut oversized items at natural boundaries, with overlap.

Weights make token limits exact for a regular expression that can only count characters: a character in
U+4E00-9FFF weighs four quarter tokens and any other weighs one, so before matching every such character is
followed by three fillers. A bounded quantifier then counts quarter tokens. Alternatives are tried from the
strongest boundary (blank line) to the weakest (blank), each taking as much as fits but at least ``least`` of
the limit, and a plain run of characters is the fallback. The pieces partition the text; the overlap is looked
up behind each cut by a second, anchored expression.

Defined cases: null content gives no piece; empty or white-space content gives one piece as it is; a text within
the limit gives one piece; a text without any boundary is cut by characters; repeated rows of one chunk_id count
once where ``one_row_per_id`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import cjk_count, over_limit, token_count

FILL = "\ufdd0"  # a noncharacter
#: Zero-width conditions that hold just after a boundary, strongest first.
BOUNDARIES = ("(?<=\\n\\n)", "(?<=\\n)", "(?<=[.!?][ \\n])|(?<=[\u3002\uff01\uff1f])|(?<=[\u3002\uff01\uff1f]" + FILL + "{3})", "(?<=[,;:][ ])|(?<=[\uff0c\uff1b\uff1a\u3001])", "(?<=[ \\t\u3000])")


def _consume(most: int, least: int) -> str:
    tries = [f".{{{least},{most}}}(?:{b})(?!{FILL})" for b in BOUNDARIES]
    return "(?s)" + "|".join([*tries, f".{{1,{most}}}(?!{FILL})"])


def _behind(run: Column, overlap: int) -> Column:
    """The longest tail of at most ``overlap`` tokens that begins after a sentence, else after a blank, else of just so much."""
    if not overlap:
        return F.lit("")
    tail = F.substring(run, -4 * overlap, 4 * overlap)
    sentence = f"(?s)(?:(?<=[.!?][ \\n])|(?<=[\n\u3002\uff01\uff1f])|(?<=[\u3002\uff01\uff1f]{FILL}{{3}}))(?!{FILL}).+$"
    tries = [F.nullif(F.regexp_extract(tail, p, 0), F.lit("")) for p in (sentence, f"(?s)(?<=[ \u3000\uff0c\u3001])(?!{FILL}).+$", f"(?s)(?!{FILL}).+$")]
    return F.coalesce(*tries, F.lit(""))


def _pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column behind a generator, so that no later use evaluates its expression again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _runs(text: Column, limit: int, overlap: int, least: float) -> Column:
    # floor(w / 4) <= limit for w <= 4 * limit + 3
    most = 4 * (limit - overlap) + 3
    wide = F.regexp_replace(text, "[\\x{4e00}-\\x{9fff}]", "$0" + FILL * 3)
    return F.regexp_extract_all(wide, F.lit(_consume(most, max(1, int(most * least)))), F.lit(0))


def split_oversized(
    df: DataFrame, child_limit: int = 512, child_overlap: int = 64, parent_limit: int = 2048, parent_overlap: int = 128, least: float = 0.5, one_row_per_id: bool = False
) -> DataFrame:
    """Rows of chunks to rows of pieces: the given columns, with ``content`` and ``token_estimate`` of the piece, its
    ``piece_no`` (from 0), ``n_pieces``, ``start`` (the character, from 0, where the piece proper begins, which its overlap
    precedes) and ``piece_id``; parent_chunk_id and all other columns are kept, columns of these five names are replaced."""
    for limit, overlap in ((child_limit, child_overlap), (parent_limit, parent_overlap)):
        if not 0 <= overlap < limit:
            raise ValueError("overlap must be at least 0 and below the limit")
    if one_row_per_id:
        df = df.dropDuplicates(["chunk_id"])
    kept = [c for c in df.columns if c not in {"content", "token_estimate", "piece_no", "n_pieces", "start", "piece_id"}]
    text, parent = F.col("content"), F.coalesce(F.col("is_parent"), F.lit(False))
    # all other columns travel in one struct, where no name of theirs can clash
    df = _pin(df.where(text.isNotNull()).select(F.struct(*kept).alias("row"), "chunk_id", "is_parent", "content"), "__big", over_limit(text, F.when(parent, parent_limit).otherwise(child_limit)))
    big = F.col("__big")
    df = _pin(df, "__runs", F.when(big & parent, _runs(text, parent_limit, parent_overlap, least)).when(big, _runs(text, child_limit, child_overlap, least)).otherwise(F.array(text)))
    df = _pin(df, "__sizes", F.when(F.size("__runs") == 1, F.array(F.length("content"))).otherwise(F.transform("__runs", lambda r: F.length(r) - 3 * cjk_count(r))))
    ends = F.aggregate("__sizes", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    df = _pin(df, "__starts", ends).select("*", F.posexplode("__sizes").alias("piece_no", "__size"))
    at, start = F.col("piece_no"), F.get(F.col("__starts"), F.col("piece_no"))
    tail = F.get(F.col("__runs"), at - 1)
    behind = [_behind(tail, o) for o in (parent_overlap, child_overlap)]
    df = _pin(df, "__before", F.when(at == 0, "").when(parent, behind[0]).otherwise(behind[1]))
    n = F.length("__before") - 3 * cjk_count(F.col("__before"))
    df = _pin(df, "__piece", F.when(F.size("__sizes") == 1, text).otherwise(F.substring(text, start - n + 1, n + F.col("__size"))))
    return df.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.size("__sizes").alias("n_pieces"),
        "piece_no",
        start.alias("start"),
        F.substring(F.sha2(F.concat_ws("|", F.col("chunk_id"), at), 256), 1, 16).alias("piece_id"),
        F.col("__piece").alias("content"),
        token_count(F.col("__piece")).alias("token_estimate"),
    )
