"""Query variants: dictionary translation, command forms, conjunction parts, pseudo-documents and their cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import TERMS
from loomdex.functions.text import cache_key, first_words

MOST_TERMS = 4


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def translations(query: Column, terms: dict[str, str] = TERMS) -> Column:
    """array<string>: for a query with Han characters, its ASCII words with the translations of its first terms, and these alone."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(zh).alias("zh"), F.split(F.lit(en), " ").alias("en")) for i, (zh, en) in enumerate(terms.items())])
    found = F.array_sort(F.transform(F.filter(table, lambda t: F.contains(query, t["zh"])), lambda t: F.struct(F.instr(query, t["zh"]).alias("at"), t["i"].alias("i"), t["en"].alias("en"))))
    own = F.regexp_extract_all(query, F.lit("[A-Za-z0-9][A-Za-z0-9_\\-.]*"), F.lit(0))
    known = F.transform(own, lambda x: F.lower(x))
    new = F.array_distinct(F.filter(F.flatten(F.transform(F.slice(found, 1, MOST_TERMS), lambda t: t["en"])), lambda w: ~F.array_contains(known, F.lower(w))))
    merged, plain = F.array_join(new, " "), F.array_join(own, " ")
    both = F.when(F.size(own) > 0, F.array(_trim(F.concat(plain, F.lit(" "), merged)))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(query.rlike("[\\x{4e00}-\\x{9fff}]") & (F.size(found) > 0), F.concat(both, F.array(merged))).otherwise(none)


def commands(query: Column) -> Column:
    """array<string>: each command without its prefix, with underscores and with blanks."""
    found = F.regexp_extract_all(query, F.lit("\\b[sS][vV][cC][_\\-][a-zA-Z_]+"), F.lit(0))
    found = F.filter(found, lambda x: x.rlike("^svc"))
    body = lambda x: F.substr(x, F.lit(5))
    return F.flatten(F.transform(found, lambda x: F.array(body(x), F.replace(body(x), F.lit("_"), F.lit(" ")))))


def parts(query: Column) -> Column:
    """array<string>: the parts of a long query between conjunctions."""
    cut = F.transform(F.split(query, "[和、]"), lambda p: F.regexp_replace(p, "^[ ?？，,。.]+|[ ?？，,。.]+$", ""))
    return F.when((F.length(query) > 20) & query.rlike("[和、]"), F.filter(cut, lambda p: F.length(p) >= 4)).otherwise(F.array().cast("array<string>"))


def variants(query: Column, terms: dict[str, str] = TERMS) -> Column:
    """array<string>: the query first, then distinct variants of two characters and more."""
    more = F.filter(F.transform(F.concat(translations(query, terms), commands(query), parts(query)), _trim), lambda v: F.length(v) >= 2)
    return F.array_distinct(F.concat(F.array(query), more))


def lru(accesses: DataFrame, size: int) -> DataFrame:
    """(key, last_used): what a cache of ``size`` entries holds after accesses (key, seq); ties in seq go to the greater key."""
    last = accesses.groupBy("key").agg(F.max("seq").alias("last_used"))
    return last.orderBy(F.desc("last_used"), F.desc("key")).limit(size)


def pseudo_documents(queries: DataFrame, cache: DataFrame, generate=None, most_words: int = 45, least_words: int = 8) -> DataFrame:
    """(query_id, text, doc, cached): the cached pseudo-document of a query (by its folded key), else a generated one, else null.

    ``generate`` maps a DataFrame (query_id, text) to (query_id, doc) and is given only the queries that the cache lacks. An answer is cut at its
    first blank line and at ``most_words``; fewer than ``least_words`` count as a failure."""
    keyed = queries.select("query_id", "text", cache_key(F.col("text")).alias("key"))
    latest = cache.groupBy(F.col("query").alias("key")).agg(F.max_by("doc", "ts").alias("doc")).where("doc <> ''")
    hit = keyed.join(latest, "key", "left")
    known = hit.where("doc is not null").select("query_id", "text", "doc", F.lit(True).alias("cached"))
    open_ = hit.where("doc is null").select("query_id", "text")
    if generate is None:
        return known.unionByName(open_.select("query_id", "text", F.lit(None).cast("string").alias("doc"), F.lit(False).alias("cached")))
    bare = F.split(F.regexp_replace("doc", "(?s)<think>.*?</think>", ""), "\n\n")
    made = generate(open_).select("query_id", first_words(F.trim(F.get(bare, 0)), most_words).alias("doc"))
    fine = made.where(F.size(F.filter(F.split("doc", "(?U)\\s+"), lambda w: w != "")) >= least_words)
    return known.unionByName(open_.join(fine, "query_id", "left").select("query_id", "text", "doc", F.lit(False).alias("cached")))


def put(cache: DataFrame, made: DataFrame, size: int = 200) -> DataFrame:
    """The cache (query, doc, ts) with new rows (query, doc, ts) under folded keys; the newest ``size`` stay."""
    new = made.select(cache_key(F.col("query")).alias("query"), "doc", "ts")
    every = cache.select("query", "doc", "ts", F.lit(0).alias("__new")).unionByName(new.withColumn("__new", F.lit(1)))
    one = every.groupBy("query").agg(F.max_by(F.struct("doc", "ts"), F.struct("ts", "__new")).alias("x"))
    return one.select("query", "x.doc", "x.ts").orderBy(F.desc("ts"), F.desc("query")).limit(size)
