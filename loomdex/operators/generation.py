"""Contexts under a token budget, checks of answers, excerpts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.config import ABBREVIATIONS, INFERENCE_PHRASES
from loomdex.functions.text import token_count

OPEN, CLOSE, EMPTY = "【官方检索上下文开始】", "【官方检索上下文结束】", "（空）"
REFUSAL = "当前资料库中没有找到相关内容"


def block(rank: Column, file_name: Column, page: Column, section: Column, content: Column) -> Column:
    """One numbered block of a context."""
    source = F.concat(file_name, F.when(page.isNotNull() & (page != 0), F.concat(F.lit(" | 第"), page.cast("string"), F.lit("页"))).otherwise(""), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | 章节: "), section)).otherwise(""))
    return F.concat(F.lit("[片段"), rank.cast("string"), F.lit(" | 来源: "), source, F.lit("]\n"), content)


def contexts(hits: DataFrame, budget: int = 2800) -> DataFrame:
    """(query_id, context, n_blocks, n_tokens) from hits (query_id, rank, file_name, page, section, content): blocks up to the first that
    exceeds the budget."""
    made = hits.select("query_id", "rank", block(F.col("rank"), F.col("file_name"), F.col("page"), F.col("section"), F.col("content")).alias("block"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = made.withColumn("tokens", token_count(F.col("block"))).withColumn("upto", F.sum("tokens").over(w))
    fits = F.col("upto") <= budget
    per = summed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "block")))).alias("b"), F.coalesce(F.sum(F.when(fits, F.col("tokens"))), F.lit(0)).alias("n_tokens"))
    body = F.when(F.size("b") > 0, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).otherwise(EMPTY)
    return per.select("query_id", F.concat(F.lit(OPEN + "\n"), body, F.lit("\n" + CLOSE)).alias("context"), F.size("b").alias("n_blocks"), "n_tokens")


def refused(answer: Column) -> Column:
    return (F.trim(F.coalesce(answer, F.lit(""))) == "") | F.contains(answer, F.lit(REFUSAL))


def failure(answer: Column, contents: Column, names: Column) -> Column:
    """Why an answer isn't supported by its context, "" if it is. Rules in this order, the first match of a rule in the text: a cited block that
    doesn't exist; a phrase that appeals to other knowledge; an identifier, or a version of three or four parts, that no block has."""
    n = F.size(contents)
    text = F.lower(F.concat_ws("\n", contents, names))
    cited = F.regexp_extract_all(answer, F.lit("\\[(?:片段)?\\s*(\\d+)\\]"), F.lit(1))
    bad_cite = F.get(F.filter(cited, lambda c: F.try_to_number(c, F.lit("9999999999")) > n), 0)
    phrase = F.get(F.filter(F.array(*[F.lit(p) for p in INFERENCE_PHRASES]), lambda p: F.contains(answer, p)), 0)
    tokens = F.transform(F.regexp_extract_all(answer, F.lit("[A-Za-z][A-Za-z0-9_\\-./]{2,}"), F.lit(0)), lambda t: F.regexp_replace(t, "\\.+$", ""))
    exempt = F.array(*[F.lit(a) for a in ABBREVIATIONS])
    name = F.get(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~F.array_contains(exempt, F.lower(t)) & t.rlike("[_/\\-.]") & ~F.contains(text, F.lower(t))), 0)
    version = F.get(F.filter(F.regexp_extract_all(answer, F.lit("\\b\\d+\\.\\d+\\.\\d+(?:\\.\\d+)?\\b"), F.lit(0)), lambda v: ~F.contains(text, v)), 0)
    return F.coalesce(F.concat(F.lit("citation:"), bad_cite), F.concat(F.lit("inference:"), phrase), F.concat(F.lit("identifier:"), name), F.concat(F.lit("version:"), version), F.lit(""))


def responses(answers: DataFrame) -> DataFrame:
    """answers (query_id, answer, contents, names) with state (answer, refusal, excerpt), text and reason: refusals stay, unsupported
    answers are replaced by the blocks themselves."""
    why = failure(F.col("answer"), F.col("contents"), F.col("names"))
    pinned = answers.withColumn("__no", refused(F.col("answer"))).select("*", F.explode(F.array(why)).alias("__why"))
    state = F.when(F.col("__no"), "refusal").when(F.col("__why") == "", "answer").otherwise("excerpt")
    excerpt = F.concat(F.lit("原文摘录\n\n"), F.array_join(F.col("contents"), "\n\n"))
    text = F.when(F.col("__no"), REFUSAL).when(F.col("__why") == "", F.col("answer")).otherwise(excerpt)
    return pinned.select("query_id", state.alias("state"), text.alias("text"), F.when(F.col("__no"), "llm_refusal").otherwise(F.col("__why")).alias("reason"))


def file_uri(path: Column, page: Column) -> Column:
    """A file URI with all but slashes and colons percent-encoded, and the page as its fragment."""
    quoted = F.replace(F.replace(F.replace(F.url_encode(F.replace(path, F.lit("\\"), F.lit("/"))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    uri = F.concat(F.lit("file:///"), F.regexp_replace(quoted, "^/+", ""))
    return F.when(page.isNotNull() & (page != 0), F.concat(uri, F.lit("#page="), page.cast("string"))).otherwise(uri)


def hyperlink(uri: Column, text: Column) -> Column:
    """A terminal hyperlink; the text alone where the URI is empty."""
    esc = "\x1b"
    return F.when(F.coalesce(uri, F.lit("")) == "", text).otherwise(F.concat(F.lit(esc + "]8;;"), uri, F.lit(esc + "\\"), text, F.lit(esc + "]8;;" + esc + "\\")))


def citations(hits: DataFrame) -> DataFrame:
    """(query_id, rank, file_name, page, chunk_id, uri, excerpt)."""
    return hits.select("query_id", "rank", "file_name", "page", "chunk_id", file_uri(F.col("file_path"), F.col("page")).alias("uri"), F.substring("content", 1, 120).alias("excerpt"))


def chat(hits: DataFrame, url: str, model: str, system: str, budget: int = 2800, timeout: float = 600.0, options: dict | None = None) -> DataFrame:
    """(query_id, answer, contents, names): answers of a chat service to the questions (column text) of hits, one request for each question.

    The service takes {model, messages, options} and gives {message: {content}}; deterministic options are the default. A question whose request
    fails gets an empty answer, which counts as a refusal. Reasoning between think tags is cut out."""
    import json
    import urllib.request
    from collections.abc import Iterator

    import pandas as pd

    settings = {"temperature": 0.0, "top_k": 1, "seed": 42} | (options or {})
    per = hits.groupBy("query_id").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("rank", "content", "file_name"))).alias("h"))  # at most the final top n
    asked = per.join(contexts(hits, budget).select("query_id", "context"), "query_id")
    rows = asked.select("query_id", "text", "context", F.transform("h", lambda x: x["content"]).alias("contents"), F.transform("h", lambda x: x["file_name"]).alias("names"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({}))
        for frame in frames:
            said = []
            for text, context in zip(frame["text"], frame["context"], strict=True):
                body = {"model": model, "stream": False, "options": settings, "messages": [{"role": "system", "content": system}, {"role": "user", "content": f"{context}\n\n{text}"}]}
                try:
                    with opener.open(urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
                        said.append(json.load(r)["message"]["content"])
                except (OSError, KeyError, ValueError):
                    said.append("")
            yield frame[["query_id", "contents", "names"]].assign(answer=said)

    made = rows.mapInPandas(run, "query_id string, contents array<string>, names array<string>, answer string")
    return made.withColumn("answer", F.trim(F.regexp_replace("answer", "(?s)<think>.*?</think>", "")))
