"""Contracts of fusion, selection, rewriting, caching, gates and answer checks."""

import pytest
from pyspark.sql import functions as F

from loomdex.config import Settings
from loomdex.functions.text import cache_key, first_words
from loomdex.operators import fusion, gates, generation, rewrite, search
from loomdex.plans.retrieve import ask, retrieve
from tests_shared import LOW, corpus

LIST = "query_id string, list_id int, rank int, chunk_id string, doc_id string, score double, path string"


def lists(spark, *ranked, docs=None):
    rows = [("q", i, r, c, (docs or {}).get(c, f"d{c}"), 1.0 / r, "dense") for i, cs in enumerate(ranked) for r, c in enumerate(cs, 1)]
    return spark.createDataFrame(rows, LIST)


def scores(df):
    return {r["chunk_id"]: r["rrf"] for r in df.collect()}


def test_fusion(spark):
    got = scores(fusion.rank_fusion(lists(spark, "abc", "bad")))
    assert got["a"] == got["b"] > got["c"] == got["d"]
    assert got["c"] == 1 / 63


def test_cap_zero_is_plain_and_cap_keeps_ranks(spark):
    one = dict.fromkeys("abc", "d1")
    assert scores(fusion.rank_fusion(lists(spark, "abc", docs=one), cap=0)) == {"a": 1 / 61, "b": 1 / 62, "c": 1 / 63}
    assert scores(fusion.rank_fusion(lists(spark, "abcx", docs=one | {"x": "d9"}), cap=2)) == {"a": 1 / 61, "b": 1 / 62, "x": 1 / 64}


def test_consensus_over_lists(spark):
    assert scores(fusion.rank_fusion(lists(spark, "az", "ay", "aw"), cap=2))["a"] == pytest.approx(3 / 61)


def test_voided_chunk_stays_in_pool(spark):
    docs = {"1": "g", "2": "g", "3": "g", "o": "d9"}
    got = scores(fusion.rank_fusion(lists(spark, "123o", docs=docs), cap=2))
    assert "3" not in got and got["1"] == 1 / 61 > got["o"]
    pool = fusion.fused_pool(lists(spark, "123o", docs=docs), cap=2).orderBy("pos").collect()
    assert [r["chunk_id"] for r in pool] == ["1", "2", "o", "3"] and pool[-1]["rrf"] == 0.0


POOL = "query_id string, pos int, chunk_id string, rrf double, doc_id string, page int, file_path string"


def test_diversity(spark):
    order = [("a", "d1", 1), ("d", "d2", 1), ("e", "d2", 2), ("f", "d3", 1), ("b", "d1", 1), ("c", "d1", 2)]
    pool = spark.createDataFrame([("q", i, c, 1.0 - i / 10, d, p, "/x.pdf") for i, (c, d, p) in enumerate(order, 1)], POOL)
    got = fusion.diverse(pool, 3).orderBy("rank").collect()
    assert got[0]["chunk_id"] == "a" and "b" not in {r["chunk_id"] for r in got} and len({r["doc_id"] for r in got}) >= 2
    small = fusion.diverse(pool.where("pos <= 2"), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in small] == ["a", "d"]


def test_diversity_against_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(f"q{q}", i, f"c{i}", 0.0, f"d{rng.randrange(4)}", rng.choice([None, 1, 2]), f"/f{rng.randrange(3)}") for q in range(8) for i in range(1, 12)]
    got = {}
    for r in fusion.diverse(spark.createDataFrame(rows, POOL), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["pos"])
    for q in range(8):
        own = [r for r in rows if r[0] == f"q{q}"]
        chosen = []

        def red(a, b):
            return (0.9 if a[5] == b[5] else 0.5) if a[4] == b[4] else 0.3 if a[6] == b[6] else 0.0

        while len(chosen) < 4:
            left = [r for r in own if r not in chosen]
            chosen.append(max(left, key=lambda r: (0.6 * (1 - (r[1] - 1) / 11) - 0.4 * max([red(r, c) for c in chosen], default=0.0), -r[1])))
        assert got[f"q{q}"] == [r[1] for r in chosen]


def variants(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(rewrite.variants(F.col("t")).alias("v")).first()["v"]


def test_rewrite(spark):
    v = variants(spark, "BBU 电池怎么更换")
    assert v[0] == "BBU 电池怎么更换" and any("battery" in x and x.count("BBU") == 1 for x in v[1:])
    v = variants(spark, "svc_factory_reset 怎么用")
    assert "factory_reset" in v and "factory reset" in v
    v = variants(spark, "如何查看存储池容量和如何创建快照策略以及复制、如何升级集群节点")
    assert any(x.startswith("如何创建快照策略") for x in v)
    assert variants(spark, "what is new") == ["what is new"]
    assert any("4.3.0.0" in x and "change" in x for x in variants(spark, "Array 4.3.0.0 变更内容")[1:])
    assert any(x.startswith("NAS server") for x in variants(spark, "NAS server 备份")[1:])


def test_cache(spark):
    key = lambda t: spark.createDataFrame([(t,)], "t string").select(cache_key(F.col("t")).alias("k")).first()["k"]
    assert key("BBU 怎么换？") == key(" bbu  怎么换 ") == "bbu 怎么换"
    cache = spark.createDataFrame([("q1", "d1", 1), ("q2", "d2", 2)], "query string, doc string, ts bigint")
    kept = rewrite.put(cache, spark.createDataFrame([("Q3?", "d3", 3), ("q4", "d4", 4)], "query string, doc string, ts bigint"), 3)
    assert {r["query"] for r in kept.collect()} == {"q2", "q3", "q4"}
    asked = spark.createDataFrame([("1", "Q2？"), ("2", "other")], "query_id string, text string")
    got = {r["query_id"]: (r["doc"], r["cached"]) for r in rewrite.pseudo_documents(asked, cache).collect()}
    assert got == {"1": ("d2", True), "2": (None, False)}

    def generate(q):
        return q.select("query_id", F.lit("<think>x</think>" + " ".join(map(str, range(60))) + "\n\nmore").alias("doc"))

    got = {r["query_id"]: r["doc"] for r in rewrite.pseudo_documents(asked, cache, generate).collect()}
    assert got["1"] == "d2" and len(got["2"].split()) == 45
    short = rewrite.pseudo_documents(asked, cache, lambda q: q.select("query_id", F.lit("too short").alias("doc")))
    assert {r["query_id"]: r["doc"] for r in short.collect()} == {"1": "d2", "2": None}


def test_lru_and_words(spark):
    acc = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "key string, seq bigint")
    assert {r["key"] for r in rewrite.lru(acc, 2).collect()} == {"a", "c"}
    assert spark.createDataFrame([("a  b c",)], "t string").select(first_words(F.col("t"), 2).alias("x")).first()["x"] == "a b"


def test_bm25_against_loop(spark):
    import math

    docs = {"1": "disk disk fails", "2": "the disk", "3": "alert queue fails", "4": "nothing", "5": None, "6": "a b c d"}
    texts = spark.createDataFrame(list(docs.items()), "id string, text string")
    got = {r["id"]: r["score"] for r in search.bm25_top_k(spark.createDataFrame([("q", "Disk fails disk")], "query_id string, text string"), texts).collect()}
    known = {k: v.split() for k, v in docs.items() if v}
    n, avg = len(known), sum(map(len, known.values())) / len(known)
    want = {}
    for k, ws in known.items():
        s = 0.0
        for t in ("disk", "fails"):
            df = sum(t in x for x in known.values())
            idf = math.log((n - df + 0.5) / (df + 0.5))
            idf = idf if idf > 0 else 1e-6
            s += idf * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        if s:
            want[k] = s
    assert got == pytest.approx(want)


def test_dense_leaves_unusable_out_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 1.0])], "id bigint, v array<float>")
    got = search.dense_top_k(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<float>"), v, 2, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
    assert search.dense_top_k(v.limit(0).select(F.lit("q").alias("query_id"), "v"), v, 2, 2).count() == 0


def test_evidence_gate(spark):
    q = spark.createDataFrame([("absent", "does zebrafish work"), ("zh", "量子纠缠"), ("known", "battery 更换"), ("plain", "the")], "query_id string, text string")
    tokens = gates.tokens_of(q)
    texts = corpus(spark).chunks.select(F.col("content").alias("text"))
    df = search.substring_frequencies(tokens.select(F.col("token").alias("term")), texts)
    got = {r["query_id"]: (r["passes"], r["reason"]) for r in gates.evidence_gate(q, gates.discriminative(tokens, df, 6)).collect()}
    assert got["absent"] == (False, "no_subject_evidence") and got["zh"] == (False, "no_subject_evidence")
    assert got["known"] == (True, "") and got["plain"] == (True, "")


def test_sparse_and_dense_gates(spark):
    hits = spark.createDataFrame([("a", 20.0, "the Battery module", ["battery"]), ("b", 20.0, "fans", ["battery"]), ("c", 3.5, "battery", ["battery"]), ("d", 28.0, "battery", [])], "id string, score double, content string, rare_tokens array<string>")
    assert {r["id"] for r in gates.sparse_gate(hits, 8.0).collect()} == {"a"}
    assert {r["id"] for r in gates.sparse_gate(hits, 8.0, False).collect()} == {"a", "b", "d"}
    assert {r["id"] for r in gates.dense_gate(hits, 8.0).collect()} == {"a", "d"}


def test_retrieve_and_ask(spark):
    q = spark.createDataFrame([("1", "battery module"), ("2", "zebrafish tank")], "query_id string, text string")
    hits, verdicts = retrieve(q, corpus(spark), LOW)
    top = hits.where("query_id = '1' and rank = 1").first()
    assert top["chunk_id"] == "c2" and top["matched_by"] == "both"
    assert {r["query_id"]: r["reason"] for r in verdicts.collect()} == {"1": "", "2": "no_subject_evidence"}
    said = {r["query_id"]: r for r in ask(q, corpus(spark), LOW).collect()}
    assert said["1"]["state"] == "answer" and said["1"]["citations"][0]["chunk_id"] == "c2"
    assert said["2"]["state"] == "refusal" and said["2"]["reason"] == "no_subject_evidence"
    assert retrieve(q.limit(0), corpus(spark), LOW)[0].count() == 0


def test_retrieve_by_vector(spark):
    c = corpus(spark)
    v = c.vectors.where("id = 'c4'").select(F.lit("q").alias("query_id"), "v")
    hits, _ = retrieve(v, c, Settings(dense_min=-1.0, mmr=False))
    got = hits.orderBy("rank").collect()
    assert got[0]["chunk_id"] == "c4" and len(got) == 4 and {r["matched_by"] for r in got} == {"dense"}
    only, _ = retrieve(v, c, Settings(dense_min=-1.0), where="page_start = 1")
    assert {r["page"] for r in only.collect()} == {1}


def test_fallback(spark):
    q = spark.createDataFrame([("1", "battery module")], "query_id string, text string")
    hits, _ = retrieve(q, corpus(spark), Settings(dense_min=0.2, sparse_min=0.1, ubiquitous_ratio=0.2, sparse_fallback_only=True))
    assert {r["matched_by"] for r in hits.collect()} == {"dense"}


def why(spark, answer, contents, names=("a.pdf",)):
    df = spark.createDataFrame([(answer, list(contents), list(names))], "a string, c array<string>, n array<string>")
    return df.select(generation.failure(F.col("a"), F.col("c"), F.col("n")).alias("r")).first()["r"]


def test_answer_checks(spark):
    ctx = ["run svc_pool_drain on release 4.3.0.0"]
    assert why(spark, "see [片段7]", ctx).startswith("citation") and why(spark, "see [1]", ctx) == ""
    assert why(spark, "据我所知 it works", ctx).startswith("inference")
    assert why(spark, "run svc_factory_reset now.", ctx) == "identifier:svc_factory_reset"
    assert why(spark, "since 4.1.0.0", ctx).startswith("version") and why(spark, "since 4.3.0.0 e.g. here", ctx) == ""
    assert why(spark, "run svc_pool_drain.", ctx) == "" and why(spark, "read manual-a.pdf", ctx, ["manual-a.pdf"]) == ""
    assert why(spark, "plain words", ctx) == ""


def test_responses(spark):
    rows = [("1", "", ["c"], ["f"]), ("2", "use svc_x_y", ["c"], ["f"]), ("3", "fine", ["c"], ["f"]), ("4", generation.REFUSAL, ["c"], ["f"])]
    got = {r["query_id"]: (r["state"], r["reason"]) for r in generation.responses(spark.createDataFrame(rows, "query_id string, answer string, contents array<string>, names array<string>")).collect()}
    assert got == {"1": ("refusal", "llm_refusal"), "2": ("excerpt", "identifier:svc_x_y"), "3": ("answer", ""), "4": ("refusal", "llm_refusal")}


def test_context_budget_and_uri(spark):
    rows = [("q", 1, "a.pdf", 3, "S", "x" * 400), ("q", 2, "b.pdf", None, "", "y" * 4000), ("q", 3, "c.pdf", None, None, "z")]
    r = generation.contexts(spark.createDataFrame(rows, "query_id string, rank int, file_name string, page int, section string, content string"), 300).first()
    assert r["n_blocks"] == 1 and "第3页" in r["context"] and "章节: S" in r["context"]
    u = spark.createDataFrame([("/a b/文#.pdf", 2), ("C:\\d\\e.md", None)], "p string, n int").select(generation.file_uri(F.col("p"), F.col("n")).alias("u"))
    assert [x["u"] for x in u.collect()] == ["file:///a%20b/%E6%96%87%23.pdf#page=2", "file:///C:/d/e.md"]
