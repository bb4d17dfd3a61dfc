"""Every query of the subpackage over tables of nulls, repeats, odd texts and foreign columns, and over empty ones."""

import pytest
from pyspark.sql import functions as F

from loomdex.llm.queries import QUERIES

CHUNKS = "chunk_id string, content string, file_path string, file_name string, page_start int, page_end int, chunk_index int, doc_id string, doc_title string, section_path string, chunk_type string, parent_chunk_id string, is_parent boolean, language string, created_at string, has_code boolean, has_warning boolean, file_hash string, token_estimate int"
TABLES = {
    "chunks": CHUNKS,
    "segments": "doc string, seg_no int, page int, page_end int, heading string, text string, kind string, level int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, version string, published_at timestamp",
    "chunk_vectors": "vec_id bigint, chunk_id string, embedding array<float>, provider string",
    "eval_cases": "id string, question string, category string, difficulty string, ground_truth_file array<string>, reference_answer string",
}
#: Columns that operators use inside.
FOREIGN = ["text", "id", "label", "line", "key", "v", "tab", "title", "kind", "__runs", "__big", "__piece", "piece_no", "n_pieces", "start", "node", "a", "b", "fp", "sig", "lang", "source", "file", "ids", "h"]

SENTENCE = "The storage pool balances orphaned snapshots before the nightly window closes. "
ZH = "为什么缓存分区预先占用配对卷？值班员发现，复制完 5009 MiB 以后，文件共享目录隔离冷数据块。"
LONG = SENTENCE * 400 + "x" * 6000 + ZH * 150
TEXTS = [None, "", " \n\t", "a", "###", SENTENCE * 3, SENTENCE * 3, ZH, LONG, "Don’t remove the cafÃ© cover", "\ufffd\u0000\ud7ff", "line\n\n\nline\n-\n", SENTENCE.replace("pool", "p00l") + "before-\nhand\nPage 3 of 9\nmore"]


def rows(table):
    if table == "chunks":
        out = []
        for i, t in enumerate(TEXTS):
            for path in ("/x/corpus/s/a.pdf", "C:\\corpus\\s\\b.PDF", None, "/none"):
                out.append((f"c{i}{len(path or '')}", t, path, None, None, None, None, None, None, None, ["text", None, "code"][i % 3], ["", None, "gone"][i % 3], i % 5 == 4, [None, "en", "", "EN", "zh"][i % 5], None, None, None, None, None))
        return out + out[:9] + [(None,) * 12 + (False,) + (None,) * 6]
    if table == "segments":
        return [(d, i, None, None, None, t, k, None) for i, t in enumerate(TEXTS) for d, k in (("/x/a.pdf", "text"), (None, None), ("b", "heading"))] * 2
    if table == "documents":
        return [(i, t, [None, "en", "und", "zh"][i % 4], None, None, None, None, None) for i, t in enumerate(TEXTS)] + [(None, SENTENCE, "en", None, None, None, None, None), (3, "a", None, None, None, None, None, None)]
    if table == "chunk_vectors":
        ones = [1.0] * 64
        vs = [None, [], ones, ones, [2.0] * 64, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0] * 63, [None] + [1.0] * 63, [1.0] + [0.0] * 63, [3e38] * 64, [1e-30] * 64]
        return [(i * 50, None, v, None) for i, v in enumerate(vs)] + [(100, "x", ones, None), (None, None, ones, None)]
    return [("e1", SENTENCE + SENTENCE, None, None, None, None), ("e2", None, None, None, [], ""), (None, SENTENCE, None, None, None, ZH), ("e3", ZH, None, None, None, ZH)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    for t, schema in TABLES.items():
        df = spark.createDataFrame(rows(t), schema)
        for c in FOREIGN:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(1))
        df.coalesce(1).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for t, schema in TABLES.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{root}/{t}.parquet")
    return str(root)


@pytest.mark.parametrize("name", QUERIES)
def test_odd_tables(spark, odd, name):
    df = QUERIES[name](spark, odd)
    got = df.collect()
    if name.endswith("_found"):
        assert len(got) == len({tuple(r) for r in got})
        assert all(x is not None for r in got for x in r)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
