"""A small corpus for tests of plans."""

from pyspark.sql import functions as F

from loomdex.config import Settings
from loomdex.plans.retrieve import Corpus

LOW = Settings(dense_min=0.2, sparse_min=0.1, ubiquitous_ratio=0.2)


def corpus(spark):
    rows = [
        (f"c{i}", t, f"d{i // 2}", f"/corpus/s/f{i // 2}.pdf", f"f{i // 2}.pdf", i % 2 + 1, "S")
        for i, t in enumerate(["svc_drain stops the node and the storage pool", "the storage pool 3.2.1 grows", "replace the battery module of the node", "the storage fans of the enclosure", "quota tree of the node", "cached blocks of the storage node"])
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, doc_id string, file_path string, file_name string, page_start int, section_path string")
    from loomdex.operators.embedding import embed

    return Corpus(chunks, chunks.select(F.col("chunk_id").alias("id"), embed(F.col("content"), dim=64).alias("v")))
