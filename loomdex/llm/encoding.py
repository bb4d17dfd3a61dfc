"""Problem 8: encoding of a corpus with a public byte-level BPE, its offsets, and decoding.

The vocabulary's path is a parameter; every Python worker loads it once. Ids come from the tokenizers library over Arrow
batches, a few hundred texts at a time, so that the memory of a worker doesn't follow the size of the corpus. A token is a run of
bytes, not of characters: ``encode_with_offsets`` derives the bytes of each token from the vocabulary's table of one character
for each byte and maps them to characters of the text, so a character that is split over several tokens gets the same
place in each of them. ``decode`` reverses the table, joins the bytes and only then reads UTF-8; ids cut out of the middle
of a character decode to U+FFFD.

Defined cases: null and empty texts have an empty list of ids and decode to an empty text; white space is kept; strings of special
tokens inside a text are ordinary text; repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS_AT_ONCE = 256


@cache
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are Spark's
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_table() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others, in order, from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _token_bytes(path: str) -> dict[int, bytes]:
    table = byte_table()
    return {i: bytes(table[c] for c in token) for token, i in _tokenizer(path).get_vocab(with_added_tokens=False).items() if all(c in table for c in token)}


def encode(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>), one row for each row."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = [np.array(e.ids, dtype=np.int32) for e in t.encode_batch_fast([x or "" for x in part.column(1).to_pylist()], add_special_tokens=False)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))], names=[id_column, "ids"])

    return df.select(id_column, text).mapInArrow(run, f"{id_column} {kind}, ids array<int>")


def encode_with_offsets(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, starts, ends): characters [start, end) that each token has bytes of; starts and ends never fall."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, sizes = _tokenizer(vocabulary), {i: len(b) for i, b in _token_bytes(vocabulary).items()}
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for x, e in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                    raw = np.frombuffer(x.encode("utf-8", "replace"), dtype=np.uint8)
                    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
                    upto = np.cumsum([sizes[i] for i in e.ids]).astype(np.int64)
                    first = np.concatenate([[0], upto[:-1]]).astype(np.int64) if len(upto) else upto
                    rows.append((e.ids, char_of[first].astype(np.int32), (char_of[upto - 1] + 1).astype(np.int32)))
                lists = [pa.array([list(r[k]) for r in rows], pa.list_(pa.int32())) for k in range(3)]
                yield pa.record_batch([part.column(0), *lists], names=[id_column, "ids", "starts", "ends"])

    return df.select(id_column, text).mapInArrow(run, f"{id_column} {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text): the text of each list of ids; null and empty lists give an empty text, unknown ids give U+FFFD."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _token_bytes(vocabulary).get
        for batch in batches:
            texts = [b"".join(get(i, b"\xff") for i in x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    return df.select(id_column, F.col(ids)).mapInArrow(run, f"{id_column} {kind}, text string")
