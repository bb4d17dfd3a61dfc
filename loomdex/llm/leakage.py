"""Problem 9: passages of evaluation items inside a corpus.

The least passage that counts as a leak is a run of ``size`` words. Every such window of an item and of a document gets a 64-bit SimHash of its words;
the items' fingerprints stand in four tables by 16-bit blocks, a document's windows are looked up there, and the words themselves decide.

Items that were edited are found by windows of their own size. The SimHash of a whole item is compared with those of a document's windows of about as many
words (lengths go in steps of a tenth, windows in steps of an eighth of their length). Two fingerprints that differ in at most eleven bits differ in at most two within one of the four
blocks, so every fingerprint is entered under all values within two bits of each of its blocks: a lookup finds all within the radius. Candidates are verified by
the Jaccard similarity of their five-word shingles, weighted by rarity among the items, at the best place nearby.

The items are a stated query set. They are dealt into groups of at most ``words_at_once`` words by a hash of their id (a longer item is a group alone), and the corpus is read
once for each group with that group's index sent to the tasks, at most some 60 MB; only items, never documents, reach the driver.

Defined cases: null and empty texts leak nothing; an item with fewer words than a window can't leak; a passage that occurs twice in a
document, or in both fields of an item, gives one row; null ids of items are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import words as text_words
from loomdex.llm.words import mix, shingles, word_hashes, words

BLOCKS, BLOCK_BITS = 4, 16
#: Bits within which equal windows and whole items are looked for, and the bits of one block that these radii leave at most.
RADIUS, WIDE_RADIUS = BLOCKS - 1, 11
NEAR_BITS = WIDE_RADIUS // BLOCKS
STEP = 1.1


def simhashes(h: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every window of ``size`` successive word hashes; ties give a 0."""
    if len(h) < size:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
    sums = np.concatenate([np.zeros((1, 64), np.int16), np.cumsum(bits, axis=0, dtype=np.int32).astype(np.int32)])
    ones = sums[size:] - sums[:-size]
    return np.packbits(2 * ones > size, axis=1).reshape(-1, 8).view(np.uint64).ravel()


def _masks(bits: int) -> np.ndarray:
    """All values of a block with at most so many bits set."""
    every = np.arange(1 << BLOCK_BITS, dtype=np.uint32)
    return every[np.bitwise_count(every) <= bits].astype(np.uint64)


class Blocks:
    """Fingerprints in tables by block, under all values within ``bits`` of their own."""

    def __init__(self, prints: np.ndarray, bits: int, radius: int):
        self.prints, self.radius, self.tables = prints, radius, []
        masks = _masks(bits)
        for b in range(BLOCKS):
            value = (((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF))[:, None] ^ masks[None]).ravel()
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange(0x10001)).astype(np.int32)
            self.tables.append(((order // len(masks)).astype(np.int32), starts))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (position in prints, fingerprint) within the radius, perhaps more than once."""
        at, win = [], []
        for b, (order, starts) in enumerate(self.tables):
            value = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = starts[value + 1] - starts[value]
            where = np.repeat(np.arange(len(prints)), n)
            first = np.repeat(starts[value] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            which = order[first + np.arange(len(where))]
            close = np.bitwise_count(prints[where] ^ self.prints[which]) <= self.radius
            at.append(where[close])
            win.append(which[close])
        return np.concatenate(at), np.concatenate(win)


def _cell(n: int, size: int) -> int:
    return round(math.log(n / size) / math.log(STEP))


class Index:
    """Items (case, field, text): their windows, and their whole texts by length."""

    def __init__(self, items: list[tuple[str, str, str]], size: int, shingle: int = 5):
        self.size, self.shingle, self.owners, self.windows, self.sets, self.lengths = size, shingle, [], [], [], []
        df: Counter[int] = Counter()
        prints, whole, self.names = [], {}, []
        for case, field, text in items:
            found = words(text)
            if len(found) < size:
                continue
            h = word_hashes(found)
            own = set(shingles(h, shingle).tolist())
            df.update(own)
            prints.append(simhashes(h, size))
            self.owners += [(case, field)] * len(prints[-1])
            self.windows += [tuple(found[k : k + size]) for k in range(len(prints[-1]))]
            whole.setdefault(_cell(len(found), size), []).append((simhashes(h, len(found))[0], len(self.names)))
            self.names.append((case, field))
            self.sets.append(own)
            self.lengths.append(len(found))
        self.weight = {s: math.log(1 + len(items) / n) for s, n in df.items()}
        self.plain = Blocks(np.concatenate(prints), 0, RADIUS) if prints else None
        #: (words of a window, fingerprints, items)
        self.whole = [(round(size * STEP**c), Blocks(np.array([x for x, _ in v], dtype=np.uint64), NEAR_BITS, WIDE_RADIUS), [i for _, i in v]) for c, v in sorted(whole.items())]

    def similarity(self, h: np.ndarray, item: int) -> float:
        """Of the words' shingles with an item's, weighted; shingles that no item has weigh as the rarest."""
        p, q = set(shingles(h, self.shingle).tolist()), self.sets[item]
        most = math.log(1 + len(self.sets))
        w = lambda s: self.weight.get(s, most)
        return sum(map(w, p & q)) / (sum(map(w, p | q)) or 1.0)

    def best(self, h: np.ndarray, at: int, span: int, item: int) -> float:
        """The greatest similarity of the item with a window of its length that begins within ``span`` words of a place."""
        n = self.lengths[item]
        around = shingles(h[max(0, at - span) : at + n + span], self.shingle)
        if len(self.sets[item].intersection(around.tolist())) < 0.6 * len(self.sets[item]):
            return 0.0
        return max(self.similarity(h[x : x + n], item) for x in range(max(0, at - span), max(1, min(at + span, len(h) - n) + 1)))


def _sums(h: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of the words' bits; they may wrap around, as only differences over at most ``longest`` words are taken."""
    kind = np.uint16 if longest < 30_000 else np.uint32
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(h) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def _prints(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1).reshape(-1, 8).view(np.uint64).ravel()


def _scan(index: Index, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = max(n for n, _, _ in index.whole)
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, batch.num_rows, 64):  # whose sums stay in a core's cache
                part = batch.slice(at, 64)
                ids, found = part.column(0).to_pylist(), [words(t or "") for t in part.column(1).to_pylist()]
                lengths = np.array([len(f) for f in found])
                ends = np.cumsum(lengths)
                every = [w for f in found for w in f]
                h = word_hashes(every)
                sums = _sums(h, longest)
                doc = np.repeat(np.arange(len(found)), lengths)
                place = np.arange(len(h)) - np.repeat(ends - lengths, lengths)
                hits: dict[tuple, list] = {}
                starts = np.flatnonzero(np.arange(len(h)) + index.size <= ends[doc])
                where, win = index.plain.near(_prints(sums, starts, index.size))
                for x, y in {*zip(starts[where].tolist(), win.tolist(), strict=True)}:
                    if tuple(every[x : x + index.size]) == index.windows[y]:
                        mine = hits.setdefault((int(doc[x]), *index.owners[y]), [0, 1.0])
                        mine[0] += 1
                for n, blocks, items in index.whole:
                    step = max(1, n // 8)
                    begins = np.flatnonzero((np.arange(len(h)) + n <= ends[doc]) & (place % step == 0))
                    where, which = blocks.near(_prints(sums, begins, n))
                    for x, y in {*zip(begins[where].tolist(), which.tolist(), strict=True)}:
                        d, item = int(doc[x]), items[y]
                        known = hits.get((d, *index.names[item]))
                        if known and known[0]:
                            continue  # an equal passage says more
                        first = int(ends[d] - lengths[d])
                        sim = index.best(h[first : ends[d]], x - first, step, item)
                        if sim >= least:
                            mine = hits.setdefault((d, *index.names[item]), [0, 0.0])
                            mine[1] = max(mine[1], sim)
                out += [(ids[d], case, field, n, sim) for (d, case, field), (n, sim) in hits.items()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.float64())], names=["doc_id", "case_id", "field", "n_windows", "similarity"])

    return run


def leaks(documents: DataFrame, items: DataFrame, size: int = 12, least: float = 0.8, words_at_once: int = 100_000) -> DataFrame:
    """(doc_id, case_id, field, n_windows, similarity): documents (doc_id, text) with windows like those of items (id, and any text
    columns). n_windows counts equal windows, similarity is then 1; it is 0 where an item is only similar as a whole, by ``similarity``."""
    spark = documents.sparkSession
    fields = [c for c, t in items.dtypes if t == "string" and c != "id"]
    flat = items.where("id is not null").select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields])).alias("x")).select("id", "x.*")
    flat = flat.where("text is not null").distinct()
    total = flat.select(F.sum(F.least(F.size(text_words(F.col("text"))), F.lit(words_at_once)))).first()[0] or 0
    groups = max(1, math.ceil(total / words_at_once))
    parts = []
    for g in range(groups):
        own = [tuple(r) for r in flat.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect()]
        index = Index(own, size)
        if index.plain:
            parts.append(documents.select("doc_id", "text").where(F.length("text") >= size).mapInArrow(_scan(index, least), "doc_id bigint, case_id string, field string, n_windows int, similarity double"))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, case_id string, field string, n_windows int, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
