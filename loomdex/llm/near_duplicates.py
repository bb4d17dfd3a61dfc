"""Problem 6: records that are the same but for small edits.

Every record is read once into the set of its word shingles; records with equal sets are one class from then on, so that a
third of all rows being copies costs nothing. A class has a MinHash signature of 84 values of 13 bits, in 28 bands of three; classes that agree in a band are
candidates, which 8 pairs in a million at a similarity of exactly 0.7 aren't. A band value that more than ``crowd`` classes have is crowded. A pair whose common bands
are all crowded has two of them but for 1.2 in 10,000 at 0.7, so crowded values are replaced by the pairs of crowded values of each class (at most 378), and
what is still large is cut into blocks whose pairs are groups of their own: no task holds more than two blocks.

A candidate pair is dropped if the sizes of its sets rule the threshold out. Else it is compared three values at a time: as soon as the posterior probability that its similarity reaches the
threshold (uniform prior, binomial likelihood, collisions of five bits included) falls below the tolerance it is dropped. What
is left is verified by the exact Jaccard similarity of the shingle sets. Only survivors are emitted.

Defined cases: null text is no record; a text with fewer words than a shingle has one shingle, all of its words (so texts without
any word are equal); repeated rows of one id count once; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm.words import mix, shingle_sets, shingles, word_hashes, words
from loomdex.operators.graph import connected_components
from loomdex.session import cut

HASHES, ROWS = 84, 3
BANDS = HASHES // ROWS
BLOCK = 128
#: So many ids of candidates are sent to all tasks, as 64-bit hashes; more are joined by shuffle.
FEW = 500_000


def _signatures(every: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, BANDS) of three values of five bits, and (n, HASHES) of eight bits more of each."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, HASHES, dtype=np.uint64)
    low, high = np.zeros((len(starts), BANDS), dtype="<u2"), np.empty((len(starts), HASHES), dtype=np.uint8)
    for i in range(HASHES):
        least = np.minimum.reduceat((every * a[i] + b[i]) >> np.uint64(32), starts) * np.uint64(0x9E3779B1) >> np.uint64(13)
        low[:, i // ROWS] |= ((least & np.uint64(31)) << np.uint64(5 * (i % ROWS))).astype("<u2")
        high[:, i] = (least >> np.uint64(5)).astype(np.uint8)
    return low, high


def _describe(size: int):
    schema = pa.schema([("id", pa.string()), ("fp", pa.binary()), ("n", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if not part.num_rows:
                    continue
                every, starts = shingle_sets(part.column(1).to_pylist(), size)
                prints = np.stack([np.add.reduceat(mix(every + np.uint64(k)), starts) for k in (0, 1)], axis=1)
                rows = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (prints, *_signatures(every, starts))]
                n = np.diff(np.append(starts, len(every))).astype(np.int32)
                yield pa.record_batch([part.column(0), rows[0], pa.array(n), rows[1], rows[2]], schema=schema)

    return run


def least_matches(threshold: float, tolerance: float, steps: range) -> dict[int, int]:
    """For n values compared, the fewest matches at which P(similarity >= threshold) is at least ``tolerance``."""
    s = (np.arange(4000) + 0.5) / 4000
    p = np.log(s + (1 - s) / 32), np.log1p(-(s + (1 - s) / 32))
    out = {}
    for n in steps:
        for m in range(n + 1):
            like = m * p[0] + (n - m) * p[1]
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                out[n] = m
                break
        else:
            out[n] = n
    return out


def _survivors(threshold: float, tolerance: float, at_once: int = 500_000):
    need = least_matches(threshold, tolerance, range(ROWS, HASHES + 1, ROWS))

    def kept(sig: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of positions those that pass, compared ROWS values at a time, all together."""
        fits = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[fits], b[fits]
        seen = np.zeros(len(a), dtype=np.int16)
        for k in range(ROWS, HASHES + 1, ROWS):
            x = sig[a, k // ROWS - 1] ^ sig[b, k // ROWS - 1]
            seen += ((x & 31) == 0).astype(np.int16) + ((x & 992) == 0) + ((x & 31744) == 0)
            keep = seen >= need[k]
            if not keep.all():
                a, b, seen = a[keep], b[keep], seen[keep]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            starts, sizes, members = ends[:-1] - ends[0], np.diff(ends), lists.flatten()
            mixed = batch.column(0).to_numpy(zero_copy_only=False)
            ids, block, n = (members.field(c).to_numpy(zero_copy_only=False) for c in ("rid", "block", "n"))
            sig = np.frombuffer(b"".join(members.field("low").to_pylist()), dtype="<u2").reshape(-1, BANDS)
            for m in np.unique(sizes[sizes > 1]).tolist():
                x, y = np.triu_indices(m, 1)
                groups = np.flatnonzero(sizes == m)
                step = max(1, at_once // len(x))
                for at in range(0, len(groups), step):
                    own = groups[at : at + step]
                    a, b = ((starts[own][:, None] + side[None]).ravel() for side in (x, y))
                    apart = ~np.repeat(mixed[own], len(x)) | (block[a] != block[b])  # pairs within a block have their own group
                    a, b = kept(sig, n, a[apart], b[apart])
                    if len(a):
                        yield pa.record_batch([pa.array(ids[a]), pa.array(ids[b])], names=["x", "y"])

    return run


class NearDuplicates:
    """Steps of the join. ``records`` has the columns id (string) and text; all else is ignored."""

    def __init__(self, records: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-7, block: int = BLOCK, crowd: int = 64):
        self.records = records.select(F.col("id").cast("string").alias("id"), "text").where("id is not null and text is not null")
        self.threshold, self.size, self.tolerance, self.block, self.crowd = threshold, size, tolerance, block, crowd
        self.described = cut(self.records.mapInArrow(_describe(size), "id string, fp binary, n int, low binary, high binary"))
        #: class -> its least id, which stands for it
        one = self.described.groupBy("fp").agg(F.min(F.struct("id", "n", "low", "high")).alias("r"))
        self.classes = cut(one.select(F.xxhash64("fp").alias("rid"), "r.*"))

    def members(self) -> DataFrame:
        """(id, class): the class is named by its least id."""
        ids = self.described.select(F.xxhash64("fp").alias("rid"), "id").distinct()
        return ids.join(self.classes.select("rid", F.col("id").alias("class")), "rid").select("id", "class")

    @staticmethod
    def _shared(keys: DataFrame) -> DataFrame:
        """(rid, key, rn, of): the rows of keys that more than one class has, numbered. One task sorts the rows of a key, and spills them where they are many."""
        w = Window.partitionBy("key").orderBy("rid")
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return keys.select("rid", "key", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(every).alias("of")).where(F.col("of") > 1)

    def candidates(self) -> DataFrame:
        """(a, b) of classes, a < b, that pass the pruning."""
        keys = F.array(*[F.xxhash64(F.lit(i), F.substring("low", 2 * i + 1, 2), F.substring("high", ROWS * i + 1, ROWS)) for i in range(BANDS)])
        shared = cut(self._shared(self.classes.select("rid", F.explode(keys).alias("key"))))
        few = shared.where(F.col("of") <= self.crowd).select("rid", "key", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("last"))
        crowded = shared.where(F.col("of") > self.crowd).groupBy("rid").agg(F.sort_array(F.collect_list("key")).alias("ks"))  # at most BANDS
        two = F.flatten(F.transform("ks", lambda k, i: F.transform(F.slice("ks", i + 2, F.lit(BANDS)), lambda m: F.xxhash64(k, m))))
        again = self._shared(crowded.select("rid", F.explode(two).alias("key")))
        many = again.select("rid", "key", F.floor((F.col("rn") - 1) / self.block).alias("block"), F.floor((F.col("of") - 1) / self.block).alias("last"))
        placed = few.unionByName(many).join(self.classes.select("rid", "n", "low"), "rid").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        groups = placed.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("rid", "block", "n", "low")).alias("members"))
        pairs = groups.select((F.col("i") != F.col("j")).alias("mixed"), "members").mapInArrow(_survivors(self.threshold, self.tolerance), "x long, y long")
        left = cut(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        names = self.classes.select("rid", "id")
        named = left.join(names.select(F.col("rid").alias("x"), F.col("id").alias("u")), "x").join(names.select(F.col("rid").alias("y"), F.col("id").alias("v")), "y")
        return named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a < b")

    def links(self) -> DataFrame:
        """(a, b, similarity) of classes, a < b, with an exact similarity of at least the threshold."""
        pairs = cut(self.candidates())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.xxhash64("id").alias("h")).distinct()
        wanted = F.broadcast(wanted) if pairs.count() <= FEW // 2 else wanted
        texts = self.records.withColumn("h", F.xxhash64("id")).join(wanted, "h", "left_semi").select("id", "text").dropDuplicates(["id"])
        size = self.size

        @F.pandas_udf("double")
        def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
            def one(s: str, t: str) -> float:
                p, q = (np.unique(shingles(word_hashes(words(v)), size)) for v in (s, t))
                both = len(np.intersect1d(p, q, assume_unique=True))
                return both / (len(p) + len(q) - both)

            return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

        joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return joined.select("a", "b", jaccard("ta", "tb").alias("similarity")).where(F.col("similarity") >= self.threshold)

    def pairs(self) -> DataFrame:
        """(a, b), a < b, of all records: links with their classes' members, and the members of one class with each other."""
        members = self.members()
        left, right = members.select(F.col("id").alias("x"), F.col("class").alias("a")), members.select(F.col("id").alias("y"), F.col("class").alias("b"))
        across = self.links().join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        within = left.join(right, left["a"] == right["b"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        return across.unionByName(within)

    def groups(self) -> DataFrame:
        """One row for each record: (id, class, group, n_links); group is the least id that is reachable by links, n_links counts the
        links of the record's class to other classes. Records without any partner are their own group."""
        links = cut(self.links().select("a", "b"))
        ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
        found = connected_components(links).withColumnRenamed("node", "class")
        out = self.members().join(found, "class", "left").join(ends, "class", "left")
        return out.select("id", "class", F.coalesce("component", "class").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
