"""Problem 2: the most similar vectors for every vector.

Vectors of one direction, bit for bit, are one node. Nodes are dealt into shards by the nearest of a set of centres; a shard holds a
directed graph that starts at random and is rebuilt by batches, once or more: a greedy beam search from the node nearest to the mean proposes neighbours, and pruning
keeps a candidate only if no kept one is nearer to it, by the factor ``alpha``, than the node itself. Each vector is then searched by beam search
in the shards of its ``visits`` nearest centres; for a top k, whose neighbours may be far, in at least twice as many and in twice the root of the
number of centres, as the neighbours are spread over more shards where there are more. A search by threshold goes on from every hit to its neighbours until no new hit turns up.
Similarities are cosines of the vectors themselves, so an answer may lack a pair but never holds a wrong one.

Shards with more than ``shard_rows`` nodes are cut by a hash, and every search of the shard visits all its cuts; searches come in blocks
of ``block_rows``. The centres are fitted on a bounded sample of ``sample_rows`` vectors; every vector is indexed.

Defined cases: null vectors, vectors with nulls, NaN or infinite numbers, of another length or all zero are unusable: they are neither indexed nor
searched; a vector's copies are neighbours of similarity 1; ties in a top k go to the lesser id; repeated rows of one id count once;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.session import cut

DIM = 64
#: The graph of a search by threshold, and the beam of a search that begins at its own node.
LIGHT, NEAR = {"degree": 24, "beam": 40, "batch": 512, "passes": (1.2,)}, 12


class Graph:
    """A robust-pruned directed graph over rows of length one."""

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 256, seed: int = 1, passes: tuple[float, ...] = (1.0, 1.2)):
        self.x, self.degree, self.beam, self.alpha = np.ascontiguousarray(x, dtype=np.float32), degree, beam, alpha
        n, rng = len(x), np.random.default_rng(seed)
        self.n = n
        # the node nearest to the mean, and a few others against regions that it doesn't lead to
        self.entries = np.array(list(dict.fromkeys([int((self.x @ self.x.mean(0)).argmax()), *rng.permutation(n)[:7].tolist()])))
        self.next = np.full((n + 1, degree), n, dtype=np.int32)  # n: no neighbour
        if n > 1:
            k = min(degree // 2, n - 1)
            drawn = rng.integers(0, n - 1, (n, k))
            drawn += drawn >= np.arange(n)[:, None]
            drawn.sort(axis=1)
            drawn[:, 1:][drawn[:, 1:] == drawn[:, :-1]] = n
            self.next[:n, :k] = drawn
        self.padded = np.concatenate([self.x, np.zeros((1, x.shape[1]), np.float32)])
        for a in passes:
            order = rng.permutation(n)
            for at in range(0, n, batch):
                self._insert(order[at : at + batch], a)

    def search(self, q: np.ndarray, beam: int, step: int = 4, threshold: float | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """The beam begins with the entry points and, for queries that are nodes themselves, with ``own`` (n for those that aren't). Ids and cosines (len(q), beam) of the beam, unordered, n and -2 where it isn't full. With a threshold, also all pairs (query, id, cosine) found from there."""
        b, n = len(q), self.n
        rows = np.arange(b)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        ids = np.full((b, beam), n, np.int32)
        sims = np.full((b, beam), -2.0, np.float32)
        e = min(len(self.entries), beam - 1)
        ids[:, :e], sims[:, :e] = self.entries[:e], q @ self.x[self.entries[:e]].T
        seen[:, self.entries[:e]] = True
        if own is not None:
            new = ~seen[rows, own]
            ids[new, e], sims[new, e] = own[new], np.einsum("ij,ij->i", q[new], self.x[own[new]])
            seen[rows, own] = True
        done = sims <= -2.0
        live = rows
        while len(live):
            open_ = np.where(done[live], -3.0, sims[live])
            k = min(step, beam)
            pick = np.argpartition(-open_, k - 1, axis=1)[:, :k]
            usable = np.take_along_axis(open_, pick, 1) > -2.0
            done[live[:, None], pick] = True
            found_row, found_id = [], []
            for e in range(k):
                sub = live[usable[:, e]]
                if not len(sub):
                    continue
                near = self.next[ids[sub, pick[usable[:, e], e]]]
                fresh = ~seen[sub[:, None], near]
                seen[sub[:, None], near] = True
                r, c = np.nonzero(fresh)
                found_row.append(sub[r])
                found_id.append(near[r, c])
            if found_row:
                fr, fi = np.concatenate(found_row), np.concatenate(found_id)
                order = np.argsort(fr, kind="stable")
                fr, fi = fr[order], fi[order]
                s = np.einsum("ij,ij->i", q[fr], self.x[fi])
                counts = np.bincount(fr, minlength=b)
                width = int(counts.max())
                if width:
                    place = np.arange(len(fr)) - np.repeat(np.cumsum(counts) - counts, counts)
                    has = np.flatnonzero(counts)
                    to = np.zeros(b, np.int64)
                    to[has] = np.arange(len(has))
                    more_ids = np.full((len(has), width), n, np.int32)
                    more_sims = np.full((len(has), width), -2.0, np.float32)
                    more_ids[to[fr], place], more_sims[to[fr], place] = fi, s
                    all_sims = np.concatenate([sims[has], more_sims], 1)
                    top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
                    sims[has] = np.take_along_axis(all_sims, top, 1)
                    ids[has] = np.take_along_axis(np.concatenate([ids[has], more_ids], 1), top, 1)
                    done[has] = np.take_along_axis(np.concatenate([done[has], more_sims <= -2.0], 1), top, 1)
            live = live[(~done[live] & (sims[live] > -2.0)).any(1)]
        hits = []
        if threshold is not None:
            r, c = np.nonzero(sims >= threshold)
            row, node, sim = r, ids[r, c], sims[r, c]
            while len(row):
                hits.append((row, node, sim))
                near = self.next[node]
                rr, cc = np.nonzero(~seen[row[:, None], near])
                pair = np.unique(row[rr].astype(np.int64) * (n + 1) + near[rr, cc])
                row, node = pair // (n + 1), pair % (n + 1)
                seen[row, node] = True
                sim = np.einsum("ij,ij->i", q[row], self.x[node])
                keep = sim >= threshold
                row, node, sim = row[keep], node[keep], sim[keep]
        return ids, sims, hits

    def _prune(self, p: np.ndarray, cand: np.ndarray, alpha: float) -> np.ndarray:
        """(len(p), degree): from the candidates of each node, n for none, those that pruning keeps."""
        cand = np.sort(np.where(cand == p[:, None], self.n, cand), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = self.n
        xc = self.padded[cand]
        sims = np.einsum("bkd,bd->bk", xc, self.x[p])
        far = np.maximum(2 - 2 * sims, 0)
        between = np.maximum(2 - 2 * (xc @ xc.transpose(0, 2, 1)), 0) * np.float32(alpha * alpha)
        alive = cand < self.n
        out = np.full((len(p), self.degree), self.n, np.int32)
        rows = np.arange(len(p))
        for k in range(self.degree):
            best = np.where(alive, far, np.inf).argmin(1)
            ok = alive[rows, best]
            if not ok.any():
                break
            out[ok, k] = cand[rows, best][ok]
            alive &= ~((between[rows, best] <= far) & ok[:, None])
            alive[rows, best] = False
        return out

    def _insert(self, p: np.ndarray, alpha: float) -> None:
        ids, _, _ = self.search(self.x[p], self.beam, own=p)
        chosen = self._prune(p, np.concatenate([ids, self.next[p]], 1), alpha)
        self.next[p] = chosen
        r, c = np.nonzero(chosen < self.n)
        target, origin = chosen[r, c], p[r].astype(np.int32)
        order = np.argsort(target, kind="stable")
        target, origin = target[order], origin[order]
        have = (self.next[target] == origin[:, None]).any(1)
        target, origin = target[~have], origin[~have]
        if not len(target):
            return
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        most = 2 * self.degree
        place = np.arange(len(target)) - np.repeat(first, counts)
        take = place < most
        grown = np.full((len(nodes), most), self.n, np.int32)
        grown[np.repeat(np.arange(len(nodes)), counts)[take], place[take]] = origin[take]
        both = np.concatenate([self.next[nodes], grown], 1)
        fits = (both < self.n).sum(1) <= self.degree
        if fits.any():
            self.next[nodes[fits]] = np.sort(both[fits], 1)[:, : self.degree]
        for at in range(0, int((~fits).sum()), 512):
            sub = np.flatnonzero(~fits)[at : at + 512]
            self.next[nodes[sub]] = self._prune(nodes[sub], both[sub], alpha)


def usable(df: DataFrame, dim: int = DIM, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of usable vectors, v scaled to length one, in double precision."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))  # against overflow of squares
    named = df.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), F.explode(F.array(F.transform(v, lambda x: x / top))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return named.select("id", F.explode(F.array(norm)).alias("n"), "v").select("id", F.transform("v", lambda x: (x / F.col("n")).cast("float")).alias("v")).dropDuplicates(["id"])


def _centres(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    m = x[rng.permutation(len(x))[:k]]
    for _ in range(8):
        near = (x @ m.T).argmax(1)
        sums = np.zeros_like(m)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        m = np.where(norms > 0, sums / np.maximum(norms, 1e-12), m)
    return m.astype(np.float32)


class SimilarVectors:
    """``vectors`` is what usable() gives."""

    def __init__(self, vectors: DataFrame, shard_rows: int = 4000, visits: int = 3, sample_rows: int = 20_000, most_centres: int = 4096, block_rows: int = 100_000):
        self.visits, self.shard_rows, self.block_rows = visits, shard_rows, block_rows
        named = vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
        self.named = cut(named)
        self.nodes = self.named.groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("r")).select("h1", "h2", F.col("r.id").alias("node"), F.col("r.v").alias("v"))
        n = self.nodes.count()
        k = int(min(most_centres, max(1, math.ceil(n / (shard_rows / 2)))))
        share = min(1.0, sample_rows / max(n, 1))
        drawn = self.nodes.where(F.shiftrightunsigned("h1", 2) < int(share * 2**62)).select("v").limit(2 * sample_rows).toPandas()["v"]
        self.centres = _centres(np.stack(drawn.to_numpy()).astype(np.float32), k) if len(drawn) else np.zeros((1, DIM), np.float32)

    def members(self) -> DataFrame:
        """(id, node): each vector and the least id of its copies."""
        return self.named.select("id", "h1", "h2").join(self.nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node")

    def _near_centres(self, rows: DataFrame, visits: int) -> DataFrame:
        centres, k = self.centres, min(visits, len(self.centres))

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            s = np.stack(v.to_numpy()).astype(np.float32) @ centres.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            return pd.Series(list(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1).astype(np.int32)))

        return rows.withColumn("near", nearest("v"))

    def _placed(self, queries: DataFrame, visits: int) -> DataFrame:
        """(centre, cut, block, is_base, node, v): what each search group holds."""
        based = self._near_centres(self.nodes.select("node", "v"), 1).select("node", "v", F.get("near", 0).alias("centre"))
        asked = self._near_centres(queries.select("node", "v"), visits).select("node", "v", F.explode("near").alias("centre"))
        # at most most_centres rows
        sizes = {r["centre"]: r["n"] for r in based.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
        loads = {r["centre"]: r["n"] for r in asked.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            sizes = {0: 1}
        cuts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, math.ceil(n / (2 * self.shard_rows)))])
        blocks = F.create_map(*[F.lit(x) for c in sizes for x in (c, max(1, math.ceil(loads.get(c, 0) / self.block_rows)))])
        h, every = F.xxhash64("node"), lambda m: F.explode(F.sequence(F.lit(0), F.element_at(m, F.col("centre")) - 1))
        base = based.withColumn("cut", F.pmod(h, F.element_at(cuts, F.col("centre"))).cast("int")).withColumn("block", every(blocks))
        known = asked.where(F.map_contains_key(cuts, F.col("centre")))
        ask = known.withColumn("block", F.pmod(h, F.element_at(blocks, F.col("centre"))).cast("int")).withColumn("cut", every(cuts))
        columns = ["centre", "cut", "block", "node", "v"]
        return base.select(*columns, F.lit(True).alias("is_base")).unionByName(ask.select(*columns, F.lit(False).alias("is_base")))

    def _searched(self, queries: DataFrame, visits: int, k: int | None, threshold: float | None) -> DataFrame:
        """(a, b, similarity): node a's hits b. What lies within a threshold is far nearer than all else, so a lighter graph leads to it."""
        shape = LIGHT if threshold is not None else {}

        def group(frame: pd.DataFrame) -> pd.DataFrame:
            base, ask = frame[frame["is_base"]].sort_values("node"), frame[~frame["is_base"]]
            empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
            if not len(base) or not len(ask):
                return empty
            x, q = (np.stack(f["v"].to_numpy()).astype(np.float32) for f in (base, ask))
            names, own = base["node"].to_numpy(), ask["node"].to_numpy()
            graph, parts = Graph(x, **shape), []
            place = np.minimum(np.searchsorted(names, own), len(names) - 1)
            place = np.where(names[place] == own, place, len(names))
            order = np.argsort(place == len(names), kind="stable")  # nodes of the graph first: their search begins where it ends
            own, q, place = own[order], q[order], place[order]
            for at in range(0, len(q), 512):
                part, mine = q[at : at + 512], place[at : at + 512]
                if threshold is not None:
                    _, _, hits = graph.search(part, NEAR if mine[-1] < len(names) else graph.beam, threshold=threshold - 1e-3, own=mine)
                    for r, node, _ in hits:
                        parts.append((r + at, node))
                else:
                    ids, sims, _ = graph.search(part, max(graph.beam, 4 * k), own=mine)
                    r, c = np.nonzero(sims > -2.0)
                    parts.append((r + at, ids[r, c]))
            if not parts:
                return empty
            r, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            keep = own[r] != names[node]
            r, node = r[keep], node[keep]
            sim = np.einsum("ij,ij->i", q[r].astype(np.float64), x[node].astype(np.float64))
            out = pd.DataFrame({"a": own[r], "b": names[node], "similarity": sim})
            if threshold is not None:
                return out[out["similarity"] >= threshold - 1e-6]
            return out.sort_values(["a", "similarity", "b"], ascending=[True, False, True]).groupby("a").head(k)

        return self._placed(queries, visits).groupBy("centre", "cut", "block").applyInPandas(group, "a long, b long, similarity double")

    def links(self, threshold: float) -> DataFrame:
        """(a, b, similarity), a < b, of nodes with a cosine of at least the threshold."""
        found = self._searched(self.nodes, self.visits, None, threshold)
        return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= threshold)

    def pairs(self, threshold: float) -> DataFrame:
        """(a, b), a < b, of all vectors: links with their nodes' copies, and copies with each other."""
        m = self.members()
        left, right = m.select(F.col("id").alias("x"), F.col("node").alias("a")), m.select(F.col("id").alias("y"), F.col("node").alias("b"))
        across = self.links(threshold).join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        within = left.join(right, left["a"] == right["b"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        return across.unionByName(within)

    def top(self, k: int, every: int = 50, visits: int | None = None) -> DataFrame:
        """(id, neighbour, rank, similarity): the k nearest of each vector whose id is divisible by ``every``, copies included."""
        asked = self.named.where(F.col("id") % every == 0).select(F.col("id").alias("query"), "h1", "h2").join(self.nodes, ["h1", "h2"])
        most = visits or max(8, math.ceil(2 * math.sqrt(len(self.centres))))
        hits = self._searched(asked.select("node", "v").distinct(), most, k, None)
        m = self.members()
        hits = hits.unionByName(asked.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("similarity")).distinct())
        w0 = Window.partitionBy("node").orderBy("id")
        few = m.withColumn("r", F.row_number().over(w0)).where(F.col("r") <= k + 1)  # no list can take more copies of one node
        wide = asked.select("query", F.col("node").alias("a")).join(hits, "a").join(few.select(F.col("id").alias("neighbour"), F.col("node").alias("b")), "b").where("query <> neighbour")
        w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
        return wide.select(F.col("query").alias("id"), "neighbour", F.row_number().over(w).alias("rank"), "similarity").where(F.col("rank") <= k)
