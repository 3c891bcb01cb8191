"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import kept


class SmallWorld:
    """A graph over the rows of ``vectors``, built by insertion; layer 0 has all of them.

    Nodes are numbered by falling level, so each layer holds the first nodes of the one below and
    node 0 is the entry.  After ``flatten`` a layer is two flat arrays: offsets and neighbours.
    """

    def __init__(self, vectors: np.ndarray, *, links: int = 16, ef: int = 64, seed: int = 0) -> None:
        n = len(vectors)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        self.order = np.argsort(-levels, kind="stable")
        self.x = np.ascontiguousarray(vectors[self.order])
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.links, self.ef = links, ef
        sizes = [int((levels >= k).sum()) for k in range(levels.max(initial=0) + 1)]
        self.near = [np.zeros((m, 4 * links if k == 0 else 2 * links), np.int32) for k, m in enumerate(sizes)]
        self.count = [np.zeros(m, np.int32) for m in sizes]
        for i in range(1, n):
            self._insert(i)

    def _distances(self, q: np.ndarray, q_norm: float, nodes: np.ndarray) -> np.ndarray:
        return self.norms[nodes] - 2 * (self.x[nodes] @ q) + q_norm

    def _neighbours(self, layer: int, i: int) -> np.ndarray:
        if self.near[layer] is None:
            return self.flat[layer][1][self.flat[layer][0][i] : self.flat[layer][0][i + 1]]
        return self.near[layer][i, : self.count[layer][i]]

    def _beam(self, q: np.ndarray, entries: list[tuple[float, int]], layer: int, ef: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest nodes the walk finds, nearest first."""
        q_norm = float(q @ q)
        seen = np.zeros(len(self.x), bool)
        seen[[i for _, i in entries]] = True
        todo, best = list(entries), [(-d, i) for d, i in entries]
        heapq.heapify(todo), heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = self._neighbours(layer, i)
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            dist = self._distances(q, q_norm, new)
            if len(best) >= ef:
                close = dist < -best[0][0]
                new, dist = new[close], dist[close]
            for d, j in zip(dist.tolist(), new.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-d, j)), heapq.heappush(todo, (d, j))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, j)), heapq.heappush(todo, (d, j))
        return sorted((-d, i) for d, i in best)

    def _diverse(self, nodes: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Nodes, nearest first, that are nearer to the centre than to any chosen before; then the nearest left."""
        x = self.x[nodes]
        between = self.norms[nodes][:, None] - 2 * (x @ x.T) + self.norms[nodes][None, :]
        ok, chosen = np.ones(len(nodes), bool), []
        for k in range(len(nodes)):
            if ok[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                ok &= between[k] > dist
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [k for k in range(len(nodes)) if k not in taken][: most - len(chosen)]
        return nodes[chosen]

    def _insert(self, i: int) -> None:
        q, top = self.x[i], len(self.near) - 1
        best = [(float(self._distances(q, float(q @ q), np.array([0]))[0]), 0)]
        for layer in range(top, -1, -1):
            own = i < len(self.near[layer])
            best = self._beam(q, best if own else best[:1], layer, self.ef if own else 1)
            if not own:
                continue
            nodes = np.array([j for _, j in best], np.int32)
            picked = self._diverse(nodes, np.array([d for d, _ in best]), self.links)
            near, count = self.near[layer], self.count[layer]
            near[i, : len(picked)], count[i] = picked, len(picked)
            for j in picked.tolist():
                if count[j] == near.shape[1]:
                    dist = self._distances(self.x[j], self.norms[j], near[j])
                    near_first = np.argsort(dist, kind="stable")
                    left = self._diverse(near[j][near_first], dist[near_first], near.shape[1] // 2)
                    near[j, : len(left)], count[j] = left, len(left)
                near[j, count[j]] = i
                count[j] += 1

    def flatten(self) -> SmallWorld:
        """Replace the tables by flat neighbour arrays."""
        self.flat = []
        for near, count in zip(self.near, self.count, strict=True):
            offsets = np.concatenate([[0], np.cumsum(count)])
            self.flat.append((offsets, near[np.arange(near.shape[1])[None, :] < count[:, None]]))
        self.near, self.count = [None] * len(self.flat), []
        return self

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Rows of ``vectors`` near ``q``, at most ``ef``."""
        best = [(float(self._distances(q, float(q @ q), np.array([0]))[0]), 0)]
        for layer in range(len(self.flat) - 1, -1, -1):
            best = self._beam(q, best[:1], layer, 1 if layer else ef)
        return self.order[[i for _, i in best]]


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part: ``v`` is the vector as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, shard_rows: int = 4096, block_rows: int = 4096, block_bytes: int = 64 << 20,
    links: int = 16, ef_build: int = 64, ef_search: int = 128,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, nearest first.

    Both tables have ``vec_id, embedding``.  Every row is indexed: distinct vectors are dealt by
    hash to shards of about ``shard_rows``, each on a partition of its own, whose task builds the
    graph; graphs are kept in the shared folder, one row a shard.  Queries are broadcast in blocks of
    about ``block_rows``, fewer where ``block_bytes`` asks for it; each block is searched where the
    graphs are read, so neither graphs nor queries are shuffled.  A block's results are kept before
    the next one starts, then the results of the shards are merged.  Copies of a vector are one node with its
    ``k + 1`` smallest vec_ids, which is all that ties to smaller ids can let through.  ``score`` is
    the Euclidean distance of the original vectors in double precision.

    Vectors null, zero, or with null or non-finite components take no part, nor do null vec_ids.
    Rows of the query's own vec_id are no candidates; repeated rows count once.  Vectors meet only
    those of their length.  Fewer candidates than ``k`` are all returned; empty tables give none.
    """
    spark = vectors.sparkSession
    once = usable(vectors).distinct().withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    nodes = kept(once.select("v", "vec_id", "nth"), "vectors")
    asked = kept(usable(queries).distinct(), "queries")
    shards = max(1, -(-nodes.where("nth = 1").count() // shard_rows))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        shard = pd.concat(parts)
        for size, pdf in shard.groupby(shard["v"].map(len)):
            tags = pdf["v"].map(lambda v: v.tobytes())
            pdf = pdf.assign(tag=tags).sort_values(["tag", "vec_id"])
            own = pdf.groupby("tag")["vec_id"].agg(list)
            x = np.stack(pdf[pdf["nth"] == 1]["v"].to_numpy())
            graph = SmallWorld(x, links=links, ef=ef_build, seed=int(pdf["shard"].iloc[0])).flatten()
            yield pd.DataFrame({"size": [size], "shard": [pdf["shard"].iloc[0]], "graph": [pickle.dumps((graph, x, own.tolist()), protocol=5)]})

    keyed = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "vec_id", "nth")
    graphs = kept(keyed.repartitionById(shards, F.col("shard")).mapInPandas(build, "size int, shard int, graph binary"), "graphs")

    def search(block: Broadcast):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for size, raw in zip(pdf["size"], pdf["graph"], strict=True):
                    ids, x = block.value.get(size, ((), ()))
                    graph, own_x, own = pickle.loads(raw)
                    out: list[tuple] = []
                    for query, v in zip(ids, x, strict=True):
                        at = graph.search(v, max(ef_search, 2 * k))
                        dist = np.sqrt(((own_x[at] - v) ** 2).sum(axis=1))
                        found = sorted((d, i) for d, j in zip(dist.tolist(), at.tolist(), strict=True) for i in own[j] if i != query)
                        out += [(query, i, d) for d, i in found[:k]]
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": float})

        return of

    schema = "query_id long, vec_id long, score double"
    results: list[DataFrame] = []
    sizes = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("size")).first()
    blocks = max(1, -(-sizes["n"] // max(1, min(block_rows, block_bytes // (8 * sizes["size"])))))
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for i, v in zip(rows["vec_id"].to_pylist(), rows["v"], strict=True):
            own = by_size.setdefault(len(v), ([], []))
            own[0].append(i), own[1].append(np.array(v.values))
        shared = spark.sparkContext.broadcast(by_size)
        results.append(kept(graphs.mapInPandas(search(shared), schema), "found"))
        shared.unpersist()
    once = reduce(DataFrame.unionByName, results).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
