"""Approximate nearest neighbours: a navigable small-world graph per shard, stored as flat neighbour arrays.

Vectors are dealt into shards by the hash of their id. Each shard is one row of an index table: ids, vectors, and for
every layer an array of neighbours. A query goes to every shard, and the best of all shards are merged. Queries come in
blocks, so a task holds one shard and one block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: Vectors of a shard, and queries of a block.
SHARD, QUERIES = 8192, 1024
#: Neighbours in the upper layers (twice as many in the lowest), and the width of the search when building and asking.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 96, 160
NEAREST = 20


class Graph:
    """A layered graph over the rows of ``vectors``; similar means a large inner product."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry
        self.seen, self.turn = np.zeros(len(vectors), np.int64), 0

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 7) -> Graph:
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        self = cls(vectors, [np.full((n, links * (1 if i else 2)), -1, np.int32) for i in range(level.max() + 1)], 0)
        size = [np.zeros(n, np.int32) for _ in self.layers]
        top = level[0]
        for node in range(1, n):
            at = [self.entry]
            for layer in range(top, level[node], -1):
                at = [self.nearest(vectors[node], at, 1, layer)[0][1]]
            for layer in range(min(top, level[node]), -1, -1):
                found = self.nearest(vectors[node], at, width, layer)
                at = [i for _, i in found]
                chosen = self._spread(np.array([s for s, _ in found]), np.array(at), links)
                table, count = self.layers[layer], size[layer]
                table[node, : len(chosen)] = chosen
                count[node] = len(chosen)
                for other in chosen.tolist():
                    if count[other] < table.shape[1]:
                        table[other, count[other]] = node
                        count[other] += 1
                        continue
                    all_of = np.append(table[other], node)
                    near = vectors[all_of] @ vectors[other]
                    order = np.argsort(-near)
                    kept = self._spread(near[order], all_of[order], table.shape[1])
                    table[other, : len(kept)] = kept
                    table[other, len(kept) :] = -1
                    count[other] = len(kept)
            if level[node] > top:
                self.entry, top = node, level[node]
        return self

    def _spread(self, near: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """The nearest nodes that are not nearer to one another, then others by nearness."""
        if len(nodes) <= most:
            return nodes
        between = self.vectors[nodes] @ self.vectors[nodes].T
        shadow = np.full(len(nodes), -np.inf)
        kept, rest = [], []
        for i in range(len(nodes)):
            if shadow[i] < near[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                np.maximum(shadow, between[i], out=shadow)
            else:
                rest.append(i)
        return nodes[(kept + rest)[:most]]

    def nearest(self, query: np.ndarray, start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """Up to ``width`` (similarity, node) of a layer, best first."""
        vectors, table, seen = self.vectors, self.layers[layer], self.seen
        self.turn += 1
        turn = self.turn
        seen[start] = turn
        near = (vectors[start] @ query).tolist()
        best = list(zip(near, start))
        heapq.heapify(best)
        wait = [(-s, i) for s, i in best]
        heapq.heapify(wait)
        while wait:
            distance, node = heapq.heappop(wait)
            if len(best) >= width and -distance < best[0][0]:
                break
            around = table[node]
            around = around[around >= 0]
            around = around[seen[around] != turn]
            if not len(around):
                continue
            seen[around] = turn
            near = vectors[around] @ query
            if len(best) >= width:
                better = near > best[0][0]
                around, near = around[better], near[better]
            for s, i in zip(near.tolist(), around.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(wait, (-s, i))
        return sorted(best, reverse=True)

    def ask(self, query: np.ndarray, width: int) -> list[int]:
        at = [self.entry]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = [self.nearest(query, at, 1, layer)[0][1]]
        return [i for _, i in self.nearest(query, at, width, 0)]


def sound(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


_INDEX = "dim INT, shard INT, n INT, ids BINARY, first BINARY, vectors BINARY, layers INT, neighbours ARRAY<BINARY>, entry INT"


def _flat(rows: pd.Series) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.asarray(v, np.float32) for v in rows]))


def build_index(vectors: DataFrame, key: str, vector: str, shard: int = SHARD) -> DataFrame:
    """One row per shard of about ``shard`` vectors, written.

    Equal vectors of a shard are one node with several ids. Vectors get one more component that makes them equally
    long, so that the largest inner product is the nearest node. Vectors of another length have shards of their own.
    """
    count = vectors.count()
    shards = max(1, -(-count // shard))

    def build(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raw = _flat(rows["vector"])
        ids = rows["key"].to_numpy(np.int64)
        order = np.argsort(ids)
        raw, ids = raw[order], ids[order]
        distinct, which = np.unique(raw, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        first = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1)).astype(np.int32)
        square = (distinct.astype(np.float64) ** 2).sum(1)
        last = np.sqrt(np.maximum(square.max() - square, 0)).astype(np.float32)
        mix = np.random.default_rng(3).permutation(len(distinct))
        graph = Graph.build(np.ascontiguousarray(np.column_stack([distinct, last])[mix]))
        # Nodes stand in the order in which they went into the graph.
        ids = np.concatenate([ids[order][first[i] : first[i + 1]] for i in mix])
        sizes = np.diff(first)[mix]
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pd.DataFrame([{
            "dim": key_[0], "shard": key_[1], "n": len(distinct), "ids": ids.tobytes(), "first": first.tobytes(),
            "vectors": graph.vectors.tobytes(), "layers": len(graph.layers), "neighbours": [x.tobytes() for x in graph.layers], "entry": graph.entry,
        }])

    dealt = vectors.select(
        F.col(key).alias("key"), F.col(vector).alias("vector"), F.size(vector).alias("dim"),
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"),
    )
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(build, _INDEX), "index")


def search(index: DataFrame, queries: DataFrame, key: str, vector: str, k: int = NEAREST, width: int = SEARCH_WIDTH, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, itself left out; ties to the smaller id."""
    blocks = max(1, -(-queries.count() // block))
    shards = index.select(F.col("dim").alias("dim_of"), F.col("shard").alias("shard_of"))
    spread = queries.select(
        F.col(key).alias("key"), F.col(vector).alias("vector"), F.size(vector).alias("dim"),
        F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
    ).join(shards, F.col("dim") == F.col("dim_of")).select("key", "vector", "dim", F.col("shard_of").alias("shard"), "block")
    copies = index.toDF(*index.columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(shard) or not len(asked):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
        row = shard.iloc[0]
        n, dim = int(row["n"]), int(row["dim"])
        vectors = np.frombuffer(row["vectors"], np.float32).reshape(n, dim + 1)
        ids, first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int32)
        layers = [np.frombuffer(x, np.int32).reshape(n, -1) for x in row["neighbours"]]
        graph = Graph(vectors, layers, int(row["entry"]))
        exact = vectors[:, :dim].astype(np.float64)
        out = []
        for own, query in zip(asked["key"].to_numpy(np.int64), _flat(asked["vector"])):
            nodes = np.array(graph.ask(np.append(query, np.float32(0)), max(width, k + 1)))
            near = (exact[nodes] * query.astype(np.float64)).sum(axis=1)
            best = np.argsort(-near, kind="stable")
            # Nodes as near as the last one that can be needed stay: among them the smaller ids win.
            reach = near[best[min(k, len(best) - 1)]]
            score, found = [], []
            for j in best:
                if near[j] < reach:
                    break
                mine = ids[first[nodes[j]] : first[nodes[j] + 1]]
                mine = mine[mine != own][:k]
                score.append(np.full(len(mine), near[j]))
                found.append(mine)
            score, found = np.concatenate(score), np.concatenate(found)
            order = np.lexsort((found, -score))[:k]
            out.append((np.full(len(order), own), found[order], score[order]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(columns)})

    keys = ["dim", "shard", "block"]
    copies = copies.select(*[F.col(c).alias(c) for c in copies.columns])
    found = spread.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(
        lambda asked, shard: ask(shard, asked), "query_id BIGINT, vec_id BIGINT, score DOUBLE"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEAREST, shard: int = SHARD
) -> DataFrame:
    """The ``k`` nearest of every row whose key is divisible by ``every``, among all rows.

    Rows with a null key, and vectors that are null, zero or hold null or non-finite components, take no part. Repeated
    keys count once, with the smallest of their vectors. An empty table gives an empty result.
    """
    part = vectors.where(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<float>").alias(vector)).where(sound(F.col(vector)))
    part = materialize(part.groupBy(key).agg(F.min(vector).alias(vector)), "vectors")
    return search(build_index(part, key, vector, shard), part.where(F.col(key) % every == 0), key, vector, k)
