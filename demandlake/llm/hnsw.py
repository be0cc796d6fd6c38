"""Approximate nearest neighbours: one navigable small-world graph a shard.

Rows are dealt by a hash of the vector into shards of about ``SHARD_ROWS``
distinct vectors.  Each shard builds a hierarchical navigable small-world
graph (layers drawn geometrically from a hash of the id, greedy descent,
best-first search of ``EF_BUILD`` candidates, neighbours chosen for
diversity) and stores it as flat arrays: one fixed-width neighbour matrix for
the ground layer, node lists and matrices for the layers above.  The index is
a table with a row per shard.  Queries go to every shard in blocks; the
shards' nearest are merged by cosine in double precision of the original
vectors.

Bounds: a task holds one shard and one block of queries; shards grow in
number, not in size.  Equal vectors are one node with their smallest ids.

Defined results: vectors that are null, empty, all zero or hold a null or
non-finite component take no part, as rows or as queries, nor do rows without
an id; vectors are compared with those of their own length, every length is
searched; equal rows (same id and vector) are one row; an id with several
vectors is a query with each of them, ranked apart, and finds the others;
ties go to the smaller id; a query never finds its own row; fewer candidates
than k give fewer rows; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm import shards
from demandlake.llm.common import stage

SHARD_ROWS = 4096
M, EF_BUILD, EF_SEARCH = 16, 80, 96
SLACK = 16           # links a node may hold above its limit before it is pruned
QUERY_BLOCK = 4096   # queries a task holds at a time (expected number)


class Graph:
    """A small-world graph over unit vectors ``x`` (float32)."""

    def __init__(self, x: np.ndarray, levels: np.ndarray):
        self.x, self.levels = x, levels
        self.top = int(levels.max()) if len(levels) else 0
        self.links = [np.full((len(x), self._limit(layer) + SLACK), -1, np.int32) for layer in range(1)]
        self.count = [np.zeros(len(x), np.int32)]
        self.at = [np.arange(len(x))]
        for layer in range(1, self.top + 1):
            members = np.flatnonzero(levels >= layer)
            place = np.full(len(x), -1, np.int64)
            place[members] = np.arange(len(members))
            self.at.append(place)
            self.links.append(np.full((len(members), self._limit(layer) + SLACK), -1, np.int32))
            self.count.append(np.zeros(len(members), np.int32))
        self.entry = -1
        self.seen = np.zeros(len(x), np.int32)
        self.stamp = 0

    @staticmethod
    def _limit(layer: int) -> int:
        return 2 * M if layer == 0 else M

    def neighbours(self, layer: int, node: int) -> np.ndarray:
        p = self.at[layer][node]
        return self.links[layer][p, :self.count[layer][p]]

    def search_layer(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest found, as (distance, node), nearest first."""
        x, seen = self.x, self.seen
        self.stamp += 1
        stamp = self.stamp
        for _, n in starts:
            seen[n] = stamp
        open_ = list(starts)
        heapq.heapify(open_)
        best = [(-d, n) for d, n in starts]
        heapq.heapify(best)
        at, links, count = self.at[layer], self.links[layer], self.count[layer]
        while open_:
            d, node = heapq.heappop(open_)
            if len(best) >= ef and d > -best[0][0]:
                break
            p = at[node]
            near = links[p, :count[p]]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            dist = -(x[near] @ q)
            if len(best) >= ef:
                ok = dist < -best[0][0]
                near, dist = near[ok], dist[ok]
            for dd, nn in zip(dist.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (-dd, nn))
                    heapq.heappush(open_, (dd, nn))
                elif dd < -best[0][0]:
                    heapq.heapreplace(best, (-dd, nn))
                    heapq.heappush(open_, (dd, nn))
        return sorted((-d, n) for d, n in best)

    def diverse(self, node_sim: np.ndarray, nodes: np.ndarray, limit: int) -> np.ndarray:
        """Up to ``limit`` of ``nodes`` (sorted, nearest first) such that none
        is nearer to a chosen one than to the centre; then the nearest left."""
        if len(nodes) <= limit:
            return nodes
        between = self.x[nodes] @ self.x[nodes].T
        blocked = np.zeros(len(nodes), bool)
        chosen = []
        for i in range(len(nodes)):
            if not blocked[i]:
                chosen.append(i)
                if len(chosen) == limit:
                    break
                blocked |= between[i] > node_sim
        if len(chosen) < limit:
            rest = np.setdiff1d(np.arange(len(nodes)), chosen)[:limit - len(chosen)]
            chosen.extend(rest.tolist())
        return nodes[np.array(chosen)]

    def _link(self, layer: int, node: int, near: np.ndarray) -> None:
        at, links, count, limit = self.at[layer], self.links[layer], self.count[layer], self._limit(layer)
        p = at[node]
        links[p, :len(near)] = near
        count[p] = len(near)
        for other in near.tolist():
            p = at[other]
            if count[p] == links.shape[1]:
                own = np.append(links[p], np.int32(node))
                sim = self.x[own] @ self.x[other]
                order = np.argsort(-sim, kind="stable")
                kept = self.diverse(sim[order], own[order], limit)
                links[p, :] = -1
                links[p, :len(kept)] = kept
                count[p] = len(kept)
            else:
                links[p, count[p]] = node
                count[p] += 1

    def insert(self, node: int) -> None:
        q, level = self.x[node], int(self.levels[node])
        if self.entry < 0:
            self.entry = node
            return
        highest = int(self.levels[self.entry])
        near = [(-float(self.x[self.entry] @ q), self.entry)]
        for layer in range(highest, level, -1):
            near = self.search_layer(q, near[:1], 1, layer)
        for layer in range(min(level, highest), -1, -1):
            near = self.search_layer(q, near, EF_BUILD, layer)
            nodes = np.array([n for _, n in near], np.int32)
            self._link(layer, node, self.diverse(np.array([-d for d, _ in near], np.float32), nodes, M))
        if level > highest:
            self.entry = node

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        near = [(-float(self.x[self.entry] @ q), self.entry)]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            near = self.search_layer(q, near[:1], 1, layer)
        return np.array([n for _, n in self.search_layer(q, near, ef, 0)], np.int64)


def _levels(ids: np.ndarray) -> np.ndarray:
    from demandlake.llm.words import mix
    u = ((mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0 ** -53
    return np.minimum((-np.log(u) / math.log(M)).astype(np.int64), 12)


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    v = v / np.where(big > 0, big, 1.0)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


INDEX = ("shard int, dim int, vectors binary, ids binary, id_ends binary, levels binary, entry int, "
         "links binary, counts binary, layer_sizes binary")


def build_shard(pdf: pd.DataFrame, key: str, vector: str) -> pd.DataFrame:
    ids, v = pdf[key].to_numpy(np.int64), shards.matrix(pdf[vector])
    rows, copies = shards.grouped_copies(ids, v)
    v, first = v[rows], ids[rows]
    graph = Graph(_unit(v), _levels(first))
    for node in range(len(v)):
        graph.insert(node)
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "dim": v.shape[1], "vectors": v.tobytes(),
        "ids": np.concatenate(copies).tobytes(), "id_ends": np.cumsum([len(c) for c in copies]).astype(np.int64).tobytes(),
        "levels": graph.levels.astype(np.int64).tobytes(), "entry": graph.entry,
        "links": b"".join(a.tobytes() for a in graph.links), "counts": b"".join(a.tobytes() for a in graph.count),
        "layer_sizes": np.array([len(a) for a in graph.links], np.int64).tobytes()}])


def load_shard(row) -> tuple[Graph, np.ndarray, list[np.ndarray]]:
    v = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    graph = Graph(_unit(v), np.frombuffer(row["levels"], np.int64))
    links, counts = np.frombuffer(row["links"], np.int32), np.frombuffer(row["counts"], np.int32)
    a = b = 0
    for layer, n in enumerate(np.frombuffer(row["layer_sizes"], np.int64)):
        width = graph.links[layer].shape[1]
        graph.links[layer] = links[a:a + n * width].reshape(n, width)
        graph.count[layer] = counts[b:b + n]
        a, b = a + n * width, b + n
    graph.entry = int(row["entry"])
    ends = np.frombuffer(row["id_ends"], np.int64)
    return graph, v, np.split(np.frombuffer(row["ids"], np.int64), ends[:-1])


def build(rows: DataFrame, key: str, vector: str, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(index table, shards of every length) of the usable ``rows``."""
    few = stage(shards.first_copies(rows.select(key, vector), key, vector, k + 1), "vectors")
    sizes = stage(shards.counted(few, vector, shard_rows, "shards"), "sizes")
    index = shards.dealt(few, sizes, vector).groupBy("dim", "shard").applyInPandas(lambda pdf: build_shard(pdf, key, vector), INDEX)
    return stage(index, "hnsw"), sizes


def search(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
           shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """For each row of ``rows`` where ``is_query``: its ``k`` nearest other
    rows as (query_id long, rank int, vec_id long, score double)."""
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(
        F.col("id").isNotNull() & shards.finite("v") & F.exists("v", lambda x: x != 0))
    usable = shards.distinct_rows(usable, "id", "v")
    index, sizes = build(usable, "id", "v", k, shard_rows)
    queries = usable.where("q").select("id", "v")
    blocks = stage(shards.counted(queries, "v", QUERY_BLOCK, "blocks"), "blocks")

    def find(index_rows: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index_rows) and len(pdf):
            graph, v, ids = load_shard(index_rows.iloc[0])
            norm = np.sqrt((v * v).sum(1))
            q = shards.matrix(pdf["v"])
            unit = _unit(q)
            for i, (query, own) in enumerate(zip(pdf["id"].to_numpy(np.int64), pdf["query"].tolist())):
                nodes = graph.search(unit[i], ef)
                scores = (v[nodes] @ q[i]) / (norm[nodes] * math.sqrt(float(q[i] @ q[i])))
                same = (v[nodes] == q[i]).all(1)
                out.extend((int(query), own, j, s) for s, j in shards.best_copies(int(query), same, scores, nodes, ids, k))
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"])

    found = (shards.for_blocks(index, blocks).groupBy("dim", "shard", "block")
             .cogroup(shards.in_blocks(queries, "id", "v", sizes, blocks).groupBy("dim", "shard", "block"))
             .applyInPandas(find, "query_id long, query long, vec_id long, score double"))
    return shards.best_per_query(found, k)
