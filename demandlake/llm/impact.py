"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers.  Every nonzero component is a posting (dimension, row,
signed impact).  Postings are cut into segments by quantised impact
(``LEVELS`` levels of |impact|) and dimension, and stored with the highest
level first.  A block of queries reads the segments in descending level and
adds weight * impact into one accumulator per (query, row).  What a row may
still gain or lose is at most the largest impact of the levels to come times
the query weight of the dimensions in which the row has had no posting yet.
So each row has a lower and an upper bound at any time; once the rows whose
upper bound reaches the (k+1)-th best lower bound are few, no other row can
be among the best, reading stops, and these possible members are scored
exactly.  If that is never proven, all segments are read and the accumulators
are the scores.

Rows are dealt by a hash of the vector into shards of about ``SHARD_ROWS``
distinct vectors, queries into blocks; the shards' best are merged.  Equal
vectors are one row with their smallest ids.

Defined results: vectors that are null, empty or hold a null component take
no part, nor do rows without an id; all-zero vectors do (score 0); vectors are
compared with those of their own length, every length is searched; equal rows
(same id and vector) are one row; an id with several vectors is a query with
each of them, ranked apart, and finds the others; ties go to the smaller id; a
query never finds its own row; fewer candidates than k give fewer rows; an
empty table gives no rows.  Scores are exact while sums of products stay below
2^63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm import shards
from demandlake.llm.common import stage

SHARD_ROWS = 8192
QUERY_BLOCK = 8192  # queries that go to a copy of a shard's index (expected number)
TOGETHER = 384      # queries of a block scored at a time
LEVELS = 6
FEW = 12            # reading stops when possible members are at most FEW * (k + 1) a query, on average

INDEX = ("shard int, level int, most long, least long, dim int, ends binary, docs binary, impacts binary, "
         "vectors binary, kind string, ids binary, id_ends binary")


def segments(v: np.ndarray, levels: int = LEVELS) -> list[dict]:
    """Posting segments of integer rows ``v``: one entry per level, highest
    first; ``ends`` cuts its postings by dimension, ``most`` and ``least`` are
    its largest and smallest |impact|."""
    size = np.abs(v)
    top = int(size.max()) if v.size else 0
    if top == 0:
        return []
    step = -(-top // levels)
    quantised = (size - 1) // step          # -1 for zero: no posting
    out = []
    for level in range(levels - 1, -1, -1):
        dims, docs = np.nonzero((quantised == level).T)
        if len(dims):
            impacts = v[docs, dims]
            out.append({"level": level, "most": int(np.abs(impacts).max()), "least": int(np.abs(impacts).min()),
                        "ends": np.cumsum(np.bincount(dims, minlength=v.shape[1])).astype(np.int64),
                        "docs": docs.astype(np.int32), "impacts": impacts.astype(np.int64)})
    return out


def _smallest(v: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = int(np.abs(v).max(initial=0))
    return v.astype("<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<i8")


def build_shard(pdf: pd.DataFrame, key: str, vector: str) -> pd.DataFrame:
    ids = pdf[key].to_numpy(np.int64)
    v = np.stack([np.asarray(x, np.int64) for x in pdf[vector]])
    rows, copies = shards.grouped_copies(ids, v)
    v = v[rows]
    held = _smallest(v)
    common = {"shard": int(pdf["shard"].iloc[0]), "dim": v.shape[1], "kind": held.dtype.str}
    head = common | {"level": 1 << 20, "most": 0, "least": 0, "vectors": held.tobytes(), "ids": np.concatenate(copies).tobytes(),
                     "id_ends": np.cumsum([len(c) for c in copies]).astype(np.int64).tobytes()}
    rest = [common | {"level": s["level"], "most": s["most"], "least": s["least"], "ends": s["ends"].tobytes(),
                      "docs": s["docs"].tobytes(), "impacts": s["impacts"].astype(held.dtype).tobytes()} for s in segments(v)]
    return pd.DataFrame([head, *rest], columns=[c.split()[0] for c in INDEX.split(", ")]).astype(
        {"level": "int32", "dim": "int32", "shard": "int32"})


def possible_members(w: np.ndarray, index: list[dict], n: int, k: int) -> tuple[list[np.ndarray], int]:
    """For each query (row of integer ``w``) the rows of the index that may be
    among its ``k`` best, all others being proven not to; and levels read."""
    q, dim = w.shape
    absolute = np.abs(w)
    bound = float(absolute.sum(1).max(initial=0)) * max([s["most"] for s in index], default=0)
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
    w, absolute = w.astype(kind), absolute.astype(kind)
    score = np.zeros((q, n), kind)
    unseen = np.repeat(absolute.sum(1)[:, None], n, 1)
    for done, segment in enumerate(index):
        part, mark = np.zeros((dim, n), kind), np.zeros((dim, n), kind)
        dims = np.repeat(np.arange(dim), np.diff(np.r_[0, segment["ends"]]))
        part[dims, segment["docs"]] = segment["impacts"]
        mark[dims, segment["docs"]] = 1
        score += w @ part
        unseen -= absolute @ mark
        to_come = index[done + 1]["most"] if done + 1 < len(index) else 0
        if done + 1 < len(index) and (done < len(index) // 2 or n <= k):
            continue
        room = unseen * to_come
        low = score - room
        floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else low.min(1)
        possible = score + room >= floor[:, None]
        if done + 1 == len(index) or possible.sum() <= FEW * k * q:
            return [np.flatnonzero(p) for p in possible], done + 1
    return [np.arange(n)] * q, 0


def topk(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding",
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row of ``rows`` (``vector``: array of long) where ``is_query``:
    the ``k`` other rows with the largest inner product, as (query_id long,
    rank int, vec_id long, score long)."""
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()))
    usable = stage(shards.distinct_rows(usable, "id", "v"), "vectors")
    few = stage(shards.first_copies(usable.select("id", "v"), "id", "v", k + 1), "few")
    sizes = stage(shards.counted(few, "v", shard_rows, "shards"), "sizes")
    index = stage(shards.dealt(few, sizes, "v").groupBy("dim", "shard").applyInPandas(lambda pdf: build_shard(pdf, "id", "v"), INDEX), "impacts")
    queries = usable.where("q").select("id", "v")
    blocks = stage(shards.counted(queries, "v", QUERY_BLOCK, "blocks"), "blocks")

    def find(parts: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(parts) and len(pdf):
            parts = parts.sort_values("level", ascending=False)
            head, rest = parts.iloc[0], parts.iloc[1:]
            v = np.frombuffer(head["vectors"], head["kind"]).astype(np.int64).reshape(-1, head["dim"])
            ids = np.split(np.frombuffer(head["ids"], np.int64), np.frombuffer(head["id_ends"], np.int64)[:-1])
            read = [{"most": int(s.most), "ends": np.frombuffer(s.ends, np.int64), "docs": np.frombuffer(s.docs, np.int32),
                     "impacts": np.frombuffer(s.impacts, s.kind)} for s in rest.itertuples()]
            for a in range(0, len(pdf), TOGETHER):
                some = pdf.iloc[a:a + TOGETHER]
                w = np.stack([np.asarray(x, np.int64) for x in some["v"]])
                members, _ = possible_members(w, read, len(v), k + 1)
                for query, own, weights, nodes in zip(some["id"].to_numpy(np.int64), some["query"].tolist(), w, members):
                    scores = v[nodes] @ weights
                    if len(nodes) > k + 1:
                        best = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                        nodes, scores = nodes[best], scores[best]
                    same = (v[nodes] == weights).all(1)
                    out.extend((int(query), own, j, int(s)) for s, j in shards.best_copies(int(query), same, scores, nodes, ids, k))
        return pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"]).astype("int64")

    found = (shards.for_blocks(index, blocks).groupBy("dim", "shard", "block")
             .cogroup(shards.in_blocks(queries, "id", "v", sizes, blocks).groupBy("dim", "shard", "block"))
             .applyInPandas(find, "query_id long, query long, vec_id long, score long"))
    return shards.best_per_query(found, k)
