"""Vectors dealt into shards of bounded size, for the searches over them.

Vectors of different lengths are not comparable: each length has shards and
query blocks of its own.  The tables of lengths (a row per length) stay in
Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """No component is null, NaN or infinite (and there is one)."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def distinct_rows(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Equal rows (same id, same vector) once; they meet in map-side partial
    aggregates, so a row that repeats without end costs one row a task."""
    return rows.dropDuplicates([key, vector])


def first_copies(rows: DataFrame, key: str, vector: str, keep: int) -> DataFrame:
    """Of equal vectors the ``keep`` smallest ids.  No other copy can be among
    the keep - 1 nearest of any query but its own.  The rank filter becomes a
    per-task group limit before the shuffle, so a vector that holds a third of
    all rows sends ``keep`` rows a task."""
    nth = F.row_number().over(Window.partitionBy(vector).orderBy(key))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= keep).drop("__nth")


def counted(rows: DataFrame, vector: str, most: int, out: str) -> DataFrame:
    """(dim, out): for every length the number of parts of about ``most`` rows."""
    return rows.groupBy(F.size(vector).alias("dim")).agg(F.ceil(F.count("*") / most).cast("int").alias(out))


def dealt(rows: DataFrame, sizes: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``dim`` and ``shard``, by a hash of the vector."""
    return (rows.withColumn("dim", F.size(vector)).join(sizes, "dim")
            .withColumn("shard", F.pmod(F.xxhash64(F.lit(1), F.col(vector)), F.col("shards")).cast("int")).drop("shards"))


def in_blocks(queries: DataFrame, key: str, vector: str, sizes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every query once for every shard of its length, in blocks by a hash;
    ``query`` tells the vectors of one id apart."""
    own = F.xxhash64(F.col(vector))
    return (queries.withColumn("dim", F.size(vector)).join(sizes, "dim").join(blocks, "dim")
            .withColumn("query", own)
            .withColumn("block", F.pmod(F.xxhash64(F.lit(3), F.col(key), own), F.col("blocks")).cast("int"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "blocks"))


def for_blocks(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """The index of a shard once for every block of queries of its length.
    Blocks hold as many queries as shards hold vectors, so the copies weigh
    no more than the queries that are sent to every shard."""
    return index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def best_per_query(found: DataFrame, k: int) -> DataFrame:
    """The shards' finds merged: ``k`` best of every query vector."""
    nth = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return (found.distinct().withColumn("rank", nth).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def best_copies(query: int, same: np.ndarray, scores: np.ndarray, nodes: np.ndarray, ids: list[np.ndarray], k: int) -> list[tuple]:
    """The k best (score, id) of the copies of ``nodes``, the query's own row
    (its id on a vector the ``same``) left out; ties to the smaller id."""
    found = [(-s, int(i)) for s, n, own in zip(scores.tolist(), nodes.tolist(), same.tolist()) for i in ids[n] if not (own and i == query)]
    found.sort()
    return [(-s, i) for s, i in found[:k]]


def grouped_copies(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows of the distinct vectors, in order of smallest id; ids of each)."""
    order = np.argsort(ids, kind="stable")
    groups: dict[bytes, list[int]] = {}
    for r in order:
        groups.setdefault((vectors[r] + 0.0).tobytes(), []).append(int(r))
    rows = np.array([g[0] for g in groups.values()], np.int64)
    return rows, [ids[np.array(g)] for g in groups.values()]
