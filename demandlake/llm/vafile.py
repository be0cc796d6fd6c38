"""Centroid clustering over a vector-approximation file.

Every vector is stored beside its approximation: per dimension the number of
the cell (``2^BITS`` of them) its component lies in.  Cells have equal width
around the mean of their dimension and end at its least and largest value, so
each is a closed interval.  For a round's centroids a table per dimension
holds the squared distance of the centroid's component to the nearest and to
the farthest point of every cell.  Their sums bound the distance of a vector to each centroid from below and
above.  A centroid stays possible while its lower bound does not exceed the
least upper bound; a full vector is read for a distance only where more than
one stays: first against the centroid with the least lower bound, whose exact
distance then rules out most others, then against the rest.

Rounds are exact.  Components, sums and distances are integers, so the result
does not depend on how rows are spread.  Per round every task sends one sum
and count a centroid (from the full vectors, as any exact mean needs), which
the driver turns into the next centroids; what the driver holds is k vectors.

Defined results: vectors that are null, of another length, or hold a null or
non-finite component take no part; components are held within +-2^27, so that
a squared distance fits a long (an input of such size is outside what the
result columns can show), and an inertia beyond a long is shown as the largest
long; repeated rows are vectors of their own, also as first centroids; a null
id comes last in the choice of those; fewer vectors than k give that many
centroids; an empty table gives no rows; columns other than id and vector are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import stage

BITS = 6
BLOCK = 2048          # vectors bounded at a time
PAIRS = 1 << 14       # (vector, centroid) distances computed at a time
MOST = 2 ** 27
LONGEST = 2 ** 63 - 1


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def integers(rows: DataFrame, dim: int, scale: int, key: str, vector: str) -> DataFrame:
    """(id, full): usable vectors as floor(scale x), packed 32-bit integers."""
    x = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    usable = (F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform("x", lambda v: F.greatest(F.least(F.floor(F.greatest(F.least(v, F.lit(1e12)), F.lit(-1e12)) * scale), F.lit(MOST)), F.lit(-MOST)))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dim)
            data = flat.tobytes()
            full = [data[i:i + 4 * dim] for i in range(0, len(data), 4 * dim)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.binary())], ["id", "full"])

    found = rows.select(F.col(f"`{key}`").cast("long").alias("id"), x.alias("x")).where(F.col("x").isNotNull()).where(usable)
    return found.select("id", whole.alias("x")).mapInArrow(pack, "id long, full binary")


class Cells:
    """Marks of the cells: ``low[d, c]`` and ``high[d, c]`` are the ends (both
    inside) of cell c of dimension d."""

    def __init__(self, n: int, total: np.ndarray, square: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS):
        mean = total / n
        spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
        width = np.maximum(np.ceil(7 * spread / 2 ** bits), 1)
        step = np.arange(1, 2 ** bits) - 2 ** (bits - 1)
        self.marks = np.floor(mean[:, None] + width[:, None] * step).astype(np.int64)   # where cells 1, 2, ... begin
        self.low = np.maximum(np.c_[least, self.marks], least[:, None])
        self.high = np.minimum(np.c_[self.marks - 1, most], most[:, None])

    def approximate(self, full: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, full[:, d], "right") for d, m in enumerate(self.marks)], 1).astype(np.uint8)


def statistics(vectors: DataFrame, dim: int) -> Cells | None:
    """Cells from the count, sums, and extremes of all vectors (one row a task
    and dimension)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(0), dim).astype(np.int64)
                f = v.astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(dim), pa.int32()), pa.array([len(v)] * dim, pa.int64()), pa.array(f.sum(0)), pa.array((f * f).sum(0)),
                     pa.array(v.min(0)), pa.array(v.max(0))], ["d", "n", "total", "square", "least", "most"])

    rows = (vectors.select("full").mapInArrow(run, "d int, n long, total double, square double, least long, most long").groupBy("d")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square"),
                 F.min("least").alias("least"), F.max("most").alias("most")).orderBy("d").collect())
    if not rows:
        return None
    return Cells(rows[0]["n"], *(np.array([r[c] for r in rows]) for c in ("total", "square", "least", "most")))


class Bounds:
    """Lookup tables of one round's centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        c = centroids[:, :, None]
        low = np.maximum(np.maximum(cells.low - c, c - cells.high), 0).astype(np.float64) ** 2     # k, dim, cells
        high = np.maximum(np.abs(cells.low - c), np.abs(cells.high - c)).astype(np.float64) ** 2
        both = np.concatenate([low, high])                                                          # 2k, dim, cells
        self.tables = np.ascontiguousarray(both.transpose(1, 2, 0))                                 # per dimension and cell: row of 2k
        self.centroids, self.k = centroids, len(centroids)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of every vector to every centroid.  Rounding
        of the sums is taken off and added on."""
        total = np.zeros((len(codes), 2 * self.k))
        for d, table in enumerate(self.tables):
            total += table[codes[:, d]]
        slack = total * 1e-13
        return (total - slack)[:, :self.k], (total + slack)[:, self.k:]

    def _exact(self, full: np.ndarray, row: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for a in range(0, len(row), PAIRS):
            difference = full[row[a:a + PAIRS]].astype(np.int64) - self.centroids[centroid[a:a + PAIRS]]
            out[a:a + PAIRS] = np.einsum("ij,ij->i", difference, difference)
        return out

    def nearest(self, codes: np.ndarray, full: np.ndarray, distances: bool) -> tuple[np.ndarray, np.ndarray]:
        """(nearest centroid, its exact squared distance); distances of
        vectors that the bounds alone decide only on demand."""
        low, high = self.of(codes)
        possible = low <= high.min(1)[:, None]
        first = low.argmin(1)
        decided = possible.sum(1) == 1
        read = np.ones(len(codes), bool) if distances else ~decided
        best = first.copy()
        distance = np.full(len(codes), LONGEST, np.int64)
        rows = np.flatnonzero(read)
        distance[rows] = self._exact(full, rows, first[rows])
        possible[decided] = False
        possible[np.arange(len(codes)), first] = False
        row, centroid = np.nonzero(possible & (low <= distance[:, None]))
        if len(row):
            found = self._exact(full, row, centroid)
            order = np.lexsort((centroid, found, row))
            row, centroid, found = row[order], centroid[order], found[order]
            top = np.r_[True, row[1:] != row[:-1]]
            row, centroid, found = row[top], centroid[top], found[top]
            better = (found < distance[row]) | (found == distance[row]) & (centroid < best[row])
            best[row[better]], distance[row[better]] = centroid[better], found[better]
        return best, distance


def _assigned(batches: Iterable[pa.RecordBatch], bounds: Bounds, dim: int, distances: bool):
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            codes = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, dim)
            full = _vectors(part.column("full"), dim)
            yield part, full, *bounds.nearest(codes, full, distances)


def _round(file: DataFrame, cells: Cells, centroids: np.ndarray) -> np.ndarray:
    """The next centroids."""
    dim = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(cells, centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, full, best, _ in _assigned(batches, bounds, dim, False):
            order = np.argsort(best, kind="stable")
            held, first = np.unique(best[order], return_index=True)
            total[held] += np.add.reduceat(full[order].astype(np.int64), first, axis=0)
            count += np.bincount(best, minlength=len(centroids))
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(held)), pa.int32()),
             pa.array(np.repeat(count[held], dim), pa.int64()), pa.array(total[held].ravel(), pa.int64())], ["cluster", "d", "n", "total"])

    out = centroids.copy()
    sums = file.mapInArrow(run, "cluster int, d int, n long, total long").groupBy("cluster", "d").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    for r in sums.collect():
        out[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    return out


def cluster(rows: DataFrame, k: int, rounds: int, seed: int, dim: int = 64, scale: int = 256,
            key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((key long, cluster int, distance long) of every usable vector, the
    final centroids)."""
    made = f"`{key}` long, cluster int, distance long"
    whole = stage(integers(rows, dim, scale, key, vector), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = whole.orderBy(F.asc_nulls_last(hashed), "full").limit(k).collect()
    cells = statistics(whole, dim)
    if cells is None:
        return rows.sparkSession.createDataFrame([], made), np.zeros((0, dim), np.int64)
    centroids = np.stack([np.frombuffer(r["full"], "<i4") for r in first]).astype(np.int64)

    def approximate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = cells.approximate(_vectors(batch.column(1), dim)).tobytes()
            codes = [data[i:i + dim] for i in range(0, len(data), dim)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), batch.column(1)], ["id", "cells", "full"])

    file = stage(whole.mapInArrow(approximate, "id long, cells binary, full binary"), "vafile")
    for _ in range(rounds):
        centroids = _round(file.select("cells", "full"), cells, centroids)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(cells, centroids)
        for part, _, best, distance in _assigned(batches, bounds, dim, True):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best, pa.int32()), pa.array(distance)], [key, "cluster", "distance"])

    return stage(file.mapInArrow(final, made), "clusters"), centroids


def digest(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with its cluster's and the whole inertia and the hash of
    its centroid.  The table joined has a row a centroid."""
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    held = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(exact.alias("inertia")).collect()}
    shown = [(int(c), min(i, LONGEST), min(sum(held.values()), LONGEST),
              hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, i in held.items()]
    about = assigned.sparkSession.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster")


ROUNDS = 5
TOP = 40


def _clustered_sql() -> str:
    """DuckDB twin over ``embeddings``: rounds written out one after another."""
    near = """a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, min_by(c, distance * 1000 + c) AS c, min(distance) AS distance FROM (
    SELECT r, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM vectors CROSS JOIN c{i}) GROUP BY r, vec_id, v)"""
    move = """c{j} AS MATERIALIZED (
  SELECT old.c, coalesce(new.w, old.w) AS w FROM c{i} old LEFT JOIN (
    SELECT c, list(f ORDER BY d) AS w FROM (
      SELECT c, d, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM (
        SELECT c, unnest(v) AS x, unnest(range({dim})) AS d FROM a{i}) GROUP BY c, d) GROUP BY c) new ON old.c = new.c)"""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(near.format(i=i))
        if i < ROUNDS:
            steps.append(move.format(i=i, j=i + 1, dim=64))
    return f"""WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (
    SELECT sha256('2:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT {TOP})),
{', '.join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)"""


CLUSTERED_SQL = _clustered_sql()
