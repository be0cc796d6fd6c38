import hashlib

import numpy as np

from demandlake.llm import vafile
from demandlake.llm.queries import op11_vafile_clusters

SF = "/root/testdata/sf0.001"


def brute(rows, k=40, rounds=5, seed=2, scale=256, dim=64):
    kept = [(i, np.floor(scale * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))
    c = np.stack([v for _, v in order[:k]])
    x = np.stack([v for _, v in kept])
    for step in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        best = d.argmin(1)
        if step < rounds:
            c = np.stack([x[best == j].sum(0) // (best == j).sum() if (best == j).any() else c[j] for j in range(len(c))])
    near = d.min(1)
    own = [int(near[best == b].sum()) for b in best]
    sha = [hashlib.sha256(",".join(map(str, c[b].tolist())).encode()).hexdigest() for b in best]
    return sorted(((i, int(b), int(n), o, int(near.sum()), s) for (i, _), b, n, o, s in zip(kept, best, near, own, sha)), key=str)


def run(rows, spark, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string").repartition(4)
    return sorted(map(tuple, vafile.digest(*vafile.cluster(df, more.pop("k", 40), 5, seed=2, **more)).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op11_vafile_clusters(spark, SF).collect()), key=str) == brute(rows)


def test_clustered_tied_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.05 * rng.normal(size=64)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 64) for i in range(200)] + [(7, [0.5] * 64)] * 20       # hot vector, repeated row
    rows += [(2000 + i, [0.25 * (i % 2)] * 64) for i in range(20)]                      # ties
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63), (6, [float("nan")] * 64), (8, [float("inf")] * 64),
           (None, [2.0] * 64)]
    assert run([(i, v, "x") for i, v in rows + odd], spark) == brute(rows + odd)


def test_few_empty_and_extreme(spark):
    two = [(1, [0.0] * 64, "x"), (2, [1.0] * 64, None)]
    assert run(two, spark) == brute([r[:2] for r in two])
    assert run([], spark) == [] and run([(1, None, "x")], spark) == []
    huge = run([(1, [3e38] * 64, "x"), (2, [-3e38] * 64, "x"), (3, [0.0] * 64, "x")], spark, k=1)
    assert len(huge) == 3 and max(r[2] for r in huge) < 2 ** 63 and huge[0][4] <= 2 ** 63 - 1


def test_bounds_hold_and_spare_full_vectors():
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (10, 9))
    x = centres[rng.integers(0, 10, 3000)] + rng.integers(-3, 4, (3000, 9))
    f = x.astype(float)
    cells = vafile.Cells(len(x), f.sum(0), (f * f).sum(0), x.min(0), x.max(0))
    codes = cells.approximate(x)
    assert ((cells.low[np.arange(9), codes] <= x) & (x <= cells.high[np.arange(9), codes])).all() and codes.max() < 64
    bounds = vafile.Bounds(cells, centres)
    low, high = bounds.of(codes)
    exact = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    asked = []
    compute = bounds._exact
    bounds._exact = lambda full, row, centroid: (asked.append(len(row)), compute(full, row, centroid))[1]
    best, _ = bounds.nearest(codes, x.astype(np.int32), False)
    assert (best == exact.argmin(1)).all() and sum(asked) < 0.2 * len(x)
