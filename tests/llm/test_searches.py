import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.llm import hnsw, impact, shards
from demandlake.llm.queries import op1_hnsw_search, op10_impact_topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def best(ids, scores, own, k):
    order = np.lexsort((ids, -scores))
    return [i for i in order if ids[i] != own][:k]


def odd_rows(rng, n=300, dim=8):
    rows = [(i, [float(x) for x in rng.normal(size=dim)], "x") for i in range(n)]
    rows += [(1000 + i, [1.0] * dim, "x") for i in range(200)]           # one very common vector
    rows += [(2000, None, "x"), (2050, [], "x"), (2100, [0.0] * dim, None), (2150, [float("nan")] * dim, "x"),
             (2200, [None] + [1.0] * (dim - 1), "x"), (2250, [float("inf")] * dim, "x"), (2300, [1.0, 2.0], "x"), (None, [1.0] * dim, "x")]
    return rows


def test_graph_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = odd_rows(rng)
    out = hnsw.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 5, shard_rows=100).collect()
    usable = [r for r in rows if r[0] is not None and r[0] < 2000]
    ids, v = np.array([r[0] for r in usable]), np.array([r[1] for r in usable], np.float32).astype(float)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        x = v[ids == q][0]
        cos = (v @ x) / (np.sqrt((v * v).sum(1)) * math.sqrt(x @ x))
        want = best(ids, np.round(cos, 12), q, 5)
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
        for r in got:
            assert abs(r.score - cos[ids == r.vec_id][0]) < 1e-12
        assert all(a.score >= b.score for a, b in zip(got, got[1:]))
        hit += len({r.vec_id for r in got} & set(ids[want]))
        total += 5
        if q >= 1000:
            assert [r.vec_id for r in got] == ids[want].tolist()
    assert hit >= 0.95 * total
    assert {r.query_id for r in out} == set(ids[ids % 50 == 0].tolist())


def test_few_candidates_and_empty_tables(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], ""), (50, [1.0, 0.1], "")], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in hnsw.search(two, F.col("vec_id") % 50 == 0, 5).orderBy("query_id").collect()] == [(0, 50), (50, 0)]
    none = two.limit(0)
    assert hnsw.search(none, F.lit(True), 5).count() == 0
    whole = F.transform("embedding", lambda x: F.floor(x * 10).cast("long"))
    ints = two.select("vec_id", whole.alias("embedding"))
    assert impact.topk(ints, F.lit(True), 5).count() == 2
    assert impact.topk(ints.limit(0), F.lit(True), 5).count() == 0


def test_stored_index_equals_the_built_one():
    rng = np.random.default_rng(3)
    import pandas as pd
    pdf = pd.DataFrame({"shard": 0, "id": np.arange(200), "v": list(rng.normal(size=(200, 6)))})
    graph, v, ids = hnsw.load_shard(hnsw.build_shard(pdf, "id", "v").iloc[0])
    again = hnsw.Graph(hnsw._unit(v), graph.levels)
    for i in range(200):
        again.insert(i)
    for layer in range(graph.top + 1):
        assert np.array_equal(graph.count[layer], again.count[layer])
    q = hnsw._unit(rng.normal(size=(1, 6)))[0]
    assert np.array_equal(graph.search(q, 32), again.search(q, 32)) and len(ids) == 200


@pytest.mark.parametrize("spread,shape", [(1, "dense"), (30, "dense"), (30, "sparse"), (2 ** 29, "dense")])
def test_possible_members_hold_the_best(spread, shape):
    rng = np.random.default_rng(spread % 1000)
    v = rng.integers(-spread, spread + 1, (400, 12))
    w = rng.integers(-spread, spread + 1, (20, 12))
    if shape == "sparse":
        v[rng.random(v.shape) < 0.8] = 0
        w[:, 3:] = 0
    members, _ = impact.possible_members(w, impact.segments(v), len(v), 7)
    for q in range(20):
        s = v @ w[q]
        floor = np.sort(s)[-7]
        assert set(np.flatnonzero(s >= floor)) <= set(members[q].tolist())


def test_reading_stops_early_on_proof():
    rng = np.random.default_rng(5)
    v = np.zeros((3000, 16), np.int64)
    at = rng.integers(0, 16, 3000)
    v[np.arange(3000), at] = rng.integers(1, 5, 3000)
    strong = rng.choice(3000, 40, replace=False)
    v[strong, 0] = 60
    for level in (15, 25, 35, 45):
        v[rng.choice(3000, 30), 1] = level
    w = np.zeros((4, 16), np.int64)
    w[:, 0] = 9
    index = impact.segments(v)
    members, read = impact.possible_members(w, index, 3000, 10)
    assert read < len(index) and all(len(m) < 3000 for m in members)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)], "x") for i in range(400)]
    rows += [(1000 + i, [2] * 6, "x") for i in range(150)] + [(2000, None, "x"), (2020, [1, None, 1, 1, 1, 1], "x"), (2040, [1], "x"),
                                                              (2060, [0] * 6, "x"), (None, [3] * 6, "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<long>, score string")
    out = impact.topk(docs, F.col("vec_id") % 20 == 0, 20, shard_rows=100).collect()
    usable = [r for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and len(r[1]) == 6]
    ids, v = np.array([r[0] for r in usable]), np.array([r[1] for r in usable])
    queries = ids[ids % 20 == 0]
    assert {r.query_id for r in out} == set(queries.tolist())
    for q in queries:
        s = v @ v[ids == q][0]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        want = best(ids, s, q, 20)
        assert [(r["rank"], r.vec_id, r.score) for r in got] == [(n + 1, ids[i], s[i]) for n, i in enumerate(want)]


def test_queries_on_the_given_table(spark):
    d = "/root/testdata/sf0.001"
    x = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in x]), np.array([r.embedding for r in x], float)
    whole = np.floor(64 * v).astype(int)
    out = op10_impact_topk(spark, d).collect()
    for q in ids[ids % 20 == 0]:
        s = whole @ whole[ids == q][0]
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in got] == [(ids[i], s[i]) for i in best(ids, s, q, 20)]
    out = op1_hnsw_search(spark, d).collect()
    u = v / np.sqrt((v * v).sum(1))[:, None]
    hit = 0
    for q in ids[ids % 50 == 0]:
        hit += len({r.vec_id for r in out if r.query_id == q} & set(ids[best(ids, u @ u[ids == q][0], q, 5)]))
    assert hit >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_first_copies_keep_the_smallest_ids(spark):
    docs = spark.createDataFrame([(i, [1]) for i in range(50)] + [(99, [2])], "id long, v array<long>")
    assert sorted(r.id for r in shards.first_copies(docs, "id", "v", 3).collect()) == [0, 1, 2, 99]


def both(spark, rows, k, every):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = F.transform("embedding", lambda x: F.floor(x * 100).cast("long"))
    near = hnsw.search(table, F.col("vec_id") % every == 0, k, shard_rows=50).collect()
    top = impact.topk(table.select("vec_id", whole.alias("embedding")), F.col("vec_id") % every == 0, k, shard_rows=50).collect()
    return near, top


def answers(out, query):
    return [(r["rank"], r.vec_id) for r in sorted((r for r in out if r.query_id == query), key=lambda r: (r["rank"], r.vec_id))]


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    once, repeated = both(spark, rows, 5, 10), both(spark, rows * 30, 5, 10)
    for a, b in zip(once, repeated):
        assert len(a) == len(b) == 6 * 5
        for q in range(0, 60, 10):
            assert answers(a, q) == answers(b, q)


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=n)]) for i, n in enumerate([8] * 120 + [3] * 70 + [5] * 10 + [2])]
    near, top = both(spark, rows, 4, 10)
    ids = np.arange(len(rows))
    for q in range(0, len(rows), 10):
        own = [i for i in ids if len(rows[i][1]) == len(rows[q][1])]
        v, w = np.array([rows[i][1] for i in own]), np.array(rows[q][1])
        cosine = (v @ w) / np.sqrt((v * v).sum(1) * (w @ w))
        product = np.floor(v * 100).astype(int) @ np.floor(w * 100).astype(int)
        want = best(np.array(own), cosine, q, 4)
        assert len(set(dict(answers(near, q)).values()) & {own[i] for i in want}) >= 0.75 * len(want) and len(answers(near, q)) == len(want)
        assert [i for _, i in answers(top, q)] == [own[i] for i in best(np.array(own), product, q, 4)]


def test_one_id_with_several_vectors(spark):
    rows = [(10, [1.0, 0.0]), (10, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0])]
    near, top = both(spark, rows, 3, 10)
    assert answers(near, 10) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 10), (3, 10)]      # each vector is ranked for itself and finds the other
    assert answers(top, 10) == answers(near, 10)
