import math

import numpy as np
from pyspark.sql import functions as F

from demandlake.llm import mixing

SCHEMA = "doc_id long, text string, domain string, n_tokens string"
TARGETS = {"a": 0.5, "b": 0.5}


def corpus(spark):
    rows = [(i, "apple pear plum " * (1 + i % 5), "a", "x") for i in range(60)] + \
           [(100 + i, "steel iron lead " * (1 + i % 3), "b", "x") for i in range(20)] + \
           [(200, "apple iron pear lead", None, "x"), (201, None, None, None), (202, "", "a", None)]
    return spark.createDataFrame(rows, SCHEMA)


def rates(n, p, targets, least=0.0):
    """Projected gradient once more, in numpy."""
    total = n.sum()
    natural = (n[:, None] * p).sum(0) / total
    r = np.full(len(n), max(1.0, least))
    last = math.inf
    for _ in range(mixing.ROUNDS):
        residual = (r * n) @ p / total - targets
        gap = (residual ** 2 / natural).sum()
        if gap < mixing.TOLERANCE ** 2 or gap > mixing.STALLED * last:
            break
        last = gap
        r = np.maximum(least, r - p @ (residual / natural))
    return r


def test_rates_against_numpy_and_targets(spark):
    docs = corpus(spark)
    model = mixing.fit_domains(docs)
    assert model.domains == ["a", "b"]
    members = mixing.posteriors(docs.select("doc_id", "text"), model).orderBy("doc_id").toPandas()
    p = members[["p0", "p1"]].to_numpy()
    np.testing.assert_allclose(p.sum(1), 1.0)
    n = members["n_tokens"].to_numpy(float)
    out = mixing.mix(docs, docs, TARGETS).orderBy("doc_id").toPandas()
    np.testing.assert_allclose(out["rate"], rates(n, p, np.array([0.5, 0.5])), atol=1e-9)
    reached = (out["rate"].to_numpy() * n) @ p / n.sum()
    np.testing.assert_allclose(reached, [0.5, 0.5], atol=1e-6)
    assert (out["rate"] >= 0).all() and (np.abs(out["copies"] - out["rate"]) <= 1).all()
    assert set(out[out.doc_id.isin([201, 202])]["n_tokens"]) == {0}


def test_posterior_against_plain_naive_bayes(spark):
    docs = corpus(spark)
    model = mixing.fit_domains(docs)
    got = {r.doc_id: (r.p0, r.p1) for r in mixing.posteriors(docs, model).collect()}
    for r in docs.collect():
        words = set((r.text or "").lower().split(" "))
        logit = [b + sum(row[i] for w, row in zip(model.words, model.present) if w in words) for i, b in enumerate(model.base)]
        e = np.exp(np.array(logit) - max(logit))
        np.testing.assert_allclose(got[r.doc_id], e / e.sum(), rtol=1e-9)


def test_growth_keeps_every_document(spark):
    docs = corpus(spark)
    out = mixing.resample(docs, docs, TARGETS, least=1.0, growth=True)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(counts) == {r.doc_id for r in docs.collect()}
    steel = sum(c for i, c in counts.items() if 100 <= i < 200)
    assert steel > 1.5 * 20


def test_sampling_takes_documents_out(spark):
    docs = corpus(spark)
    out = mixing.resample(docs, docs, {"a": 0.1, "b": 0.9})
    assert out.where("doc_id < 100").count() < 40


def test_empty_and_unlabelled(spark):
    docs = corpus(spark)
    none = docs.where(F.lit(False))
    out = mixing.mix(docs, none, TARGETS)
    assert {r.rate for r in out.collect()} == {1.0}
    assert mixing.mix(none, docs, TARGETS).count() == 0
    assert mixing.resample(docs, none, TARGETS).count() == docs.count()
    one = mixing.mix(docs, docs.where("domain = 'a'"), {"a": 1.0})
    assert {round(r.rate, 6) for r in one.collect()} == {1.0}


def test_words_end_at_any_white_space_and_totals_are_shown(spark):
    rows = [(i, t, d, "x") for i, (t, d) in enumerate([("apple\npear\tplum", "a"), (" apple  pear\r\n", "a"), ("steel\niron", "b"),
                                                       ("\n \t", None), ("steel " * 50000, "b"), ("steel " * 50000, "b")])]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = mixing.fit_domains(docs)
    assert set(model.words) == {"apple", "pear", "plum", "steel", "iron"}
    out = mixing.mix(docs, docs, TARGETS).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [3, 2, 2, 0, 50000, 50000]
    assert out[4].rate == out[5].rate
    shares = np.array([[r.domains[d] for d in ("a", "b")] for r in out])
    reached = (np.array([r.rate * r.n_tokens for r in out])) @ shares / sum(r.n_tokens for r in out)
    np.testing.assert_allclose([out[0].reached["a"], out[0].reached["b"]], reached, atol=1e-9)
    assert out[0].targets == TARGETS
    unfit = mixing.mix(docs, docs.where(F.lit(False)), TARGETS).first()
    assert unfit.targets is None and unfit.reached is None


def test_plan_is_native(spark):
    docs = corpus(spark)
    assert "Python" not in mixing.mix(docs, docs, TARGETS)._jdf.queryExecution().toString()
