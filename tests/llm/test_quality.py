import zlib

import numpy as np

from demandlake.llm import quality
from demandlake.llm.queries import op5_quality_attention


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op5_quality_attention(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    assert len(got) == docs
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [x for x in labels if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert all(got[x.doc_id].held_out for x in held)
    assert np.mean([got[x.doc_id].predicted == x.quality for x in held]) >= 0.93
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_passage_features_do_not_depend_on_the_batch():
    texts = ["one two two three", "", None, "  lead " + "x y | z *** " * 200, "Ünï ÇÖ 12.5", "word " * 64 + "tail"]
    x, owner = quality.passages(texts)
    assert sorted(set(owner.tolist())) == list(range(len(texts)))
    for i, t in enumerate(texts):
        alone, _ = quality.passages([t])
        assert alone.shape == x[owner == i].shape
        np.testing.assert_allclose(alone[:, :quality.SHARES], x[owner == i][:, :quality.SHARES], atol=1e-6)
    words = len(("  lead " + "x y | z *** " * 200).split())
    assert (owner == 3).sum() == -(-words // quality.PASSAGE_WORDS)


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    x, owner, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    w = {"E": rng.normal(size=(5, 4)), "e": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)),
         "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array([0.1])}
    m = quality.AttentionModel(np.zeros(5), np.ones(5), w)

    def loss():
        s = m.forward(x, owner, 3)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    g = quality._gradient(m, x, owner, y)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            old, h = value[at], 1e-6
            value[at] = old + h
            up = loss()
            value[at] = old - h
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * h) - g[name][at]) < 1e-5


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "good text here", None), (None, "x " * 3000, "c"), (3, "good text here", None)],
                                 "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    model = quality.fit(docs, one)
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "score", "attended"] and out.count() == 5
    assert {r.score for r in out.collect()} == {1.0}
    assert quality.score(docs.limit(0), model).count() == 0
    both = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    scores = quality.score(docs, quality.fit(docs, both)).collect()
    assert len(scores) == 5 and all(0 <= r.score <= 1 for r in scores)


def test_fit_learns_from_every_passage_of_long_documents(spark):
    """Good and bad differ in one passage, in the last tenth of 200."""
    def text(i, mark):
        plain = "some plain words of no weight at all "
        return plain * 1500 + ("ZZ || 99 " * 60 if mark else "") + plain * (80 + i)

    docs = spark.createDataFrame([(i, text(i, i % 2 == 0)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    good, bad = [scores[i] for i in range(1, 60, 2)], [scores[i] for i in range(0, 60, 2)]
    assert min(good) > max(bad)


def test_sample_is_bounded_by_documents_and_by_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, owner, y: seen.append(len(y)))
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    for bounds in ({}, {"sample": 500}, {"sample_bytes": 250_000}):
        quality.fit(docs, labels, **bounds)
    assert seen[0] == 2000 and 400 < seen[1] < 600 and 180 < seen[2] < 320


def test_null_id_is_held_out_or_not(spark):
    from demandlake.llm.common import crc_remainder
    ids = spark.createDataFrame([(None,), (7,)], "doc_id long")
    assert [r[0] for r in ids.select(crc_remainder("doc_id", 5)).collect()] == [0, zlib.crc32(b"7") % 5]
