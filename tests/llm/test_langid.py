import math

import numpy as np

from demandlake.llm import langid
from demandlake.llm.queries import op9_language_id

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op9_language_id(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [x for x in docs if got[x.doc_id].held_out]
    assert sum(got[x.doc_id].lang_pred == x.lang for x in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_defined_cases(spark):
    rows = [(i, "the quick brown fox " * 3 + str(i), "en", "s") for i in range(20)] + \
           [(100 + i, "der schnelle braune fuchs " * 3 + str(i), "de", "s") for i in range(20)] + \
           [(200, None, "en", "s"), (201, "123 !? ", "en", "s"), (202, "the fox", None, "s"), (203, "", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(docs)
    assert model.languages == sorted(model.languages) and set(model.languages) == {"en", "de"}
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "lang", "nearest", "score", "rejected", "language"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].nearest == "en" and got[100 + i].nearest == "de" for i in range(20))
    assert not any(got[i].rejected for i in range(20))
    for i in (200, 201, 203):
        assert (got[i].nearest, got[i].score, got[i].rejected, got[i].language) == ("und", 0.0, True, "und")
    assert got[202].nearest == "en"
    far = spark.createDataFrame([(1, "xyzzy qwqw zxzx vbvb", None, None)], SCHEMA)
    row = langid.predict(far, model).first()
    assert row.rejected and row.language == "und" and row.nearest in ("en", "de")


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None, "")], SCHEMA)
    model = langid.fit(docs)
    assert model.languages == []
    assert langid.predict(docs, model).first().nearest == "und"
    assert langid.predict(docs.limit(0), model).count() == 0


def test_document_frequencies_against_a_plain_count(spark):
    rows = [(i, t, "en", "") for i, t in enumerate(["abc abc", "abd", None, "77", "abc abc", "é"])]
    df, n = langid.document_frequencies(spark.createDataFrame(rows, SCHEMA))
    want = sum((langid.term_counts(t) > 0).astype(int) for _, t, _, _ in rows if langid.has_letter(t))
    assert n == 4 and np.array_equal(df, want)


def test_clusters_separate():
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(3, 8), 30, 0) + rng.normal(0, 0.02, (90, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, r = langid.cluster(x.astype(np.float32), 3)
    assert sorted(np.argmax(c, 1).tolist()) == [0, 1, 2] and (r < 0.2).all()


def plain_vector(text, idf):
    """{place: weight} of length one, gram by gram."""
    kept = "".join(chr(c) if c >= 128 or chr(c).isalpha() else " " for c in text.lower().encode("utf-8", "replace"))
    data = (" " + " ".join(w for w in kept.split(" ") if w) + " ").encode("latin-1")
    counts = {}
    for n, mark in ((2, 0), (3, 1 << 24), (4, 0)):
        for i in range(len(data) - n + 1):
            place = ((int.from_bytes(data[i:i + n], "big") | mark) * 2654435761 % 2 ** 32) >> 19
            counts[place] = counts.get(place, 0) + 1
    v = {p: (1 + math.log(c)) * float(idf[p]) for p, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {p: x / norm for p, x in v.items()}


def test_predictions_against_every_centroid_in_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    whole = docs.drop("lang")
    long = spark.createDataFrame([(-1, "ein sehr langer satz und noch einer " * 20000), (-2, None), (-3, "12 345")], whole.schema)
    asked = whole.unionByName(long)
    got = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert len(got) == asked.count() and got[-2].nearest == got[-3].nearest == "und" and got[-1].nearest == "de"
    for r in asked.where("text is not null and doc_id <> -3").collect():
        v = plain_vector(r.text, model.idf)
        at, weight = list(v), np.array(list(v.values()))
        cosine = [float(weight @ c[at].astype(float)) for c in model.centroids]
        best, found = max(cosine), got[r.doc_id]
        assert abs(found.score - best) < 1e-5
        # single-precision sums: any centroid this near the best may be taken
        near = [i for i, c in enumerate(cosine) if c > best - 1e-5]
        assert found.nearest in {model.languages[i] for i in near}
        if len(near) == 1 and abs(1 - best - model.radius[near[0]]) > 1e-5:
            assert found.rejected == (1 - best > model.radius[near[0]])
            assert found.language == ("und" if found.rejected else found.nearest)
