import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        if i < len(P.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.toPandas(), docs.toPandas())
    a, b = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id) & set(a.doc_id)
    assert len(good & set(b.doc_id)) >= 0.97 * len(good) and len(b) < len(a)
    a, b = seen["near_duplicates"]
    assert set(b.doc_id) < set(a.doc_id) and b.doc_id.is_unique and not b.text.duplicated().any()
    a, b = seen["pii"]
    assert a.doc_id.tolist().sort() == b.doc_id.tolist().sort()
    changed = a.merge(b, on="doc_id").query("text_x != text_y")
    assert len(changed) and changed.text_x.str.contains("[0-9@]").all() and (b.text.str.len() == b.n_chars).all()
    a, b = seen["mixing"]
    assert set(a.doc_id) == set(b.doc_id) and len(b) >= len(a)
    a, b = seen["tokens"]
    assert len(a) == len(b)
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(zip(a.doc_id, a.text))
    for r in b.itertuples():
        assert np.frombuffer(r.ids_u32le, "<u4").tolist() == lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)


def test_odd_rows_pass_every_stage(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "text without an id", "en", None, 18), (3, "call +1 (017) 555-7713 now " * 3, "en", "s", None),
            (3, "call +1 (017) 555-7713 now " * 3, "en", "s", None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES[1:]:
        out = stage(spark, docs, SF)
        assert out.count() >= 5 or name == "near_duplicates", name
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert out.where(F.col("doc_id").isNull()).count() >= 1, name
    assert P.STAGES[0][1](spark, docs, SF).count() <= 5


def test_near_duplicates_go_by_row(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    texts = [(5, a), (5, a), (7, a + " tail"), (5, b), (None, a), (None, b + " end"), (9, None), (9, None), (10, ""), (11, "!!"), (12, "unlike any other text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema)
    out = dict(P.STAGES)["near_duplicates"](spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0), (r.text or "-")[:6]) for r in out) == [
        (5, "alpha0"), (5, "beta0 "), (9, "-"), (9, "-"), (10, "-"), (11, "!!"), (12, "unlike")]


def test_numbers_longer_than_a_long_pass_the_stages(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    texts = [f"number {i} is {'1234567890' * 3}"[:13 + len(str(i)) + i] + " here" for i in range(31)] + ["write a1234567890123456789012@example.com"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    for name, stage in P.STAGES[2:]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema) if name != "tokens" else stage(spark, docs, SF)
        assert {r.doc_id for r in docs.collect()} == set(range(32)), name
        if name == "pii":
            out = {r.doc_id: r.text for r in docs.collect()}
            assert out[19] == texts[19] and out[21] == texts[21] and "@redacted.invalid" in out[31]
