import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from demandlake.llm import importance
from demandlake.llm.queries import op12_importance_resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, seed=42):
    count = [[0] * 10000, [0] * 10000]
    for side, texts in enumerate(([t for _, t in docs], target)):
        for t in texts:
            for b in features(t):
                count[side][b] += 1
    s, t = count
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows, able = [], []
    for n, (key, text) in enumerate(docs):
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words(text)) >= 20:
            able.append(n)
    able.sort(key=lambda n: (-rows[n][3], rows[n][0] is None, rows[n][0], rows[n][1]))
    for rank, n in enumerate(able[:percent * len(able) // 100], 1):
        rows[n][4] = rank
    return sorted(map(tuple, rows), key=str)


def test_crc_of_spans_of_any_length():
    data = np.random.default_rng(0).integers(0, 256, 300_000).astype(np.uint8)
    raw, rng = data.tobytes(), np.random.default_rng(1)
    length = np.r_[1, 2, 63, 64, 65, 127, 128, 129, 191, 192, 193, 4095, 4096, 4097, 65536, 299_999, rng.integers(1, 300, 2000)]
    start = np.array([rng.integers(0, len(raw) - n + 1) for n in length])
    assert importance.crc32_spans(data, start, start + length).tolist() == [zlib.crc32(raw[a:a + n]) for a, n in zip(start, length)]
    short = length[length <= 64]
    assert importance.crc32_spans(data, start[:len(short)] * 0, short).tolist() == [zlib.crc32(raw[:n]) for n in short]
    assert len(importance.crc32_spans(data, start[:0], start[:0])) == 0


def test_features_of_cut_texts(monkeypatch):
    texts = ["One two, THREE four" * 40, "x" * 700 + " y z", "  é日本 a1 \n\n b " * 30, None, "", "...", "word"]
    whole = [features(t) for t in texts]
    for part in (1 << 20, 100, 17):
        monkeypatch.setattr(importance, "PART", part)
        got = [[] for _ in texts]
        for rows, w in importance._batches(pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())}), 0):
            for crc, have in w.features(3):
                at = np.r_[0, np.cumsum(have)]
                for i, row in enumerate(rows):
                    got[row] += (crc[at[i]:at[i + 1]] % np.uint32(10000)).tolist()
        assert [sorted(g) for g in got] == [sorted(w) for w in whole]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = op12_importance_resampling(spark, SF)
    assert [t for _, t in out.dtypes] == ["bigint"] * 5
    want = brute(docs, target)
    assert sorted(map(tuple, out.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) >= 5


def test_odd_rows_and_a_wide_draw(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{text} n{i % 7}") for i in range(150)] + [(900, text)] * 3 + [
        (1, None), (2, ""), (3, "!!"), (None, text), (None, text + " end"), (4, "few words"), (5, ("Long tail of words " * 120_000)), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, rank int").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 tail of",), (None,)], "text string")
    got = importance.resample(docs, target, 50, 42).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, ["w1 w2 w3 tail of", None], 50)
    assert importance.resample(docs.limit(0), target, 5, 42).count() == 0
    empty = importance.resample(docs, target.limit(0), 5, 42)
    assert empty.where(F.col("rank").isNotNull()).count() == 5 * 157 // 100
