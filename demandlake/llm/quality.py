"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE_WORDS`` words each; the label
belongs to the bag).  Every passage is encoded: a vector of surface shares
(letter case, digits, marks, repeated words, word length) and hashed byte
pairs goes through one tanh layer.  Gated attention weighs the passages,

    a_k  ~  exp( w . ( tanh(V h_k) * sigmoid(U h_k) ) ),

and the weighted sum of the encodings is scored by a logistic unit.  All
weights are learned together from document labels (Adam, fixed seed).

The model is fitted on the driver on a bounded sample of labelled rows: about
``sample`` documents, fewer where these would hold more than ``sample_bytes``
of text in all (both expected numbers, drawn by a hash of the id).  Of a drawn
document every passage is learned from.  Passages stay half-precision numbers,
536 bytes for 64 words, and are normalised batch by batch.  Scoring
encodes every passage of every whole text in ``mapInArrow``, without a
shuffle; the model (some 100 KB) travels with the function.

Defined results: a null or empty text is one empty passage and gets a score
like any other; a null label is not learned from; a document with several
labels is learned with their mean; with one class only (or no labels) every
score is the share of label 1 (0.5 without labels).  Extra columns are kept;
columns that clash with an output name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE_WORDS = 64
SAMPLE = 6000   # labelled documents the fit sees (expected number)
SAMPLE_BYTES = 48 << 20  # and their text (expected sum)
PAIRS = 256     # places of hashed byte pairs
SHARES = 12
HIDDEN, ATTENTION = 24, 16
EPOCHS, BATCH, RATE, DECAY = 16, 64, 4e-3, 1e-4

_KIND = np.zeros(256, np.int64)  # 0 other mark, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 beyond ASCII
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 6 if _c >= 128 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() \
        else 4 if _ch.isspace() else 5 if _ch in ".,;:'-" else 0


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, document index of every passage)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    length = np.array([len(r) + 1 for r in raw])
    doc = np.repeat(np.arange(len(raw)), length)
    kind = _KIND[data]
    blank = kind == 4
    start = ~blank & np.r_[True, blank[:-1]]          # first byte of a word
    word = np.cumsum(start)                            # 1-based, over the batch
    before = np.r_[0, word[np.cumsum(length)[:-1] - 1]]  # words before each document
    within = np.maximum(word - before[doc] - 1, 0) // PASSAGE_WORDS
    count = np.zeros(len(raw), np.int64)
    np.maximum.at(count, doc[start], within[start])
    count += 1
    base = np.r_[0, np.cumsum(count)[:-1]]
    passage = base[doc] + within
    n = int(count.sum())
    owner = np.repeat(np.arange(len(raw)), count)

    kinds = np.bincount(passage * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float64)
    size = np.maximum(kinds.sum(1), 1.0)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 6], 1.0)

    at = np.flatnonzero(start)
    words = np.maximum(np.bincount(passage[at], minlength=n), 1)
    if len(at):
        place = np.arange(len(data)) - np.repeat(at, np.diff(np.r_[at, len(data)]), axis=0) if at[0] == 0 else \
            np.arange(len(data)) - np.r_[np.zeros(at[0], np.int64), np.repeat(at, np.diff(np.r_[at, len(data)]))]
        term = np.where(blank, 0, (data.astype(np.uint64) + np.uint64(1)) * _power(place))
        name = np.add.reduceat(term, at)
        same = np.r_[False, (name[1:] == name[:-1]) & (passage[at][1:] == passage[at][:-1])]
        again = np.bincount(passage[at], weights=same, minlength=n)
        both = name * np.uint64(0x9E3779B97F4A7C15) + passage[at].astype(np.uint64)
        distinct = np.bincount(passage[at][np.unique(both, return_index=True)[1]], minlength=n)
        lone = np.r_[blank[at[1:] - 1] & (np.diff(at) <= 2), False] if len(at) > 1 else np.array([False])
        alone = np.bincount(passage[at], weights=lone & (kind[at] == 0), minlength=n)
    else:
        again = distinct = alone = np.zeros(n)
    shares = np.stack([
        kinds[:, 0] / size, kinds[:, 2] / letters, kinds[:, 3] / size, kinds[:, 4] / size, kinds[:, 5] / size,
        kinds[:, 6] / letters, letters / size, again / words, distinct / words, alone / words,
        np.minimum(size / words / 20.0, 2.0), np.log1p(words) / 5.0], 1)
    pair = (data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]) * np.uint32(2654435761) >> np.uint32(24)
    hashed = np.bincount(passage[:-1] * PAIRS + pair.astype(np.int64), minlength=n * PAIRS).reshape(n, PAIRS)
    hashed = np.sqrt(hashed / size[:, None])
    return np.concatenate([shares, hashed], 1).astype(np.float32), owner


def _power(place: np.ndarray) -> np.ndarray:
    table = np.empty(256, np.uint64)
    x = 1
    for i in range(256):
        table[i] = x
        x = x * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return table[place & 255] + (place >> 8).astype(np.uint64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        raw = (t * g) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, owner, raw)
        a = np.exp(raw - top[owner])
        a /= np.bincount(owner, weights=a, minlength=bags)[owner]
        z = np.zeros((bags, h.shape[1]), h.dtype)
        np.add.at(z, owner, a[:, None] * h)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, x: np.ndarray, owner: np.ndarray, bags: int) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage)."""
        if self.constant is not None:
            return np.full(bags, self.constant), 1.0 / np.bincount(owner, minlength=bags)[owner]
        out = self.forward((x - self.mean) / self.scale, owner, bags)
        return out["score"], out["a"]


def _gradient(m: AttentionModel, x, owner, y):
    p, bags = m.weights, len(y)
    f = m.forward(x, owner, bags)
    ds = (f["score"] - y) / bags
    dz = ds[:, None] * p["c"][None, :]
    da = np.einsum("kh,kh->k", dz[owner], f["h"])
    dr = f["a"] * (da - np.bincount(owner, weights=f["a"] * da, minlength=bags)[owner])
    dt, dg = dr[:, None] * p["w"] * f["g"], dr[:, None] * p["w"] * f["t"]
    dt *= 1 - f["t"] ** 2
    dg *= f["g"] * (1 - f["g"])
    dh = (f["a"][:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ dr,
            "c": f["z"].T @ ds, "d": np.array([ds.sum()])}


def _moments(x: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(mean, standard deviation) of the columns, a block of rows at a time."""
    total = np.zeros(x.shape[1])
    for i in range(0, len(x), rows):
        total += x[i:i + rows].sum(0, dtype=np.float64)
    mean = total / len(x)
    square = np.zeros(x.shape[1])
    for i in range(0, len(x), rows):
        square += ((x[i:i + rows] - mean) ** 2).sum(0)
    return mean, np.sqrt(square / len(x))


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 7) -> AttentionModel:
    """Fit on passages ``x`` of bags ``owner`` (sorted) with labels ``y``."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return AttentionModel(np.zeros(1), np.ones(1), {}, share)
    rng = np.random.default_rng(seed)
    mean, deviation = _moments(x)
    mean, scale = mean.astype(np.float32), (deviation + 0.02).astype(np.float32)
    d = x.shape[1]
    m = AttentionModel(mean, scale, {
        "E": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "e": np.zeros(HIDDEN),
        "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
        "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.array([np.log(share / (1 - share))])})
    m.weights = {k: v.astype(np.float32) for k, v in m.weights.items()}
    first = {k: np.zeros_like(v) for k, v in m.weights.items()}
    second = {k: np.zeros_like(v) for k, v in m.weights.items()}
    begin = np.searchsorted(owner, np.arange(len(y) + 1))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            own = order[i:i + BATCH]
            rows = np.concatenate([np.arange(begin[b], begin[b + 1]) for b in own])
            bag = np.repeat(np.arange(len(own)), begin[own + 1] - begin[own])
            step += 1
            for k, g in _gradient(m, (x[rows].astype(np.float32) - mean) / scale, bag, y[own]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m.weights[k] -= rate * (first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                                        + DECAY * m.weights[k] * (k in ("E", "c")))
    return m


def _slices(batches: Iterable[pa.RecordBatch], at: int, bytes_at_once: int = 1 << 18):
    """Slices of about 256 KB of text (a longer text is a slice of its own)."""
    for whole in batches:
        texts, begin, size = whole.column(at).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= bytes_at_once or i == len(texts) - 1:
                yield whole.slice(begin, i + 1 - begin), texts[begin:i + 1]
                begin, size = i + 1, 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
        sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Learn from ``labels`` (key, label 0/1) of ``docs`` (key, text)."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("__y"))
    sizes = docs.select(key, F.octet_length(text).alias("__b")).join(marks.select(key), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__b").cast("double")).alias("b")).first()
    share = min(1.0, sample / max(1, sizes["n"]), sample_bytes / max(1.0, sizes["b"] or 0.0))
    draw = F.pmod(F.xxhash64(F.lit(5), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = docs.select(key, text).join(marks.where(draw < share), key).select(F.col(key), F.col(text), "__y")

    def run(batches):
        for part, texts in _slices(batches, 1):
            x, owner = passages(texts)
            out = []
            for b in range(len(texts)):
                own = x[owner == b] if len(texts) < 2 else x[np.searchsorted(owner, b):np.searchsorted(owner, b + 1)]
                out.append(own.astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()), part.column(2)], [key, "x", "y"])

    kind = docs.schema[key].dataType
    rows = drawn.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("x", T.BinaryType()),
                                               T.StructField("y", T.DoubleType())])).collect()
    rows.sort(key=lambda r: (r[key], bytes(r["x"])))
    bags = [np.frombuffer(bytes(r["x"]), "<f2").reshape(-1, SHARES + PAIRS) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, SHARES + PAIRS), "<f2")
    return train(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: AttentionModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``attended`` (index of the passage
    with the largest attention); the text only on request."""
    made = ("score", "attended")
    kept = [c for c in docs.columns if c not in made and (keep_text or c != text)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField("score", T.DoubleType()),
                           T.StructField("attended", T.IntegerType())])

    def run(batches):
        for part, texts in _slices(batches, len(kept)):
            x, owner = passages(texts)
            s, a = model.score(x, owner, len(texts))
            begin = np.searchsorted(owner, np.arange(len(texts)))
            end = np.r_[begin[1:], len(owner)]
            most = [int(np.argmax(a[b:e])) for b, e in zip(begin, end)]
            yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(s, pa.float64()), pa.array(most, pa.int32())],
                                             [*kept, *made])

    return source.mapInArrow(run, schema)
