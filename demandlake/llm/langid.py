"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its lower-cased byte n-grams (two to four
bytes, hashed to ``DIMS`` places; everything in ASCII that is no letter
counts as a space), normalised to length one.  Document frequencies come
from all learning rows.  Every language gets up to ``CENTROIDS`` centroids
(spherical k-means over a bounded sample of its rows); a text goes to the
language of the centroid with the largest cosine.  Each centroid has a
radius - a high quantile of the cosine distances of its own members, plus a
margin - and a text beyond the radius of its nearest centroid is rejected.

Frequencies are summed in each task before the shuffle (``DIMS`` rows a
task); k-means runs in one task a language on at most about ``sample`` rows;
scoring is a ``mapInArrow`` without a shuffle.

Defined results: a null text or one without any letter is ``und`` with score
0 and is rejected; so is every text when nothing could be learned.  Equal
cosines go to the smaller language name.  Rows with a null language or
without letters are not learned from.  Repeated rows count as often as they
occur.  Extra columns are kept; columns that clash with an output name are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 8192
CENTROIDS = 4
SAMPLE = 1500  # rows per language that k-means sees (expected number)
QUANTILE, MARGIN = 0.999, 0.05
UNDETERMINED = "und"

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MIX = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def term_counts(text: str) -> np.ndarray:
    """Counts of the hashed 2-, 3- and 4-byte grams of the normalised text."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    pair = b[:-1] << np.uint32(8) | b[1:]
    grams = [pair]
    if len(b) > 2:
        triple = pair[:-1] << np.uint32(8) | b[2:]
        grams.append(triple | np.uint32(1 << 24))
        if len(b) > 3:
            grams.append(triple[:-1] << np.uint32(8) | b[3:])
    places = np.concatenate(grams) * _MIX >> np.uint32(19)
    return np.bincount(places, minlength=DIMS)


def _rows(batches: Iterable[pa.RecordBatch], at: int, size: int = 512) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        for i in range(0, whole.num_rows, size):
            part = whole.slice(i, size)
            yield part, part.column(at).to_pylist()


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(number of documents holding each place, number of documents)."""
    def run(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for _, texts in _rows(batches, 0):
            for t in texts:
                if has_letter(t):
                    seen += term_counts(t) > 0
                    n += 1
        at = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(seen[at[:-1]], n), pa.int64())], ["at", "n"])

    sums = docs.select(text).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS, np.int64), 0
    for at, count in sums:  # at most DIMS + 1 rows
        if at < 0:
            n = count
        else:
            df[at] = count
    return df, n


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        counts = term_counts(t)
        at = np.flatnonzero(counts)
        v = (1.0 + np.log(counts[at])) * idf[at]
        norm = np.sqrt(v @ v)
        if norm > 0:
            out[i, at] = v / norm
    return out


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centroids of length one, radius of each).  Starts
    are spread out: each next start is the row furthest from those chosen."""
    mean = x.mean(0)
    starts = [int(np.argmax(x @ mean))]
    near = x @ x[starts[0]]
    while len(starts) < k and near.min() < 0.999:
        starts.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        for j in range(len(c)):
            if (own == j).any():
                s = x[own == j].sum(0)
                c[j] = s / max(np.sqrt(s @ s), 1e-12)
    sim = x @ c.T
    own = np.argmax(sim, 1)
    far = [1 - np.quantile(sim[own == j, j], 1 - QUANTILE) if (own == j).any() else 0.0 for j in range(len(c))]
    return c, np.minimum(1.0, np.asarray(far) + MARGIN)


@dataclass
class LanguageModel:
    languages: list[str]       # of each centroid, sorted
    centroids: np.ndarray      # (number, DIMS)
    radius: np.ndarray
    idf: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        sample: int = SAMPLE, centroids: int = CENTROIDS) -> LanguageModel:
    """Learn from (text, lang) rows.  ``sample``: expected rows per language
    that k-means sees, drawn by a hash of ``key``; frequencies use all rows."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang, key)
    df, n = document_frequencies(known, text)
    idf = (np.log((1.0 + n) / (1.0 + df)) + 1.0).astype(np.float32)
    draw = F.pmod(F.xxhash64(F.lit(9), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shares = [x for r in known.groupBy(lang).count().collect() for x in (F.lit(r[0]), F.lit(min(1.0, sample / r[1])))]
    # the shares (a number per language) are literals: rows not drawn never leave their task
    drawn = known.where(draw < F.element_at(F.create_map(*shares), F.col(lang))).select(lang, text) if shares else known.select(lang, text)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t for t in pdf[text] if has_letter(t)]
        if not texts:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        c, r = cluster(vectors(sorted(texts), idf), centroids)
        return pd.DataFrame({"lang": pdf[lang].iloc[0], "centroid": [x.astype("<f4").tobytes() for x in c], "radius": r})

    rows = sorted(drawn.groupBy(lang).applyInPandas(centres, "lang string, centroid binary, radius double").collect(),
                  key=lambda r: (r["lang"], bytes(r["centroid"])))
    c = np.array([np.frombuffer(bytes(r["centroid"]), "<f4") for r in rows], np.float32).reshape(-1, DIMS)
    return LanguageModel([r["lang"] for r in rows], c, np.array([r["radius"] for r in rows]), idf)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``nearest`` (language of the nearest
    centroid), ``score`` (its cosine, 0 to 1), ``rejected`` and ``language``
    (``nearest``, or ``und`` where rejected)."""
    made = ("nearest", "score", "rejected", "language")
    kept = [c for c in docs.columns if c != text and c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField("nearest", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
                           T.StructField("language", T.StringType())])

    def run(batches):
        for part, texts in _rows(batches, len(kept)):
            usable = [i for i, t in enumerate(texts) if len(model.languages) and has_letter(t)]
            name, score, out = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if usable:
                sim = vectors([texts[i] for i in usable], model.idf) @ model.centroids.T
                best = np.argmax(sim, 1)
                for i, j, s in zip(usable, best, sim[np.arange(len(best)), best]):
                    name[i], score[i] = model.languages[j], float(min(1.0, max(0.0, s)))
                    out[i] = bool(1.0 - s > model.radius[j])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(kept)], pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_()),
                 pa.array([UNDETERMINED if r else s for s, r in zip(name, out)], pa.string())], [*kept, *made])

    return source.mapInArrow(run, schema)
