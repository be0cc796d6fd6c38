"""Target-distribution importance resampling over hashed word n-grams.

Features are all runs of 1 to ``SPAN`` consecutive words, hashed by CRC-32
into buckets.  The log ratio of the target's and the corpus' smoothed bucket
counts is a bucket's gain; a document's weight is the sum of its features'
gains, and documents are drawn without replacement by weight plus Gumbel
noise that is a pure function of the id.

CRC-32 is linear but for a constant of the length: the register of a message
is the XOR of what each byte contributes, and a contribution depends on the
byte and its distance from the end alone.  Texts are brought to a form in
which words are separated by one space, so every feature is a span of bytes;
contributions come from a table (distance, byte) and ``bitwise_xor.reduceat``
folds them over the spans.  Spans over ``BLOCK`` bytes are cut into blocks
from their end, whose registers are folded pairwise, the earlier one advanced
over the later one's bytes.

Jobs: one pass counts buckets (each task sends at most one row a bucket), the
gains (one number a bucket, ``buckets`` bounds them) go to every task, a
second pass weighs.  The draw is a distributed sort: rows are range-partitioned
by score and their ranks are the ranks in the range plus the sizes of the
ranges before; no task sees all rows.  Texts over ``PART`` bytes are hashed a
part at a time.

Defined results: a null text has no words; a document without words has
weight 0 and is never drawn; a null id draws its noise from the seed and a
colon alone and comes last among ties; repeated rows are documents of their
own (equal rows have equal scores, which of them takes which rank is open);
columns other than id and text are not read; an empty table gives no rows,
an empty target counts nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlake.llm.common import parallelism, stage

BLOCK = 64            # distances the table holds
CHUNK = 1 << 14       # blocks whose bytes are expanded at a time
PART = 1 << 20        # bytes of texts hashed together
SPAN = 3
ONES = 0xFFFFFFFF

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEXT = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _positions() -> np.ndarray:
    """Contribution of a byte with so many bytes after it, row by row."""
    step = _byte_table()
    out = np.empty((BLOCK, 256), np.uint32)
    out[0] = step
    for d in range(1, BLOCK):
        out[d] = step[out[d - 1] & 255] ^ (out[d - 1] >> 8)
    return out


_POSITIONS = _positions().ravel()


class Advance:
    """Moves registers over 2^k zero bytes: four tables of 256 for each k."""

    def __init__(self):
        step, b = _byte_table(), np.arange(256, dtype=np.uint32)
        one = np.stack([step[(b << s) & 255] ^ ((b << s) >> 8) if s else step[b] for s in (0, 8, 16, 24)])
        self.tables = [one.astype(np.uint32)]

    def over(self, register: np.ndarray, k: int) -> np.ndarray:
        while len(self.tables) <= k:
            last = len(self.tables) - 1
            self.tables.append(np.stack([self.over(t, last) for t in self.tables[last]]))
        t = self.tables[k]
        return t[0][register & 255] ^ t[1][register >> 8 & 255] ^ t[2][register >> 16 & 255] ^ t[3][register >> 24]


_ADVANCE = Advance()


def _length_constants(most: int) -> np.ndarray:
    """CRC-32 of so many zero bytes."""
    step, out, register = _byte_table().tolist(), [0], ONES
    for _ in range(most):
        register = step[register & 255] ^ (register >> 8)
        out.append(register ^ ONES)
    return np.array(out, np.uint32)


_LENGTH = _length_constants(4096)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    out = _LENGTH[np.minimum(lengths, len(_LENGTH) - 1)]
    long = np.flatnonzero(lengths >= len(_LENGTH))
    if len(long):
        register, left, k = np.full(len(long), ONES, np.uint32), lengths[long].copy(), 0
        while left.any():
            odd = (left & 1).astype(bool)
            register[odd] = _ADVANCE.over(register[odd], k)
            left >>= 1
            k += 1
        out[long] = register ^ np.uint32(ONES)
    return out


def _block_registers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Registers (from zero) of spans of 1 to BLOCK bytes."""
    out = np.empty(len(start), np.uint32)
    for a in range(0, len(start), CHUNK):
        s, e = start[a:a + CHUNK], end[a:a + CHUNK]
        length = e - s
        first = np.cumsum(length) - length
        place = np.arange(int(length.sum())) + np.repeat(s - first, length)
        distance = np.repeat(e - 1, length) - place
        out[a:a + CHUNK] = np.bitwise_xor.reduceat(_POSITIONS[distance << 8 | data[place]], first)
    return out


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of at least one byte of ``data`` (uint8)."""
    if not len(start):
        return np.zeros(0, np.uint32)
    length = end - start
    n = -(-length // BLOCK)
    if n.max() == 1:
        return _block_registers(data, start, end) ^ length_constants(length)
    # blocks of each span, numbered from its end
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    upper = np.repeat(end, n) - number * BLOCK
    register = _block_registers(data, np.maximum(upper - BLOCK, np.repeat(start, n)), upper)
    k = BLOCK.bit_length() - 1
    while n.max() > 1:
        later = number & 1 == 1
        register[later] = _ADVANCE.over(register[later], k)
        pair = np.flatnonzero(~later)
        register, number, n, k = np.bitwise_xor.reduceat(register, pair), number[pair] >> 1, (n + 1) >> 1, k + 1
    return register ^ length_constants(length)


class Words:
    """Words of some texts, lower-cased, laid out with one space after each.
    ``own``: words of each text that count as starts of features (the others
    only end features that began before a cut)."""

    def __init__(self, raw: list[bytes], own: list[int | None]):
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        word = _WORD[data]
        after = np.r_[False, word[:-1] & ~word[1:]]
        kept = word | after
        self.data = np.where(after, np.uint8(32), _LOWER[data])[kept]
        stop = np.flatnonzero(after)
        at = np.cumsum(kept)[stop] - 1
        self.end = at.astype(np.int64)
        self.start = np.r_[0, self.end[:-1] + 1].astype(np.int64) if len(at) else self.end
        border = np.cumsum([len(r) + 1 for r in raw])
        self.last = np.searchsorted(stop, border)               # words up to the end of each text
        self.count = np.diff(self.last, prepend=0)
        self.own = np.array([c if o is None else o for o, c in zip(own, self.count.tolist())], np.int64)

    def features(self, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(CRC-32 of the runs of so many words, how many each text has)."""
        place = np.arange(len(self.end)) - np.repeat(self.last - self.count, self.count)
        for k in range(1, span + 1):
            begins = (place + k <= np.repeat(self.count, self.count)) & (place < np.repeat(self.own, self.count))
            i = np.flatnonzero(begins)
            have = np.minimum(self.own, np.maximum(self.count - k + 1, 0))
            yield crc32_spans(self.data, self.start[i], self.end[i + k - 1]), have


def cut(text: bytes, span: int = SPAN) -> Iterator[tuple[bytes, int | None]]:
    """Parts of a long text at word ends, each with the next words appended
    that features of its own words need, and the number of its own words."""
    if len(text) <= PART:
        yield text, None
        return
    a = 0
    while a < len(text):
        b = a + PART
        while b < len(text) and _WORD[text[b]]:
            b += 1
        own, near, at = text[a:b], [], b
        while len(near) < span - 1 and (m := _NEXT.search(text, at)):
            near.append(m.group())
            at = m.end()
        yield own + b"".join([b" " + w for w in near]), sum(1 for _ in _NEXT.finditer(own))
        a = b


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], Words]]:
    """Texts of a record batch in parts of about PART bytes: (row of each)."""
    rows, raw, own, held = [], [], [], 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        for part, count in cut((text or "").encode("utf-8")):
            if rows and held + len(part) > PART:
                yield rows, Words(raw, own)
                rows, raw, own, held = [], [], [], 0
            rows.append(row), raw.append(part), own.append(count)
            held += len(part)
    if rows:
        yield rows, Words(raw, own)


def bucket_counts(texts: DataFrame, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket int, n long) over all features of all texts; buckets without
    a feature are left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, words in _batches(batch, 0):
                for crc, _ in words.features(SPAN):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share))."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((source.get(b, 0) + 1) * (t_all + buckets))))
                     for b in range(buckets)], np.int64)


def noise(seed: int, key) -> int:
    """Gumbel noise in thousandths from the first 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row, all long."""
    buckets = np.uint32(len(gain))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            n_words, n_features, weight = (np.zeros(size, np.int64) for _ in range(3))
            for rows, words in _batches(batch, 1):
                np.add.at(n_words, rows, words.own)
                for crc, have in words.features(SPAN):
                    sums = np.r_[0, np.cumsum(gain[crc % buckets])]
                    last = np.cumsum(have)
                    np.add.at(n_features, rows, have)
                    np.add.at(weight, rows, sums[last] - sums[last - have])
            drawn = [noise(seed, k) for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight), pa.array(weight + np.array(drawn, np.int64))],
                [key, "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``rank`` by falling score, ties by rising ``key``: ranges
    of the order are ranked on their own and moved up by the rows before."""
    order = [F.desc("score"), F.asc_nulls_last(key)]
    n = max(parallelism(rows.sparkSession), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "n_features"))
    return (ranged.withColumn("__nth", nth).join(sizes.withColumn("__before", before), "__range")
            .withColumn("rank", F.col("__before") + F.col("__nth")).drop("__range", "__n", "__nth", "__before"))


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, least_words: int = 20,
             buckets: int = 10_000, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (key, n_words, n_features, weight, score,
    rank), all long.  Of the N rows with at least ``least_words`` words the
    floor(percent N / 100) with the highest scores have a rank (from 1)."""
    source = {r["bucket"]: r["n"] for r in bucket_counts(docs, buckets, text).collect()}
    wanted = {r["bucket"]: r["n"] for r in bucket_counts(target, buckets, target_text).collect()}
    weighed = stage(weigh(docs, gains(source, wanted, buckets), seed, key, text), "weights")
    able = F.col("n_words") >= least_words
    draw = percent * weighed.where(able).count() // 100
    rank = F.when(F.col("rank") <= draw, F.col("rank")).cast("long")
    return (ranked(weighed.where(able), key).withColumn("rank", rank)
            .unionByName(weighed.where(~able).withColumn("rank", F.lit(None).cast("long"))))
