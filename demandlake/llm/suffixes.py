"""Exact removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if it lies in a string of ``LENGTH`` (50) bytes that also starts
in a document with a smaller id.  Strings are judged on the input.

Which suffixes are sorted.  In every window of 50 bytes the 24-byte gram with
the smallest hash of its head (leftmost on ties) is the window's anchor;
equal windows have equal anchors at equal places, so only suffixes that start
at anchors need sorting (1 in 14).  Neighbouring windows with one anchor form
an entry: the suffix from the anchor to the end of the last window, followed
by the bytes from the anchor back to the start of the first.  Equal entries
have equal windows throughout.  Entries whose gram occurs in one document
only can match nothing; a first exchange of 40-bit gram hashes, sorted and
delta-coded, drops them (a hash collision only keeps an entry too many).

Merge sort.  Documents are dealt into runs of about ``RUN_BYTES``.  Each run
sorts its entries, keeps the smallest document of equal ones, front-codes
them (length of the prefix shared with the entry before, then the rest) and
cuts them at sampled splitters, which are whole entries: a suffix that many
documents share is cut by what lies before it.  Each range of the order merges its pieces
with a loser tree in which every contestant knows its common prefix with the
last winner: a longer known prefix wins without a look at the bytes, equal
ones compare only behind it.  Common prefixes of the output come for free:
equal entries give the smallest document of each; neighbours that share the
gram tell which entries meet a different context somewhere.  The single
windows of those - as far to the right as the longest prefix shared with a
neighbour allows - go through the same sort, coding and merge once more, which
decides them one by one.

Bounds: a run, a range or a bucket of hashes is one task's work; all three
grow in number with the input, not in size.  A passage in a third of all
documents is one entry a run.  Texts travel twice, compressed, by run.

Defined results: null and empty texts have no bytes; a text under 50 bytes
loses nothing; rows that repeat id and text are one document each time
listed; documents with the same id never remove each other's bytes; a row
with a null id takes no part and keeps its bytes; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import discard, parallelism, stage
from demandlake.llm.words import mix

LENGTH, GRAM = 50, 24
REACH = LENGTH - GRAM               # an anchor starts at most this far behind its window's start
ENTRY = LENGTH + REACH + 2          # suffix, bytes before it (backwards), both lengths + 1
WINDOW = LENGTH + 1                 # window, then a 1 (numpy drops trailing zero bytes of strings)
RUN_BYTES, RANGE_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20, 24 << 20  # of text
CHUNK_BYTES = 8 << 20
SLICE = 1 << 16                    # entries whose windows are expanded at once
SAMPLE_BYTES = 6 << 20              # of text, from which splitters are drawn
SLAB = 1 << 22
WHOLE = 255


def _zip(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# ---------------------------------------------------------------- anchors

def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window start, last window start, 40-bit gram hash)."""
    parts = [_anchors(data[i:i + SLAB + LENGTH - 1], i) for i in range(0, max(1, len(data) - LENGTH + 1), SLAB)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _anchors(data: bytes, at: int):
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))).view("<u8").ravel()
    grams = n - GRAM + 1
    key = words[:grams] * np.uint64(0x9E3779B97F4A7C15)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(grams, dtype=np.uint64)
    span, width = 1, REACH + 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[:len(key) - (width - span)], key[width - span:])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1]
    last = np.r_[first[1:] - 1, len(place) - 1]
    a = place[first]
    h = mix(words[a] + mix(words[a + 8] + mix(words[a + 16] + np.uint64(1)))) >> np.uint64(24)
    return a + at, first + at, last + at, h


def entry_bytes(data: bytes, a: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The (n, ENTRY) matrix of entries."""
    out = np.zeros((len(a), ENTRY), np.uint8)
    padded = np.frombuffer(bytes(REACH) + data + bytes(LENGTH), np.uint8)
    right, left = e + LENGTH - a, a - s
    column = np.arange(LENGTH)
    out[:, :LENGTH] = np.where(column < right[:, None], padded[REACH + a[:, None] + column], 0)
    column = np.arange(REACH)
    out[:, LENGTH:LENGTH + REACH] = np.where(column < left[:, None], padded[REACH - 1 + a[:, None] - column], 0)
    out[:, -2], out[:, -1] = right + 1, left + 1
    return out


# ---------------------------------------------------------------- sorted runs

def sort_unique(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct rows, for each the first input row, for each input
    row its place among the distinct).  Rows end in a nonzero byte."""
    names = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(names, kind="stable")
    names = names[order]
    new = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return rows[order[new]], order[new], place


def front_code(rows: np.ndarray) -> bytes:
    """Sorted distinct rows: the common prefix lengths, then the rests."""
    shared = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        shared[1:] = np.argmax(rows[1:] != rows[:-1], axis=1)
    rest = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    return _zip(shared.tobytes() + rest.tobytes(), 9)


def front_decode(coded: bytes, n: int, width: int) -> tuple[list[int], list[bytes]]:
    data = _unzip(coded)
    shared, keys, at, key = list(data[:n]), [], n, b""
    for length in shared:
        end = at + width - length
        key = key[:length] + data[at:end]
        keys.append(key)
        at = end
    return shared, keys


def cut(rows: np.ndarray, splitters: list[bytes]) -> np.ndarray:
    """Where each range of the order begins and ends among sorted rows."""
    if not splitters or not len(rows):
        return np.r_[0, np.full(len(splitters), len(rows)), len(rows)]
    names = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    return np.r_[0, np.searchsorted(names, np.array(splitters, dtype=names.dtype)), len(rows)]


def merge(runs: list[tuple[list[int], list[bytes]]], width: int) -> Iterator[tuple[int, int, int]]:
    """(run, position, common prefix with the output before) in key order.

    A loser tree over sorted runs with known neighbour prefixes.  ``known[r]``
    is the common prefix of run r's head with the last output; of two heads
    the one with the longer prefix is smaller; only at equal prefixes are
    bytes compared, from there on, and the loser keeps its prefix with the
    winner."""
    k = 1
    while k < len(runs):
        k *= 2
    shared = [r[0] for r in runs] + [[]] * (k - len(runs))
    keys = [r[1] for r in runs] + [[]] * (k - len(runs))
    size = [len(x) for x in keys]
    at = [0] * k
    known = [0 if n else -1 for n in size]     # -1: the run is used up
    head = [x[0] if x else b"" for x in keys]
    number = int.from_bytes

    def beats(a: int, b: int) -> bool:
        """Does run a's head come before run b's?  Sets the loser's prefix."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return ka > kb
        if ka < 0:
            return a < b
        x, y = number(head[a][ka:], "big"), number(head[b][ka:], "big")
        if x == y:
            known[max(a, b)] = width
            return a < b
        common = width - ((x ^ y).bit_length() + 7) // 8
        known[b if x < y else a] = common
        return x < y

    tree = [0] * k
    best = list(range(k))
    while len(best) > 1:
        half = len(best) // 2
        winners = []
        for i in range(half):
            a, b = best[2 * i], best[2 * i + 1]
            if beats(a, b):
                winners.append(a)
                tree[half + i] = b
            else:
                winners.append(b)
                tree[half + i] = a
        best = winners
    top = best[0]
    while known[top] >= 0:
        p = at[top]
        yield top, p, known[top]
        p += 1
        at[top] = p
        if p < size[top]:
            head[top] = keys[top][p]
            known[top] = shared[top][p]
        else:
            known[top] = -1
        node = (top + k) >> 1
        while node:
            other = tree[node]
            ka, kb = known[top], known[other]
            if ka < kb or (ka == kb and not beats(top, other)):
                tree[node] = top
                top = other
            node >>= 1


# ---------------------------------------------------------------- first exchange: gram hashes

def _batches(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list]]:
    """(ids, texts as bytes) of about ``limit`` bytes, over batch borders."""
    ids, texts, size = [], [], 0
    for whole in batches:
        for batch in (whole.slice(at, 128) for at in range(0, whole.num_rows, 128)):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "replace"))
                size += len(texts[-1])
                if size >= limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _run_of(ids, runs: int) -> np.ndarray:
    return (mix(np.asarray(ids, np.int64).view(np.uint64)) % np.uint64(runs)).astype(np.int64)


def _tag_type(runs: int) -> str:
    """Smallest integer type for 2 * run + 1."""
    return next(t for t, limit in (("<u1", 1 << 8), ("<u2", 1 << 16), ("<u4", 1 << 32), ("<u8", 1 << 64)) if 2 * runs <= limit)


def _hash_rows(runs: int, buckets: int):
    def rows(batches):
        for ids, texts in _batches(batches, CHUNK_BYTES):
            run = _run_of(ids, runs)
            own = [np.unique(anchors(t)[3]) for t in texts]
            h = np.concatenate(own)
            r = np.repeat(run, [len(x) for x in own])
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
            several = np.diff(np.r_[np.flatnonzero(new), len(h)]) > 1
            h, r = h[new], r[new]
            edges = np.searchsorted(h, [(b << 40) // buckets for b in range(buckets)] + [1 << 40])
            out = {"bucket": [], "n": [], "hashes": [], "runs": []}
            for b in range(buckets):
                lo, hi = edges[b], edges[b + 1]
                if hi > lo:
                    out["bucket"].append(b)
                    out["n"].append(int(hi - lo))
                    step = np.diff(np.r_[np.uint64(0), h[lo:hi]])
                    # byte by byte: the high bytes of the steps are mostly zero
                    planes = np.ascontiguousarray(step.astype("<u8")[:, None].view(np.uint8)[:, :5].T)
                    out["hashes"].append(_zip(planes.tobytes()))
                    out["runs"].append(_zip((r[lo:hi] * 2 + several[lo:hi]).astype(_tag_type(runs)).tobytes()))
            if out["bucket"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                    [("bucket", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("runs", pa.binary())]))
    return rows


def _shared_grams(runs: int):
    """Of one bucket: for each run, the hashes that two documents share."""
    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        h, r = [], []
        for n, hashes, tags in zip(pdf["n"], pdf["hashes"], pdf["runs"]):
            five = np.zeros((n, 8), np.uint8)
            five[:, :5] = np.frombuffer(_unzip(hashes), np.uint8).reshape(5, n).T
            h.append(np.cumsum(five.view("<u8").ravel(), dtype=np.uint64))
            r.append(np.frombuffer(_unzip(tags), _tag_type(runs)).astype(np.int64))
        h, r = np.concatenate(h), np.concatenate(r)
        order = np.argsort(h, kind="stable")
        h, r = h[order], r[order]
        new = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(new) - 1
        count = np.bincount(group, weights=1 + (r & 1))
        kept = count[group] > 1
        h, r = h[kept], r[kept] >> 1
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
        which, first = np.unique(r, return_index=True)
        parts = np.split(h, first[1:])
        return pd.DataFrame({"run": which.astype(np.int64), "kind": "grams",
                             "data": [_zip(np.unique(p).astype("<u8").tobytes()) for p in parts] if len(which) else []})
    return shared


# ---------------------------------------------------------------- texts by run

def _text_rows(runs: int):
    def rows(batches):
        for ids, texts in _batches(batches, CHUNK_BYTES):
            run = _run_of(ids, runs)
            order = np.argsort(run, kind="stable")
            which, first = np.unique(run[order], return_index=True)
            out = {"run": [], "ids": [], "sizes": [], "texts": []}
            for r, part in zip(which, np.split(order, first[1:])):
                out["run"].append(int(r))
                out["ids"].append(np.array([ids[i] for i in part], "<i8").tobytes())
                out["sizes"].append(np.array([len(texts[i]) for i in part], "<i8").tobytes())
                out["texts"].append(_zip(b"".join([texts[i] for i in part]), 6))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("run", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary())]))
    return rows


def _load_run(pdf: pd.DataFrame) -> tuple[list[tuple[int, bytes]], list[int]]:
    """(distinct (id, text) in order, how often each occurs)."""
    docs: dict[tuple[int, bytes], int] = {}
    for ids, sizes, texts in zip(pdf["ids"], pdf["sizes"], pdf["texts"]):
        data, at = _unzip(texts), 0
        for i, n in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist()):
            key = (i, data[at:at + n])
            docs[key] = docs.get(key, 0) + 1
            at += n
    order = sorted(docs)
    return order, [docs[d] for d in order]


# ---------------------------------------------------------------- runs

RUN_OUT = "kind string, run long, part int, n int, data binary, docs binary, place binary"


def _row(kind, run=-1, part=-1, n=0, data=b"", docs=b"", place=b""):
    return {"kind": kind, "run": int(run), "part": int(part), "n": int(n), "data": data, "docs": docs, "place": place}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "run", "part", "n", "data", "docs", "place"]).astype(
        {"run": "int64", "part": "int32", "n": "int32"})


def _sorted_run(splitters: list[bytes]):
    """Texts and shared grams of a run -> its anchors and its sorted pieces."""
    def build(texts: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        if not len(texts) or not len(grams):
            return _frame([])
        run = int(texts["run"].iloc[0])
        docs, _ = _load_run(texts)
        shared = np.sort(np.concatenate([np.frombuffer(_unzip(g), "<u8") for g in grams["data"]]))
        rows, spots = [], []
        for nth, (_, data) in enumerate(docs):
            a, s, e, h = anchors(data)
            at = np.searchsorted(shared, h)
            ok = shared[np.minimum(at, len(shared) - 1)] == h
            if ok.any():
                a, s, e = a[ok], s[ok], e[ok]
                rows.append(entry_bytes(data, a, s, e))
                spots.append(np.stack([np.full(len(a), nth), a, a - s, e - s]))
        if not rows:
            return _frame([])
        ids = np.array([d[0] for d in docs], np.int64)
        spots = np.concatenate(spots, 1)
        entries, first, place = sort_unique(np.concatenate(rows))
        owner = ids[spots[0][first]]
        later = ids[spots[0]] > owner[place]      # a smaller document of this run has the entry
        out = [_row("anchors", run, n=spots.shape[1], data=_zip(np.concatenate(
            [spots[0], spots[1], spots[2], spots[3], place, later.astype(np.int64)]).astype("<u4").tobytes()))]
        edges = cut(entries, splitters)
        for part in range(len(splitters) + 1):
            lo, hi = edges[part], edges[part + 1]
            if hi > lo:
                out.append(_row("entries", run, part, hi - lo, front_code(entries[lo:hi]), _zip(owner[lo:hi].astype("<i8").tobytes()),
                                np.array([lo], "<i8").tobytes()))
        return _frame(out)
    return build


# ---------------------------------------------------------------- ranges

def _results(run: np.ndarray, entry: np.ndarray, offset: np.ndarray) -> list[dict]:
    order = np.argsort(run, kind="stable")
    run, entry, offset = run[order], entry[order], offset[order]
    which, first = np.unique(run, return_index=True)
    ends = np.r_[first[1:], len(run)]
    return [_row("known", r, n=hi - lo, data=_zip(entry[lo:hi].astype("<u4").tobytes() + offset[lo:hi].astype(np.uint8).tobytes()))
            for r, lo, hi in zip(which, first, ends)]


def _merge_entries(splitters: list[bytes]):
    """One range of the entry order: later documents of equal entries are
    known to repeat; contexts that differ go on as single windows."""
    def run_range(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = pdf["run"].tolist()
        docs = [np.frombuffer(_unzip(d), "<i8").tolist() for d in pdf["docs"]]
        base = [int(np.frombuffer(p, "<i8")[0]) for p in pdf["place"]]
        pieces = [front_decode(d, n, ENTRY) for d, n in zip(pdf["data"], pdf["n"])]
        out_run, out_entry = [], []
        heads: list[tuple[int, int]] = []   # (piece, position) of the smallest document of each distinct entry
        prefix: list[int] = []
        least = 0
        for piece, at, known in merge(pieces, ENTRY):
            doc = docs[piece][at]
            if known < ENTRY or not heads:
                heads.append((piece, at))
                prefix.append(known)
                least = doc
            elif doc < least:
                p, q = heads[-1]
                out_run.append(runs[p])
                out_entry.append(base[p] + q)
                heads[-1] = (piece, at)
                least = doc
            elif doc > least:
                out_run.append(runs[piece])
                out_entry.append(base[piece] + at)
        prefix[0] = LENGTH                       # what lies before and behind the range is not known here
        reach = np.minimum(np.maximum(prefix, prefix[1:] + [LENGTH]), LENGTH)
        varied = np.flatnonzero(reach >= GRAM)
        known_run, known_entry = [np.array(out_run, np.int64)], [np.array(out_entry, np.int64)]
        known_offset = [np.full(len(out_run), WHOLE)]
        out = []
        for some in (varied[i:i + SLICE] for i in range(0, len(varied), SLICE)):
            p = np.array([heads[i] for i in some])
            doc = np.array([docs[a][b] for a, b in p.tolist()], np.int64)
            order = np.argsort(doc, kind="stable")
            p, doc, far = p[order], doc[order], reach[some][order]
            rows = np.frombuffer(b"".join([pieces[a][1][b] for a, b in p.tolist()]), np.uint8).reshape(-1, ENTRY)
            where_run = np.array(runs, np.int64)[p[:, 0]]
            where_entry = np.array(base, np.int64)[p[:, 0]] + p[:, 1]
            right, left = rows[:, -2].astype(np.int64) - 1, rows[:, -1].astype(np.int64) - 1
            low = LENGTH - np.minimum(right, far)
            count = np.maximum(left - low + 1, 0)
            own = np.repeat(np.arange(len(rows)), count)
            offset = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            windows = np.ones((len(own), WINDOW), np.uint8)
            column = np.arange(LENGTH)
            for i in range(0, len(own), 1 << 16):
                o = offset[i:i + (1 << 16), None]
                take = np.where(column < o, LENGTH + o - 1 - column, column - o)
                windows[i:i + (1 << 16), :LENGTH] = rows[own[i:i + (1 << 16), None], take]
            distinct, first, place = sort_unique(windows)
            smallest = doc[own[first]]
            later = doc[own] > smallest[place]
            known_run.append(where_run[own[later]])
            known_entry.append(where_entry[own[later]])
            known_offset.append(offset[later])
            # the others share the fate of the window that is sent on
            mine = np.flatnonzero(~later)
            mine = mine[np.argsort(place[mine], kind="stable")]
            starts = np.r_[np.searchsorted(place[mine], np.arange(len(distinct))), len(mine)]
            edges = cut(distinct, splitters)
            for part in range(len(splitters) + 1):
                lo, hi = edges[part], edges[part + 1]
                if hi > lo:
                    them = mine[starts[lo]:starts[hi]]
                    address = (np.diff(starts[lo:hi + 1]).astype("<u4").tobytes() + where_entry[own[them]].astype("<u4").tobytes()
                               + where_run[own[them]].astype("<u4").tobytes() + offset[them].astype(np.uint8).tobytes())
                    out.append(_row("windows", -1, part, hi - lo, front_code(distinct[lo:hi]),
                                    _zip(smallest[lo:hi].astype("<i8").tobytes()), _zip(address)))
        return _frame(out + _results(np.concatenate(known_run), np.concatenate(known_entry), np.concatenate(known_offset)))
    return run_range


def _merge_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range of the window order: windows of later documents repeat."""
    docs = [np.frombuffer(_unzip(d), "<i8").tolist() for d in pdf["docs"]]
    pieces = [front_decode(d, n, WINDOW) for d, n in zip(pdf["data"], pdf["n"])]
    found = [[] for _ in pieces]
    group: list[tuple[int, int, int]] = []

    def close():
        if len(group) > 1:
            least = min(group)[0]
            for doc, piece, at in group:
                if doc > least:
                    found[piece].append(at)

    for piece, at, known in merge(pieces, WINDOW):
        if known < WINDOW:
            close()
            group = []
        group.append((docs[piece][at], piece, at))
    close()
    run, entry, offset = [], [], []
    for n, address, hits in zip(pdf["n"], pdf["place"], found):
        if not hits:
            continue
        data = _unzip(address)
        count = np.frombuffer(data[:4 * n], "<u4").astype(np.int64)
        total = int(count.sum())
        e = np.frombuffer(data[4 * n:4 * (n + total)], "<u4")
        r = np.frombuffer(data[4 * (n + total):4 * (n + 2 * total)], "<u4")
        o = np.frombuffer(data[4 * (n + 2 * total):], np.uint8)
        hit = np.zeros(n, bool)
        hit[hits] = True
        mask = np.repeat(hit, count)
        run.append(r[mask].astype(np.int64))
        entry.append(e[mask].astype(np.int64))
        offset.append(o[mask].astype(np.int64))
    if not run:
        return _frame([])
    return _frame(_results(np.concatenate(run), np.concatenate(entry), np.concatenate(offset)))


# ---------------------------------------------------------------- removal

OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(texts: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """Texts of a run and what is known of its anchors -> the bytes that stay."""
    if not len(texts):
        return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])
    docs, times = _load_run(texts)
    doc = start = end = np.zeros(0, np.int64)
    own = marks[marks["kind"] == "anchors"]
    if len(own):
        n = int(own["n"].iloc[0])
        nth, a, left, more, entry, later = np.frombuffer(_unzip(own["data"].iloc[0]), "<u4").astype(np.int64).reshape(6, n)
        whole = np.zeros(int(entry.max()) + 1, bool)
        entries, offsets = [], []
        for data, count in zip(marks["data"][marks["kind"] == "known"], marks["n"][marks["kind"] == "known"]):
            data = _unzip(data)
            e, o = np.frombuffer(data[:4 * count], "<u4").astype(np.int64), np.frombuffer(data[4 * count:], np.uint8).astype(np.int64)
            whole[e[o == WHOLE]] = True
            entries.append(e[o != WHOLE])
            offsets.append(o[o != WHOLE])
        full = (later == 1) | whole[entry]
        doc, start, end = nth[full], (a - left)[full], (a - left + more)[full] + LENGTH
        if entries:
            e, o = np.concatenate(entries), np.concatenate(offsets)
            order = np.argsort(e, kind="stable")
            e, o = e[order], o[order]
            rest = np.flatnonzero(~full)
            lo, hi = np.searchsorted(e, entry[rest]), np.searchsorted(e, entry[rest], "right")
            which = np.repeat(rest, hi - lo)
            take = np.repeat(lo, hi - lo) + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            begin = a[which] - o[take]
            doc, start, end = np.r_[doc, nth[which]], np.r_[start, begin], np.r_[end, begin + LENGTH]
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
    edge = np.searchsorted(doc, np.arange(len(docs) + 1))
    out = []
    for i, ((name, data), often) in enumerate(zip(docs, times)):
        lo, hi = edge[i], edge[i + 1]
        spans, kept = [], data
        if hi > lo:
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, start[lo:hi], 1)
            np.add.at(depth, end[lo:hi], -1)
            gone = np.cumsum(depth[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            spans = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2])]
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.extend([(name, len(data), len(data) - len(kept), spans, kept)] * often)
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


# ---------------------------------------------------------------- the job

def _splitters(docs: DataFrame, total: int, ranges: int) -> tuple[list[bytes], list[bytes]]:
    """Cuts of the entry order and of the window order from a sample of about
    ``SAMPLE_BYTES`` of text, drawn by a hash of the id."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))

    def draw(batches):
        for _, texts in _batches(batches, CHUNK_BYTES):
            out = {"entry": [], "window": []}
            for t in texts:
                a, s, e, h = anchors(t)
                # by a hash of the whole entry: one gram in many contexts is drawn as often as its entries are
                entry = entry_bytes(t, a, s, e)
                wide = np.zeros((len(entry), -(-ENTRY // 8) * 8), np.uint8)
                wide[:, :ENTRY] = entry
                for word in wide.view(np.uint64).T:
                    h = mix(h + word)
                some = np.flatnonzero(h % np.uint64(16) == 0)
                out["entry"] += [x.tobytes() for x in entry[some]]
                out["window"] += [t[y:y + LENGTH] for y in s[some].tolist()]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("entry", pa.binary()), ("window", pa.binary())]))

    drawn = docs.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    rows = drawn.mapInArrow(draw, "entry binary, window binary").collect()

    def cuts(keys: list[bytes]) -> list[bytes]:
        keys = sorted(keys)
        found = [keys[len(keys) * i // ranges].rstrip(b"\0") for i in range(1, ranges)] if keys else []
        return sorted({x for x in found if x})

    return cuts([bytes(r["entry"]) for r in rows]), cuts([bytes(r["window"]) for r in rows])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans``
    (removed byte ranges, end exclusive) and ``kept`` (the other bytes)."""
    spark = docs.sparkSession
    every = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    named = every.where("id is not null")
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = lambda size: max(1, math.ceil(total / size))
    runs, buckets = count(RUN_BYTES), max(count(BUCKET_BYTES), min(parallelism(spark), count(1 << 20)))
    entry_cuts, window_cuts = _splitters(named, total, max(count(RANGE_BYTES), min(parallelism(spark), count(1 << 20))))

    texts = named.mapInArrow(_text_rows(runs), "run long, ids binary, sizes binary, texts binary")
    hashes = named.mapInArrow(_hash_rows(runs, buckets), "bucket int, n int, hashes binary, runs binary")
    grams = hashes.groupBy("bucket").applyInPandas(_shared_grams(runs), "run long, kind string, data binary")
    sorted_runs = stage(texts.groupBy("run").cogroup(grams.groupBy("run")).applyInPandas(_sorted_run(entry_cuts), RUN_OUT), "suffix-runs")
    spots = stage(sorted_runs.where("kind = 'anchors'"), "suffix-anchors")
    merged = stage(sorted_runs.where("kind = 'entries'").groupBy("part").applyInPandas(_merge_entries(window_cuts), RUN_OUT), "suffix-ranges")
    discard(sorted_runs)
    known = stage(merged.where("kind = 'known'"), "suffix-known")
    decided = stage(merged.where("kind = 'windows'").groupBy("part").applyInPandas(_merge_windows, RUN_OUT), "suffix-windows")
    discard(merged)
    marks = spots.union(known).union(decided).select("run", "kind", "n", "data")
    out = texts.groupBy("run").cogroup(marks.groupBy("run")).applyInPandas(_remove, OUT)
    bare: Column = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    nameless = every.where("id is null").select(
        F.col("id").alias("doc_id"), F.octet_length(bare).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), bare.alias("kept"))
    return out.union(nameless)
