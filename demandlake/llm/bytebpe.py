"""Byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression.  Every code point gets a class
from a table (letter, number, white space, other); with one code point of
look-ahead the class becomes the letter of an automaton whose state says what
the token under way is.  A letter is a transition function on the states;
functions compose associatively, and all their compositions form a small
monoid with a multiplication table.  The state before every code point is
therefore a prefix scan over that monoid: the text is laid out in columns,
all columns are scanned together, and the columns' products are scanned in
turn.  A token starts where (state, letter) says so.

The slices feed merging: a slice seen before is a lookup in a bounded
per-worker memory that starts with all whole tokens; the others of a batch
are merged together (``merging``).  Every token's end offset in the text's
bytes is kept, and decoding writes each token's bytes to its place by those
offsets.

The tables of letters, numbers and white space are asked from the tokenizer
library once a worker, so they follow its Unicode version.

Rows run through ``mapInArrow``: no shuffle, one part of a record batch in
memory, long texts scanned ``CHUNK`` code points at a time.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes; repeated rows each give their row; extra columns are
kept, columns that clash with an output name are replaced; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.llm.merging import PairTable, packed_rows

# the split that the automaton below carries out (a fixed value)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEMORY = 200_000     # slices remembered per worker, in each of two generations
KEPT = 64            # longer slices are not remembered
CHUNK = 1 << 20      # code points scanned at a time
BATCH = 1 << 20      # code points of texts encoded together

# states: kind of the token under way
LETTERS, NUMBERS, OTHERS, LEAD, BLANKS, ENDED, SHORT1, SHORT2 = range(8)
STATES = 8
# letters of the automaton: letter, number, other, apostrophe with one or two
# letters of a contraction after it, blank that goes on, last blank before a
# token (a space joins that token, any other blank stands alone), text border
A_L, A_N, A_O, A_C1, A_C2, A_BLANK, A_LAST, A_LEAD, A_BORDER = range(9)


def _step(state: int, letter: int) -> tuple[int, bool]:
    """(state after, does a token start here)."""
    if letter == A_L and state in (SHORT1, SHORT2):
        return (ENDED if state == SHORT1 else SHORT1), False
    for own, run in ((A_L, LETTERS), (A_N, NUMBERS), (A_O, OTHERS), (A_BLANK, BLANKS)):
        if letter == own:
            return run, not (state == run or (state == LEAD and run != BLANKS))
    if letter in (A_C1, A_C2):
        if state in (OTHERS, LEAD):
            return OTHERS, False
        return (SHORT1 if letter == A_C1 else SHORT2), True
    return (LEAD if letter == A_LEAD else ENDED), True


class Automaton:
    """Transition monoid: ``apply[f, s]`` is the state after, ``times[f, g]``
    the number of "f, then g", ``starts[s, letter]`` the token starts."""

    def __init__(self):
        letters = range(A_BORDER + 1)
        identity = tuple(range(STATES))
        functions = [identity] + [tuple(_step(s, a)[0] for s in range(STATES)) for a in letters]
        number = {}
        for f in functions:
            number.setdefault(f, len(number))
        self.letter = np.array([number[f] for f in functions[1:]], np.int64)
        found = list(number)
        for f in found:                       # grows while it is walked
            for g in functions:
                h = tuple(g[s] for s in f)
                if h not in number:
                    number[h] = len(number)
                    found.append(h)
        self.size = len(found)
        self.apply = np.array(found, np.int64)
        self.times = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.int64).ravel()
        self.starts = np.array([[_step(s, a)[1] for a in letters] for s in range(STATES)]).ravel()

    def before(self, f: np.ndarray, width: int = 256) -> tuple[np.ndarray, int]:
        """Exclusive prefix products of ``f`` (numbers of functions), and the
        product of all."""
        if len(f) <= width:
            out = np.empty(len(f), np.int64)
            held = 0                           # the identity
            for i, x in enumerate(f.tolist()):
                out[i] = held
                held = int(self.times[held * self.size + x])
            return out, held
        columns = -(-len(f) // width)
        laid = np.zeros(columns * width, np.int64)
        laid[:len(f)] = f
        laid = np.ascontiguousarray(laid.reshape(columns, width).T)
        held = np.zeros(columns, np.int64)
        out = np.empty_like(laid)
        for i in range(width):
            out[i] = held
            held = self.times[held * self.size + laid[i]]
        ahead, total = self.before(held, width)
        out = self.times[ahead[None, :] * self.size + out]
        return out.T.ravel()[:len(f)], total


def _classes() -> np.ndarray:
    """Class of every code point as the tokenizer library sees it."""
    points = np.arange(0x110000, dtype="<u4")
    points = points[(points < 0xD800) | (points > 0xDFFF)]
    text = points.tobytes().decode("utf-32-le")
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, A_O, np.uint8)
    for pattern, kind in ((r"\p{L}", A_L), (r"\p{N}", A_N), (r"\s", A_BLANK)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        matched = bytes(probe.encode_ordinary(text)).decode("utf-8")
        table[np.frombuffer(matched.encode("utf-32-le"), "<u4")] = kind
    return table


class ByteVocabulary:
    def __init__(self, ranks_file: str):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks = ranks
        left, right, both = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), both.append(rank)
        self.pairs = PairTable(left, right, both, both)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        surface = [b""] * size
        for token, rank in ranks.items():
            surface[rank] = token
        self.length = np.array([len(t) for t in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.whole = {}
        for token, rank in ranks.items():
            try:
                self.whole[token.decode("utf-8")] = np.array([rank], "<u4").tobytes()
            except UnicodeDecodeError:
                continue
        self.known, self.older = dict(self.whole), {}
        self.classes, self.automaton = _classes(), Automaton()

    def letters(self, codes: np.ndarray, ahead: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Letters of the automaton for ``codes``; ``ahead``: up to two code
        points that follow; ``border``: numbers of the codes that stand
        between texts (they may lie in ``ahead``)."""
        n = len(codes)
        wide = np.concatenate([codes, ahead, np.zeros(2, codes.dtype)])
        kind = self.classes[wide]
        kind[n + len(ahead):] = A_BORDER
        kind[border] = A_BORDER
        out = kind[:n].copy()
        last = (kind[:n] == A_BLANK) & (kind[1:n + 1] <= A_O)
        out[last] = np.where(codes[last] == 32, A_LEAD, A_LAST)
        mark = np.flatnonzero((codes == 39) & (out == A_O))
        one, two = wide[mark + 1], wide[mark + 2]
        out[mark[np.isin(one, [ord(c) for c in "stmd"])]] = A_C1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[mark[pair]] = A_C2
        return out

    def token_starts(self, codes: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Where tokens start in ``codes`` (borders count as tokens)."""
        auto, state, found = self.automaton, ENDED, []
        for a in range(0, len(codes), CHUNK):
            part = codes[a:a + CHUNK]
            near = border[np.searchsorted(border, a):np.searchsorted(border, a + len(part) + 2)] - a
            letters = self.letters(part, codes[a + len(part):a + len(part) + 2], near)
            prefix, total = auto.before(auto.letter[letters])
            found.append(a + np.flatnonzero(auto.starts[auto.apply[prefix, state] * (A_BORDER + 1) + letters]))
            state = int(auto.apply[total, state])
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def merge(self, slices: list[str]) -> dict[str, bytes]:
        """Packed ids of slices that are not whole tokens."""
        out = {}
        raw = [s.encode("utf-8") for s in slices]
        flat = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        for numbers, rows in self.pairs.merge_all(flat, np.array([len(r) for r in raw])):
            for i, packed in packed_rows(numbers, rows):
                out[slices[i]] = packed
        return out

    def remember(self, fresh: dict[str, bytes]) -> None:
        if len(self.known) + len(fresh) > len(self.whole) + MEMORY:
            self.older, self.known = self.known, dict(self.whole)
        if len(fresh) <= MEMORY:
            self.known.update((s, p) for s, p in fresh.items() if len(s) <= KEPT)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        joined = "\0".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        border = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
        starts = self.token_starts(codes, border)
        cuts = [*starts.tolist(), len(codes)]
        slices = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        found = list(map(self.known.get, slices))
        holes = [i for i, f in enumerate(found) if f is None]
        if holes:
            missing = {slices[i] for i in holes}
            fresh = {s: self.older[s] for s in missing if s in self.older}
            fresh |= self.merge([s for s in missing if s not in fresh])
            for i in holes:
                found[i] = fresh[slices[i]]
            self.remember(fresh)
        at = np.searchsorted(starts, border)
        return [b"".join(found[a:b]) for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(found)])]

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """End offset of every token in the bytes of all of them."""
        return np.cumsum(self.length[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """Bytes of tokens, each written where its offsets say."""
        length = self.length[ids]
        shift = self.start[ids] - (ends - length)
        return self.surface[np.repeat(shift, length) + np.arange(int(length.sum()))].tobytes()


_LOADED: dict[str, ByteVocabulary] = {}


def vocabulary(ranks_file: str) -> ByteVocabulary:
    """One vocabulary (with its memory of slices) per Python worker."""
    if ranks_file not in _LOADED:
        _LOADED[ranks_file] = ByteVocabulary(ranks_file)
    return _LOADED[ranks_file]


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to at most ``most`` (or one)."""
    a = held = 0
    for i, size in enumerate(sizes):
        if i > a and held + size > most:
            yield a, i
            a, held = i, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def encode_decode(docs: DataFrame, ranks_file: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_tokens`` long, ``ids_u32le`` binary
    (ids as little-endian unsigned 32-bit integers), ``ends`` array of long
    (end of each token in the text's UTF-8 bytes) and ``decoded`` binary."""
    made = ("n_tokens", "ids_u32le", "ends", "decoded")
    kept = [c for c in docs.columns if c != text and c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_u32le", T.BinaryType()), T.StructField("ends", T.ArrayType(T.LongType())),
                           T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks_file)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(len(kept))).to_pylist()
            for a, b in parts(sizes, BATCH):
                piece = batch.slice(a, b - a)
                packed = vocab.encode(piece.column(len(kept)).to_pylist())
                ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
                ends = vocab.ends(ids)
                data = vocab.decode(ids, ends)
                last = np.cumsum([len(p) // 4 for p in packed])
                n = np.diff(last, prepend=0)
                border = np.r_[0, ends][last]                      # end of each text in data
                first = np.r_[0, border[:-1]]
                decoded = [data[x:y] for x, y in zip(first.tolist(), border.tolist())]
                local = pa.ListArray.from_arrays(pa.array(np.r_[0, last], pa.int32()), pa.array(ends - np.repeat(first, n), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:len(kept)], pa.array(n, pa.int64()), pa.array(packed, pa.binary()), local,
                     pa.array(decoded, pa.binary())], [*kept, *made])

    return source.mapInArrow(run, schema)
