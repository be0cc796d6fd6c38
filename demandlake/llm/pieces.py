"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding follows the merge order of the vocabulary: an agenda holds every
adjacent pair of symbols whose concatenation is a piece, ordered by descending
score, then by position; the best pair is merged and its two new neighbour
pairs join the agenda, until it is empty.  Symbols that are no piece fall back
to their UTF-8 byte pieces.

Two neighbouring characters that occur side by side inside no piece can
never be merged, so the text is cut there and the agenda runs per cut part;
parts are remembered in a bounded per-worker memory that starts with all
pieces.  The parts of a batch that are new are merged together, their agendas
being rows of one matrix (``merging``).  The cuts are derived from the
vocabulary, so the result is that of one agenda over the whole text.

Rows run through ``mapInArrow``: no shuffle, one part of a record batch in
memory.

Defined results: a null text counts as empty; an empty text is the begin and
end ids alone and decodes to the empty text; a very long text is a batch of
its own; repeated rows each give their row; extra columns are kept, columns
that clash with an output name are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.llm.merging import PairTable, packed_rows

SPACE = "▁"
SHORT = 48           # longer parts are cut further, and not remembered
MEMORY = 300_000     # parts remembered per worker, in each of two generations
BATCH = 1 << 20      # characters of texts encoded together


class MergeVocabulary:
    """The vocabulary of a merge-type model: pieces, scores, byte pieces."""

    def __init__(self, model_file: str, memory: int | None = None):
        self.memory = MEMORY if memory is None else memory
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        self.begin, self.end, self.unknown = m.bos_id(), m.eos_id(), m.unk_id()
        self.bytes = [-1] * 256
        scores: dict[str, float] = {}
        ids: dict[str, int] = {}
        surface: list[bytes] = []
        self.is_byte = np.zeros(size, bool)
        side_by_side = set()
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                surface.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i):
                surface.append(b"")
            elif m.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                ids[piece] = i
                scores[piece] = m.get_score(i)
                surface.append(piece.replace(SPACE, " ").encode())
                side_by_side.update(zip(piece, piece[1:]))
        self.side_by_side, self.size = side_by_side, size
        self.length = np.array([len(x) for x in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.drops_space = np.array([x[:1] == b" " and not b and i != self.unknown
                                     for i, (x, b) in enumerate(zip(surface, self.is_byte))])
        # a symbol is a piece, or a character that is none (numbered behind the pieces)
        self.character = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in ids.items():
            if len(piece) == 1:
                self.character[ord(piece)] = i
        place = {score: r for r, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = (ids.get(h, int(self.character[ord(h)]) if len(h) == 1 else None) for h in (piece[:cut], piece[cut:]))
                if a is not None and b is not None:
                    pairs.append((a, b, place[scores[piece]], i))
        self.pairs = PairTable(*zip(*pairs))
        # a quick first cut (before a space mark, around line ends) where no piece crosses it
        crossing = any((b == SPACE and a != SPACE) or a == "\n" or b == "\n" for a, b in side_by_side)
        self.quick = None if crossing else re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        self.whole = self.merge([p for p in ids if len(p) <= SHORT])
        self.known, self.older = dict(self.whole), {}
        self.fresh: dict[str, bytes] = {}  # parts merged since the last check

    def merge(self, parts: list[str]) -> dict[str, bytes]:
        """Packed ids of every part."""
        out = {}
        flat = self.character[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        for numbers, rows in self.pairs.merge_all(flat, np.array([len(p) for p in parts], np.int64)):
            odd = (rows >= self.size).any(1)
            for i, packed in packed_rows(numbers[~odd], rows[~odd]):
                out[parts[i]] = packed
            for i, symbols in zip(numbers[odd].tolist(), rows[odd].tolist()):
                out[parts[i]] = array("I", [x for s in symbols for x in ([s] if s < self.size else self._fallback(chr(s - self.size)))]).tobytes()
        return out

    def _fallback(self, character: str) -> list[int]:
        if self.bytes[0] < 0:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode("utf-8")]

    def _cut(self, chunk: str) -> list[str]:
        """A long chunk, cut where no piece crosses."""
        held = self.side_by_side
        starts = [0, *(i + 1 for i, p in enumerate(zip(chunk, chunk[1:])) if p not in held), len(chunk)]
        return [chunk[a:b] for a, b in zip(starts, starts[1:])]

    def _resolve(self, missing: set[str]) -> dict[str, bytes]:
        """Packed ids of chunks that are not known."""
        long = {c: self._cut(c) for c in missing if len(c) > SHORT}
        wanted = (missing - long.keys()).union(*long.values())
        found = {c: p for c in wanted if (p := self.known.get(c) or self.older.get(c)) is not None}
        merged = self.merge([c for c in wanted if c not in found])
        self.fresh |= merged
        found |= merged
        if len(self.known) + len(found) > len(self.whole) + self.memory:
            self.older, self.known = self.known, dict(self.whole)
        if len(found) <= self.memory:
            self.known.update((c, p) for c, p in found.items() if len(c) <= SHORT)
        found |= {c: b"".join([found[p] for p in parts]) for c, parts in long.items()}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """All ids of every text (begin and end included), little-endian u32."""
        first, last = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        chunks: list[str] = []
        ends = []
        for text in texts:
            if text:
                marked = SPACE + text.replace(" ", SPACE)
                if self.quick is None:
                    chunks.append(marked)
                else:
                    chunks += self.quick.findall(marked)
            ends.append(len(chunks))
        found = list(map(self.known.get, chunks))
        holes = [i for i, packed in enumerate(found) if packed is None]
        if holes:
            resolved = self._resolve({chunks[i] for i in holes})
            for i in holes:
                found[i] = resolved[chunks[i]]
        return [first + b"".join(found[a:b]) + last for a, b in zip([0, *ends], ends)]

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids: surfaces joined, byte pieces joined to UTF-8
        (each byte that is not valid becomes U+FFFD), the first space mark
        of the text dropped."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        length = self.length[ids]
        ends = np.cumsum(length)
        data = self.surface[np.repeat(self.start[ids] - (ends - length), length) + np.arange(int(length.sum()))].tobytes()
        shown = np.flatnonzero(length)
        out, a = [], 0
        for packed_ids, b in zip(packed, np.cumsum([len(p) // 4 for p in packed]).tolist()):
            lo, hi = (int(ends[i - 1]) if i else 0 for i in (a, b))
            k = np.searchsorted(shown, a)
            if k < len(shown) and shown[k] < b and self.drops_space[ids[shown[k]]]:
                lo += 1
            raw = data[lo:hi]
            try:
                out.append(raw.decode("utf-8"))
            except UnicodeDecodeError:
                out.append(_decode_bytewise(raw))
            a = b
        return out


def _decode_bytewise(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for width in (1, 2, 3, 4):
            try:
                out.append(data[i:i + width].decode("utf-8"))
                i += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_LOADED: dict[tuple[str, int | None], MergeVocabulary] = {}


def vocabulary(model_file: str, memory: int | None = None) -> MergeVocabulary:
    """One vocabulary (with its memory of parts) per Python worker."""
    if (model_file, memory) not in _LOADED:
        _LOADED[model_file, memory] = MergeVocabulary(model_file, memory)
    return _LOADED[model_file, memory]


def check_texts(vocab: MergeVocabulary, texts: list[str], packed: list[bytes], decoded: list[str]) -> None:
    """Raise unless the library gives the same ids for every whole text, and
    the same text for the ids."""
    library = vocab.model.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for text, own, ids in zip(texts, packed, library):
        if own != array("I", ids).tobytes():
            raise ValueError(f"ids differ from the library's for a text of {len(text)} characters: {text[:80]!r}")
    if decoded != vocab.model.decode(library, num_threads=1):
        raise ValueError("a decoded text differs from the library's")


def check_parts(vocab: MergeVocabulary) -> None:
    """Raise unless the library agrees on every part merged since the last
    call.  The parts go to the library as the lines of one text (no piece
    crosses a line end)."""
    fresh, vocab.fresh = vocab.fresh, {}
    if not fresh or vocab.quick is None:
        return
    ends = vocab.merge(["\n", SPACE])
    own = ends[SPACE] + b"".join([ends["\n"] + packed for packed in fresh.values()])
    ids = vocab.model.encode("\n" + "\n".join(fresh).replace(SPACE, " "), num_threads=1)
    if own != array("I", ids).tobytes():
        raise ValueError("ids of a merged part differ from the library's")


def _parts(sizes: list[int], together: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``together`` characters (or one text)."""
    together = BATCH if together is None else together
    a = held = 0
    for i, size in enumerate(sizes):
        if i > a and held + size > together:
            yield a, i
            a, held = i, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", check: str = "parts", memory: int | None = None,
                  together: int | None = None) -> DataFrame:
    """``docs`` without its text, plus ``n_tokens`` long, ``ids_u32le`` binary
    (begin id, ids, end id as little-endian unsigned 32-bit integers) and
    ``decoded`` string.  In every Arrow batch the library checks the work:
    ``check="parts"`` gives it each part once, when it is first merged, and
    the first text of the batch whole; ``check="texts"`` every text whole,
    encoded and decoded.  A difference fails the job.  ``memory`` parts are
    remembered per worker and generation, ``together`` characters encoded at
    once: workers stay, and what they hold is missing to the jobs that follow."""
    made = ("n_tokens", "ids_u32le", "decoded")
    kept = [c for c in docs.columns if c != text and c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_u32le", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file, memory)
        for batch in batches:
            whole = batch.column(len(kept)).to_pylist()
            for a, b in _parts([len(t) for t in whole], together):
                texts = whole[a:b]
                packed = vocab.encode(texts)
                decoded = vocab.decode(packed)
                if check == "parts" and vocab.quick is not None:
                    check_parts(vocab)
                    check_texts(vocab, texts[:1], packed[:1], decoded[:1])
                else:
                    vocab.fresh.clear()
                    check_texts(vocab, texts, packed, decoded)
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:len(kept)], pa.array([len(p) // 4 for p in packed], pa.int64()),
                     pa.array(packed, pa.binary()), pa.array(decoded, pa.string())], [*kept, *made])

    return source.mapInArrow(run, schema)
