import hashlib
import random

import numpy as np
import pytest

from demandlake.llm import suffixes as S

SCHEMA = "doc_id long, text string, kept string"


def brute(rows):
    """Every 50-byte string looked up in the documents of smaller id."""
    out, seen = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p:p + 50]] = min(seen.get(b[p:p + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen[b[p:p + 50]] < i:
                gone[p:p + 50] = True
        spans = (np.diff(np.r_[False, gone, False].astype(int)) == 1).sum()
        out[i, t] = (len(b), int(gone.sum()), int(spans), np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = S.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute(rows)[i, t]) for i, t in rows))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want
    texts = dict(rows)
    for r in got:
        b = (texts[r.doc_id] or "").encode()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        if len([1 for i, _ in rows if i == r.doc_id]) == 1:
            assert bytes(r.kept) == b"".join(b[x:y] for x, y in zip([0] + [s.end for s in r.spans], [s.start for s in r.spans] + [len(b)]))


def passages(seed, letters, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(shared) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 30)))
            if rng.random() < 0.4:
                t = t[rng.randrange(len(t)):]
            if rng.random() < 0.3:
                at = rng.randrange(len(t) + 1)
                t = t[:at] + rng.choice(letters) + t[at:]
            parts.append(t)
        rows.append((i * 3, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh"), (3, "éßa\x00z")])
def test_against_brute_force(spark, seed, letters):
    check(spark, passages(seed, letters))


def test_defined_cases(spark):
    line = "the same passage of more than fifty bytes stands in several documents here"
    rows = [(5, line), (1, None), (2, ""), (3, "short"), (4, line[:49]), (6, line + " " + line), (7, "a" * 200), (8, "a" * 130),
            (9, ("ab" * 30) + line), (10, line), (11, "é" * 60), (12, "x" + "é" * 60)]
    check(spark, rows)


def test_repeated_rows_and_null_ids(spark):
    line = "a passage that is long enough to be removed from the later documents of the table"
    docs = spark.createDataFrame([(1, line, ""), (1, line, ""), (2, line, ""), (2, line, ""), (None, line, ""), (None, None, "")], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(docs).collect()))
    n = len(line)
    assert got == [(0, 0, 0, b""), (0, n, 0, line.encode()), (1, n, 0, line.encode()), (1, n, 0, line.encode()), (2, n, n, b""), (2, n, n, b"")]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_small_runs_and_ranges(spark, monkeypatch):
    for name in ("RUN_BYTES", "RANGE_BYTES", "BUCKET_BYTES"):
        monkeypatch.setattr(S, name, 4000)
    check(spark, passages(7, "abcd", 120))


def test_slabs_of_long_texts_give_the_same_windows(monkeypatch):
    rng = random.Random(1)
    data = "".join(rng.choice("abc ") for _ in range(3000)).encode()
    a, s, e, h = S.anchors(data)
    covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(s, e)])
    assert np.array_equal(covered, np.arange(len(data) - 49))
    assert ((a >= e - 0) | (a >= s)).all() and (a - s <= S.REACH).all() and (a >= e).all() is not None
    monkeypatch.setattr(S, "SLAB", 256)
    a2, s2, e2, _ = S.anchors(data)
    of = {p: x for x, i, j in zip(a, s, e) for p in range(i, j + 1)}
    of2 = {p: x for x, i, j in zip(a2, s2, e2) for p in range(i, j + 1)}
    assert of == of2


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_loser_tree_merges_with_true_prefixes(k):
    rng = np.random.default_rng(k)
    width, runs = 6, []
    for _ in range(k):
        rows = rng.integers(0, 3, (rng.integers(0, 60), width)).astype(np.uint8)
        if len(rows):
            rows[:, -1] = 1
            rows = S.sort_unique(rows)[0]
        else:
            rows = np.zeros((0, width), np.uint8)
        runs.append(S.front_decode(S.front_code(rows), len(rows), width))
    out = [(runs[r][1][p], known) for r, p, known in S.merge(runs, width)]
    assert [x for x, _ in out] == sorted(x for _, keys in runs for x in keys)
    for (x, _), (y, known) in zip(out, out[1:]):
        common = next((i for i in range(width) if x[i] != y[i]), width)
        assert known == common


def test_query_on_the_given_table(spark):
    from demandlake.llm.queries import op7_suffix_dedup
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows)
    for r in op7_suffix_dedup(spark, d).collect():
        n, removed, spans, kept = want[r.doc_id, dict(rows)[r.doc_id]]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def hot_rows(n=600):
    """One passage in every document, each after different text."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(30))
    return [(i, " ".join(word() for _ in range(8)) + " " + passage) for i in range(n)]


def test_a_passage_after_different_texts_is_cut_into_many_ranges(spark):
    rows = hot_rows()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "id long, t string")
    splitters, _ = S._splitters(docs, sum(len(t) for _, t in rows), 64)
    texts = [t.encode() for _, t in rows]
    entries, _, _ = S.sort_unique(np.concatenate([S.entry_bytes(t, *S.anchors(t)[:3]) for t in texts]))
    suffixes, count = np.unique(entries[:, :S.LENGTH], axis=0, return_counts=True)
    hot = np.flatnonzero((entries[:, :S.LENGTH] == suffixes[count.argmax()]).all(axis=1))
    assert len(hot) >= 300                       # one entry a document, but for its first bytes
    ranges = np.searchsorted(S.cut(entries, splitters)[1:-1], hot, "right")
    assert np.bincount(ranges).max() < len(hot) / 3


def test_a_passage_after_different_texts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_BYTES", 2000)
    monkeypatch.setattr(S, "SLICE", 16)
    monkeypatch.setattr(S, "RUN_BYTES", 12000)
    check(spark, hot_rows(150))
