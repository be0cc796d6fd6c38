import random
from collections import Counter, defaultdict

import numpy as np

from demandlake.llm import dartminhash as D
from demandlake.llm.words import shingles, word_hashes

SCHEMA = "doc_id long, text string, bucket string, id long"


def brute(rows, threshold=0.8):
    """Connected components of weighted Jaccard links, all pairs compared."""
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = Counter(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else None
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = defaultdict(set)
    for i in ids:
        for g in sets[i] or ():
            holders[g].add(i)
    for a in ids:
        if sets[a] is None:
            continue
        for b in {b for g in sets[a] for b in holders[g] if b > a}:
            same = sum((sets[a] & sets[b]).values())
            if same / (sum(sets[a].values()) + sum(sets[b].values()) - same) >= threshold:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 3000).astype(np.uint64)
    for heavy in (1, 40):
        wa = rng.integers(1, heavy + 1, 3000).astype(float)
        wb = np.where(rng.random(3000) < 0.8, wa, wa + 1)
        full_a, full_b = np.zeros(3000), np.zeros(3000)
        a, b = np.arange(400), np.r_[50:400, 900:930]
        full_a[a], full_b[b] = wa[a], wb[b]
        truth = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
        k = 2048
        same = (D.signature(pool[a], wa[a], k) == D.signature(pool[b], wb[b], k)).mean()
        assert abs(same - truth) < 4 * np.sqrt(truth * (1 - truth) / k)


def test_signature_ignores_order_and_scale_of_other_sets():
    pool = np.arange(1, 50, dtype=np.uint64) * np.uint64(7919)
    a = D.signature(pool, np.ones(49), 64)
    assert np.array_equal(a, D.signature(pool[::-1].copy(), np.ones(49), 64))
    assert len(D.signature(pool[:1], np.array([3.0]), 64)) == 64


def test_classes_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "two words"), (i + 4, "two words"), (i + 5, "two\twords"), (i + 6, "x " * 20000),
             (i + 7, "x " * 20000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, "two words", None, None), (3, rows[3][1], "again", 9)], SCHEMA)
    got = {r.id: r.class_id for r in D.classes(docs).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert got == want


def test_many_near_copies_of_one_text(spark):
    rng = random.Random(9)
    base = [f"v{rng.randrange(10000)}" for _ in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = f"z{i}"
        rows.append((i, " ".join(w), "", 0))
    got = D.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 300


def test_empty_table(spark):
    assert D.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_all_pairs(spark):
    from demandlake.llm.queries import op6_dartminhash_classes
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in op6_dartminhash_classes(spark, d).collect()}
    assert got == brute(rows)


def test_words_do_not_depend_on_the_batch():
    texts = ["a bb  ccc", None, "", "  a bb ccc\n", "é" * 9000 + " x"]
    words, offsets = word_hashes(texts)
    assert np.diff(offsets).tolist() == [3, 0, 0, 3, 2]
    assert np.array_equal(words[:3], words[3:6])
    assert np.array_equal(word_hashes([texts[4]])[0], words[6:])
    assert len(shingles(words[:3])) == 1 and len(shingles(words[:0])) == 0


def template_family(seed, families, singles, fields=1000):
    """Texts of one template whose own fields keep them at about 0.75, and
    drafts of some of them at about 0.82."""
    rng = random.Random(seed)
    places = range(5, fields - 5, 5)
    rows = []
    for f in range(families + singles):
        own = rng.sample(places, 14)
        text = [f"f{f}x{j}" if j in own else f"t{j}" for j in range(fields)]
        rows.append(text)
        if f < families:
            more = rng.sample([p for p in places if p not in own], 19)
            rows.append([f"g{f}x{j}" if j in more else w for j, w in enumerate(text)])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_pairs_inside_a_family_under_the_threshold(spark):
    rows = template_family(5, 40, 80)
    want = brute(rows)
    assert 40 <= sum(i != c for i, c in want.items()) < len(rows) // 2     # pairs, no chain through the family
    got = {r.id: r.class_id for r in D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_slices_and_groups_leave_no_pair_out(spark, monkeypatch):
    rows = template_family(6, 25, 40)
    monkeypatch.setattr(D, "CHUNK", 8)
    monkeypatch.setattr(D, "SLICE", 1 << 14)
    got = {r.id: r.class_id for r in D.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
