"""Near-duplicate classes by DartMinHash signatures.

A text is the weighted set of its five-word shingles (weight: how often it
occurs).  Darts are a Poisson process over (element, weight, rank): the plane
above each element is cut into regions that double in weight, each region
into cells of at most unit area along the rank, and the number of darts in a
cell, their ranks, weights and coordinates are functions of hashes of
(element, region, cell).  A text keeps the darts that land below its weight
in an element and below a rank bound set for about k (ln k + 4) darts, and
its signature holds the earliest dart of each of the k coordinates (the
bound doubles while a coordinate has none).  Two texts agree in a coordinate
with probability equal to their weighted Jaccard similarity.

Joining.  Exact copies collapse to one representative.  Signatures are cut
into ``BANDS`` bands of ``ROWS`` coordinates; texts that agree in two bands
are candidates: a bucket is a pair of bands, built from those bands of a text
that any other text shares (at similarity 0.8 two texts meet in some bucket
with probability 0.9996; texts that have a common passage and little else
rarely do).  No bucket is expanded into pairs.  First every member of a
bucket is compared with the bucket's hub, the text that meets most others.
Then, in rounds until one finds no link or a slice of meetings is left, each
component of a bucket that still holds several is compared through one member, drawn anew in every
round and from every bucket the two components share.  Last, buckets that
still hold several components are gone through in full: every member outside
the largest component meets every member of another component, so no
candidate pair of two classes is left out.  A bucket is dealt into groups of
``CHUNK`` by ``CHUNK`` texts; a pair counts in the first bucket it shares; the
groups are taken ``SLICE`` meetings at a time, and links found in one slice
spare the next the pairs they join.  A pair whose parity sketches differ in
more bits than its sets may differ in elements is not a link and is left out
of the join with the sets (each element that only one text has flips one bit,
so the test is exact).  A compared pair is a link if its weighted Jaccard
similarity is exactly ``threshold`` or more.
Classes are the connected components of the links, named by their smallest
id.

Cost: groups of texts that link cost a comparison a member and round.  A
family that meets in buckets without linking (templates just under
``threshold``) costs the square of its size in meetings.

Skew: buckets and copies are joined by keys whose partitions adaptive
execution can split; per-bucket work before a join is a partial aggregate.
Intermediate tables (ids and hashes) are staged in the shared folder.

Defined results: null and empty texts, and texts without a word, are classes
of their own; texts of fewer than five words have one shingle; rows with a
null id take no part and get no row; rows that repeat an id and text
are one document; a repeated id with different texts gets the smaller of its
classes; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import stage
from demandlake.llm.words import mix, shingles, word_hashes

SIZE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SKETCH = 1024         # bits of a parity sketch
CHUNK = 128           # texts of a bucket that meet as many others in one group
SLICE = 1 << 26       # meetings of a slice
FINEST = 64  # the first rank cell of a region has area 1 / FINEST
_U = np.float64(2.0 ** -53)


def _cells(area: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of rank times width up to ``area``: doubling to 1, then of area 1."""
    edges = [0.0, 1.0 / FINEST]
    while edges[-1] < area:
        edges.append(edges[-1] * 2 if edges[-1] < 1 else edges[-1] + 1)
    return np.array(edges[:-1]), np.array(edges[1:])


def _poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Inverse of the Poisson distribution function."""
    p = np.exp(-mean)
    total, n = p.copy(), np.zeros(len(u), np.int64)
    for i in range(1, 24):
        above = u > total
        if not above.any():
            break
        n += above
        p = p * mean / i
        total = total + p
    return n


def _throw(elements: np.ndarray, weights: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, rank) of every dart below the weights and below ``bound``."""
    names, ranks = [], []
    region = 0
    while True:
        width, low = float(2 ** region), float(2 ** region - 1)
        own = np.flatnonzero(weights > low)
        if not len(own):
            break
        lo, hi = _cells(bound * width)
        step = max(1, (1 << 20) // len(lo))
        for i in range(0, len(own), step):
            part = own[i:i + step]
            cell = mix(np.arange(len(lo), dtype=np.uint64) + np.uint64(region << 32))
            h = mix(elements[part][:, None] + cell[None, :])
            u = (h >> np.uint64(11)) * _U
            some = np.flatnonzero((u > np.exp(lo - hi)[None, :]).ravel())
            col = some % len(lo)
            n = _poisson(u.ravel()[some], (hi - lo)[col])
            dart = np.repeat(np.arange(len(some)), n)
            order = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
            name = mix(h.ravel()[some][dart] + (order.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            c = col[dart]
            rank = (lo[c] + (hi - lo)[c] * ((name >> np.uint64(11)) * _U)) / width
            height = low + width * ((mix(name + np.uint64(1)) >> np.uint64(11)) * _U)
            ok = (rank < bound) & (height < weights[part][some[dart] // len(lo)])
            names.append(name[ok])
            ranks.append(rank[ok])
        region += 1
    return np.concatenate(names), np.concatenate(ranks)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates."""
    bound = k * (math.log(k) + 4) / float(weights.sum())
    while True:
        names, ranks = _throw(elements, weights, bound)
        order = np.argsort(ranks, kind="stable")
        names = names[order]
        coordinate = mix(names + np.uint64(2)) % np.uint64(k)
        found, first = np.unique(coordinate, return_index=True)
        if len(found) == k:
            return names[first]
        bound *= 2


def _slices(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        texts, begin, size = whole.column(at).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= 1 << 18 or i == len(texts) - 1:
                yield whole.slice(begin, i + 1 - begin), texts[begin:i + 1]
                begin, size = i + 1, 0


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = BANDS, rows: int = ROWS,
               size: int = SIZE) -> DataFrame:
    """(key, content binary, bands array<long>): hash of the word sequence and
    band hashes; both null for a text without words."""
    def run(batches):
        for part, texts in _slices(batches, 1):
            words, offsets = word_hashes(texts)
            content, out = [], []
            for i in range(len(texts)):
                own = words[offsets[i]:offsets[i + 1]]
                if not len(own):
                    content.append(None)
                    out.append(None)
                    continue
                elements, counts = np.unique(shingles(own, size), return_counts=True)
                content.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                band = np.zeros(bands, np.uint64)
                sig = signature(elements, counts.astype(np.float64), bands * rows).reshape(bands, rows)
                for r in range(rows):
                    band = mix(band * np.uint64(31) + sig[:, r])
                out.append(mix(band + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), pa.array(out, pa.list_(pa.int64()))],
                                             ["id", "content", "bands"])

    d = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return d.mapInArrow(run, "id long, content binary, bands array<long>")


def occurrences(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, t) -> (id, elements array<long>): each shingle with its number of
    occurrence, so that plain set similarity of them is the weighted one."""
    def run(batches):
        for part, texts in _slices(batches, 1):
            words, offsets = word_hashes(texts)
            out = []
            for i in range(len(texts)):
                s = np.sort(shingles(words[offsets[i]:offsets[i + 1]], size))
                nth = np.arange(len(s)) - np.searchsorted(s, s)
                out.append(np.where(nth > 0, mix(s + nth.astype(np.uint64)), s).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "elements"])

    return docs.mapInArrow(run, "id long, elements array<long>")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): smallest id connected to each of ``nodes`` (id) by
    ``edges`` (a, b; each once or more).  Labels take the minimum over neighbours and are then
    short-cut through the label's own label, until nothing changes."""
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(nodes.select("id", F.col("id").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        lower = stage(lower, "labels")
        jump = lower.select(F.col("id").alias("at"), F.col("root").alias("far"))
        new = stage(lower.join(jump, lower["root"] == jump["at"], "left").select(
            "id", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        changed = new.where("root <> was").limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, bands: int = BANDS,
            rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """A row per document: ``id``, ``copy_of`` (smallest id with the same word
    sequence) and ``class_id`` (smallest id of its class)."""
    signed = stage(signatures(docs, text, key, bands, rows, size), "signatures")
    heads = stage(signed.where("content is not null").groupBy("content").agg(
        F.min("id").alias("head"), F.min_by("bands", "id").alias("bands")), "heads")
    own = stage(_own_bands(heads), "own-bands")
    members = _members(own)
    nodes = stage(members.select("id").distinct(), "nodes")
    wanted = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    sets = stage(occurrences(wanted.join(nodes, "id", "left_semi"), size), "shingles")
    roots = nodes.select("id", F.col("id").alias("root"))
    compared = stage(_with_hubs(members), "pairs")
    links = found = stage(_similar(compared, sets, threshold), "links")
    turn = 0
    while True:
        roots = components(nodes, links)
        several = stage(_several(members, roots), "several")
        meetings = several.agg(F.sum(F.col("hubs").cast("double") * F.col("members"))).first()[0] or 0
        if meetings <= SLICE:
            break
        turn += 1
        pairs = stage(_between_components(members, roots, turn).join(compared, ["a", "b"], "left_anti"), "pairs")
        found = stage(_similar(pairs, sets, threshold), "links")
        compared = compared.union(pairs)
        if not found.limit(1).count():
            break
        links = links.union(found)
    if meetings:
        unmet = stage(_unmet(own, several, roots), "unmet")
        texts = stage(heads.select(F.col("head").alias("id"), "bands").join(_sketches(sets), "id"), "sketches")
        slices = math.ceil(meetings / SLICE)
        for turn in range(slices):
            pairs = _meetings(unmet, texts, roots, slices, turn, bands, threshold).join(compared, ["a", "b"], "left_anti")
            found = stage(_similar(pairs, sets, threshold), "links")
            if found.limit(1).count():
                links = links.union(found)
                roots = components(nodes, links)
    copies = signed.select("id", "content").join(heads.select("content", "head"), "content", "left").select(
        "id", F.coalesce("head", "id").alias("copy_of"))
    named = copies.join(roots.withColumnRenamed("id", "head"), F.col("copy_of") == F.col("head"), "left")
    return named.groupBy("id").agg(F.min("copy_of").alias("copy_of"), F.min(F.coalesce("root", "copy_of")).alias("class_id"))


def _own_bands(heads: DataFrame) -> DataFrame:
    """(id, b): the bands of a text that others share, in order; two or more."""
    bands = _shared(heads.select(F.col("head").alias("id"), F.explode("bands").alias("bucket")))
    return bands.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("b")).where(F.size("b") > 1)  # at most BANDS


def _members(own: DataFrame) -> DataFrame:
    """(bucket, id, members) of every pair of bands that two or more texts
    share; ``members``: how many texts the bucket has."""
    pairs = F.expr("flatten(transform(sequence(1, size(b) - 1), i -> "
                   "transform(slice(b, i + 1, size(b) - i), x -> xxhash64(b[i - 1], x))))")
    return stage(_shared(own.select("id", F.explode(pairs).alias("bucket"))), "members")


def _shared(member: DataFrame) -> DataFrame:
    """The rows of buckets with more than one id, and their number."""
    several = member.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("members"))
    return member.join(several.where("low < high").select("bucket", "members"), "bucket")


def _pair(a: str, b: str):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _with_hubs(members: DataFrame) -> DataFrame:
    """Every member of a bucket with the bucket's hub: the text that meets
    most others over all of its buckets (the original of a group of edited
    copies, if it is there); ties to the smaller id."""
    degree = members.groupBy("id").agg(F.sum("members").alias("degree"))
    hubs = members.join(degree, "id").groupBy("bucket").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("hub"))
    return members.join(hubs, "bucket").where("id <> hub").select(*_pair("id", "hub")).distinct()


def _between_components(members: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """In every bucket that still holds several components: one member of
    each, drawn anew by a hash in every round, with that of the component
    that has most members there."""
    placed = members.select("bucket", "id").join(roots, "id")
    several = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    drawn = placed.join(several.select("bucket"), "bucket").groupBy("bucket", "root").agg(
        F.min_by("id", F.xxhash64("bucket", "id", F.lit(turn))).alias("one"), F.count(F.lit(1)).alias("n"))
    drawn = stage(drawn, "drawn")
    centre = drawn.groupBy("bucket").agg(F.max_by("one", F.struct("n", -F.col("root"))).alias("centre"))
    return drawn.join(centre, "bucket").where("one <> centre").select(*_pair("one", "centre")).distinct()


def _several(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The buckets that hold several components: (bucket, members, hubs,
    centre); ``centre``: the component that has most members there, ``hubs``:
    how many members are of others."""
    counted = members.select("bucket", "id").join(roots, "id").groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    several = counted.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("members"), F.max("n").alias("most"),
        F.max_by("root", F.struct("n", -F.col("root"))).alias("centre")).where("low < high")
    return several.select("bucket", "members", (F.col("members") - F.col("most")).alias("hubs"), "centre")


def _unmet(own: DataFrame, several: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of those buckets: (bucket, id, x, y, members, hubs, hub);
    x < y: the bucket's bands; ``hub``: not of the centre."""
    pairs = F.expr("flatten(transform(sequence(1, size(b) - 1), i -> transform(slice(b, i + 1, size(b) - i), "
                   "x -> named_struct('x', b[i - 1], 'y', x, 'bucket', xxhash64(b[i - 1], x)))))")
    placed = own.select("id", F.explode(pairs).alias("p")).select("id", "p.*")
    return placed.join(several, "bucket").join(roots, "id").select(
        "bucket", "id", "x", "y", "members", "hubs", (F.col("root") != F.col("centre")).alias("hub"))


def _sketches(sets: DataFrame) -> DataFrame:
    """(id, elements) -> (id, n, sketch array<long>): how many elements, and
    for each of ``SKETCH`` bits the parity of the elements that hash to it."""
    def run(batches):
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            n = np.array([len(x) for x in batch.column(1)], np.int64)
            elements = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            bit = (elements % np.uint64(SKETCH)).astype(np.int64) + np.repeat(np.arange(len(n)), n) * SKETCH
            parity = (np.bincount(bit, minlength=len(n) * SKETCH) & 1).astype(np.uint8)
            sketch = np.packbits(parity).view(np.int64)
            offsets = np.arange(len(n) + 1, dtype=np.int32) * (SKETCH // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(sketch))],
                                             ["id", "n", "sketch"])

    return sets.select("id", "elements").mapInArrow(run, "id long, n long, sketch array<long>")


def _meetings(unmet: DataFrame, texts: DataFrame, roots: DataFrame, slices: int, turn: int, bands: int,
              threshold: float) -> DataFrame:
    """(a, b): every hub with every member of another component, in the first
    bucket the two share, if their sketches let them be a link."""
    rows = unmet.join(roots, "id").join(texts, "id")
    groups = lambda n: F.ceil(F.col(n) / F.lit(CHUNK)).cast("int")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), groups(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), groups(n) - 1))
    now = F.pmod(F.xxhash64("bucket", "i"), F.lit(slices)) == turn
    left = rows.where("hub").withColumn("i", deal(1, "hubs")).where(now).withColumn("j", every("members")).select(
        "bucket", "i", "j", "x", "y", *[F.col(c).alias(f"{c}_a") for c in ("id", "root", "bands", "n", "sketch")])
    right = rows.withColumn("j", deal(2, "members")).withColumn("i", every("hubs")).where(now).select(
        "bucket", "i", "j", "hub", *[F.col(c).alias(f"{c}_b") for c in ("id", "root", "bands", "n", "sketch")])
    met = (F.col("root_a") != F.col("root_b")) & (~F.col("hub") | (F.col("id_a") < F.col("id_b")))
    for k in range(bands):
        va, vb = F.col("bands_a")[k], F.col("bands_b")[k]
        met = met & ((va != vb) | (va >= F.col("y")) | (va == F.col("x")))
    differ = sum((F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH // 64)), F.lit(0))
    met = met & (differ * (1 + threshold) <= (F.col("n_a") + F.col("n_b")) * (1 - threshold) + 1e-9)
    return left.join(right, ["bucket", "i", "j"]).where(met).select(*_pair("id_a", "id_b"))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity >= threshold:
    same / (|a| + |b| - same) >= t, solved for the common part."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    same = F.size(F.array_intersect("ea", "eb"))
    enough = same * (1 + threshold) >= (F.size("ea") + F.size("eb")) * threshold - 1e-9
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b").distinct()
