"""Mixing documents to target weights with soft domain membership.

1. Classifier.  Word presence (Bernoulli) naive Bayes, learned from a
   labelled table (text, domain): the ``VOCABULARY`` words whose document
   shares differ most between domains, drawn from a bounded sample of about
   ``sample`` labelled rows.  Its tempered posterior p(domain | text) is the
   soft membership of every document.
2. Rates.  Every document gets a rate r >= ``least`` (0 by default) such that
   the expected domain token totals  S_d = sum_i r_i n_i p_id / N  match the
   targets w_d.  Projected gradient on the weighted least squares
   sum_d (S_d - w_d)^2 / (2 s_d), with s_d the totals at rate 1 and document
   i's coordinate scaled by n_i / N:

       r_i <- max(least, r_i - sum_d p_id (S_d - w_d) / s_d).

   Posteriors sum to one, so the scaled Hessian is stochastic and step 1 is
   safe.  Each round is one aggregation to one row (a number per domain);
   a document's rate is a pure function of its posterior and the short
   history of residuals, so no state is kept between rounds and a lost
   executor only repeats its own tasks.
3. Effect.  A document is repeated floor(r + u) times, u a fixed hash of its
   key in [0, 1).

All of it is SQL functions; there is no per-source or per-domain group, so a
source with a third of all rows is spread like any other.

The fit ends when the totals meet the targets, when a round no longer closes
the gap, or after ``ROUNDS`` rounds; the totals it reached are returned beside
the targets, so a mixture that nonnegative rates cannot meet is seen.  Columns
and plans grow with the number of domains, which is taken to be small (some
hundreds at most).

Defined results: null, empty and blank texts have 0 tokens, the posterior of a
text without any word, and do not move the totals; a very long text is one row
like any other; repeated rows count once each and get equal rates; rows with a
null key share one draw u, rows with a null domain are not learned from; a
domain without labelled rows takes no part (targets are renormalised over the
others; a learned domain without a target has target 0); without any
labelled row every rate is 1; ties in the vocabulary go to the smaller word;
extra columns are kept, columns that clash with an output name are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.llm.common import stage

VOCABULARY = 192
SAMPLE = 4000       # labelled rows the classifier sees (expected number)
TEMPERATURE = 4.0   # word evidence is divided by this: presence of words is not independent
ROUNDS, TOLERANCE, STALLED = 30, 1e-7, 0.98  # stop at this gap, or when a round keeps 98 % of it


@dataclass
class DomainModel:
    domains: list[str]
    words: list[str]
    present: list[list[float]]  # by word: tempered log-odds weight of presence, by domain
    base: list[float]           # by domain: prior and absence of every word


def _words(text: Column) -> Column:
    """Words of a text: what white space separates, empty pieces left out."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\t-\r ]+"), "")


def fit_domains(labelled: DataFrame, text: str = "text", domain: str = "domain", key: str = "doc_id",
                sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> DomainModel:
    known = labelled.where(F.col(domain).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(domain).count().collect()}  # a row per domain
    if not counts:
        return DomainModel([], [], [], [])
    total = sum(counts.values())
    draw = F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < min(1.0, sample / total)) if total > sample else known
    domains = sorted(counts)
    rows = drawn.select(F.col(domain).cast("string").alias("d"), F.array_distinct(_words(F.col(text))).alias("w"))
    shown = {r["d"]: r["n"] for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = (rows.select("d", F.explode("w").alias("word")).groupBy("word")
            .agg(*[F.count(F.when(F.col("d") == d, 1)).alias(f"n{i}") for i, d in enumerate(map(str, domains))]))
    share = [(F.col(f"n{i}") + 0.5) / (shown.get(str(d), 0) + 1.0) for i, d in enumerate(domains)]
    spread = (F.greatest(*share) - F.least(*share)) if len(share) > 1 else share[0]
    top = seen.withColumn("spread", spread).orderBy(F.desc("spread"), "word").limit(vocabulary).collect()
    theta = [[(r[f"n{i}"] + 0.5) / (shown.get(str(d), 0) + 1.0) for i, d in enumerate(domains)] for r in top]
    return DomainModel(
        [str(d) for d in domains], [r["word"] for r in top],
        [[(math.log(t) - math.log1p(-t)) / TEMPERATURE for t in row] for row in theta],
        [math.log(counts[d] / total) + sum(math.log1p(-row[i]) for row in theta) / TEMPERATURE for i, d in enumerate(domains)])


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens`` and ``p0 .. p<D-1>`` (model.domains order)."""
    words = _words(F.col(f"`{text}`"))
    kept = [c for c in docs.columns if c != "n_tokens" and not re.fullmatch(r"p\d+", c)]
    d = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("__words", words)
    d = d.withColumn("n_tokens", F.size("__words").cast("long"))
    k = len(model.domains)
    if model.words:
        vocab = F.array(*[F.lit(w) for w in model.words])
        weight = F.create_map(*[x for w, row in zip(model.words, model.present)
                                for x in (F.lit(w), F.array(*[F.lit(float(v)) for v in row]))])
        found = F.array_intersect(F.array_distinct("__words"), vocab)
        logits = F.aggregate(found, F.array(*[F.lit(float(b)) for b in model.base]),
                             lambda s, w: F.zip_with(s, F.element_at(weight, w), lambda a, b: a + b))
    else:
        logits = F.array(*[F.lit(float(b)) for b in model.base])
    d = d.withColumn("__logits", logits).withColumn("__top", F.array_max("__logits"))
    d = d.withColumn("__e", F.transform("__logits", lambda v: F.exp(v - F.col("__top"))))
    d = d.withColumn("__sum", F.aggregate("__e", F.lit(0.0), lambda s, v: s + v))
    return d.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", *[(F.col("__e")[i] / F.col("__sum")).alias(f"p{i}") for i in range(k)])


def _rate(history: list[list[float]], least: float, k: int) -> Column:
    r = F.lit(max(1.0, least))
    for step in history:
        move = F.lit(0.0)
        for i in range(k):
            move = move + F.col(f"p{i}") * F.lit(step[i])
        r = F.greatest(F.lit(float(least)), r - move)
    return r


def fit_rates(members: DataFrame, model: DomainModel, targets: dict[str, float], least: float = 0.0,
              growth: bool = False) -> tuple[Column, dict]:
    """(rate as a column of ``members``, report).  ``members`` has n_tokens
    and p0 .. pk; it is scanned once a round, so pass a staged table.
    ``growth``: the total is not N but the least with which no domain has to
    shrink."""
    k = len(model.domains)
    n = F.col("n_tokens")
    at_one = members.agg(F.sum(n).alias("n"), *[F.sum(n * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)]).first()
    total = float(at_one["n"] or 0)
    want = [max(0.0, float(targets.get(d, 0.0))) for d in model.domains]
    if not k or total == 0 or sum(want) == 0:
        return F.lit(1.0), {"rounds": 0, "totals": [], "targets": []}
    natural = [max(float(at_one[f"s{i}"]) / total, 1e-12) for i in range(k)]
    want = [w / sum(want) for w in want]
    if growth:
        factor = max(s / w for s, w in zip(natural, want) if w > 0)
        want = [w * factor for w in want]
    history: list[list[float]] = []
    last = math.inf
    for done in range(ROUNDS + 1):
        r = _rate(history, least, k)
        row = members.agg(*[F.sum(r * n * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)]).first()
        reached = [float(row[f"s{i}"]) / total for i in range(k)]
        residual = [s - w for s, w in zip(reached, want)]
        gap = sum(e * e / s for e, s in zip(residual, natural))
        if gap < TOLERANCE ** 2 or done == ROUNDS or gap > STALLED * last:
            break
        last = gap
        history.append([e / s for e, s in zip(residual, natural)])
    return _rate(history, least, k), {"rounds": len(history), "totals": reached, "targets": want}


def _plan(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str, key: str, domain: str,
          least: float, growth: bool) -> tuple[DomainModel, DataFrame, Column, Column, dict]:
    """(model, staged members, rate, copies, report of the fit)."""
    model = fit_domains(labelled, text, domain, key)
    members = stage(posteriors(docs.select(key, text), model, text).drop(text), "mixing-members")
    rate, report = fit_rates(members, model, targets, least, growth)
    u = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return model, members, rate, F.floor(rate + u).cast("int"), report


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id",
        domain: str = "domain", least: float = 0.0, growth: bool = False) -> DataFrame:
    """A row per row of ``docs``: its key, ``n_tokens``, ``domains`` (map of
    posteriors), ``rate``, ``copies``, and the same for every row ``targets``
    and ``reached``: what the expected domain totals should be and are, as
    maps (null where there was nothing to fit)."""
    model, members, rate, copies, report = _plan(docs, labelled, targets, text, key, domain, least, growth)

    def by_domain(values: list) -> Column:
        if not values:
            return F.lit(None).cast("map<string,double>")
        return F.map_from_arrays(F.array(*[F.lit(d) for d in model.domains]), F.array(*values))

    totals = {name: by_domain([F.lit(v) for v in report[made]]) for name, made in (("targets", "targets"), ("reached", "totals"))}
    return members.select(key, "n_tokens", by_domain([F.col(f"p{i}") for i in range(len(model.domains))]).alias("domains"),
                          rate.alias("rate"), copies.alias("copies"), *[c.alias(name) for name, c in totals.items()])


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", key: str = "doc_id",
             domain: str = "domain", least: float = 0.0, growth: bool = False) -> DataFrame:
    """``docs`` with every row repeated as often as the mixture asks.  The
    posterior is evaluated again in place, so the texts are not shuffled."""
    model, _, _, copies, _ = _plan(docs, labelled, targets, text, key, domain, least, growth)
    hidden = [c for c in docs.columns if c == "n_tokens" or re.fullmatch(r"p\d+", c)]
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias(text),
                       F.col(f"`{key}`").alias(key)) if hidden else docs
    # outer, then filtered on what it generates: a filter on the number of
    # copies would be pushed down and evaluate the posterior for every use
    out = posteriors(bare, model, text).withColumn("__copy", F.explode_outer(F.array_repeat(F.lit(1), copies))).where(
        "__copy is not null")
    return out.select("__row.*") if hidden else out.select(*docs.columns)
