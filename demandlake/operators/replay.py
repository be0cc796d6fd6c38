"""Ledger replay (K1, K3, K7): accept or reject every movement in time order.

Whether a withdrawal is accepted depends on all accepted rows before it.
Still, most of a long history needs no row-by-row pass in one task: a run of
deposits and withdrawals whose opening balance covers its deepest point
refuses nothing, and then adds its sum.

Rows are range-partitioned by (user, time, id), so a user with a large part of
all rows spreads over many tasks.  In a task
* a user who lies whole in it and is short is replayed at once;
* other users (long ones, and those at the ends of the range) are cut into
  segments of at most ``SEGMENT`` rows, a tier purchase being a segment of its
  own; a segment is summed up by the balance it needs, its sum and its packed
  amounts.
The segments of a user are then chained: one that is covered is one addition;
one that is not is a loop of additions over its packed amounts; a tier
purchase is one step.  With its opening state known, every segment is replayed
on its own, in parallel again.  So what stays sequential for one user is that
chain (no other column travels to it, and it streams), and nothing for users
who are short.

Defined results: user, time and id are not null; equal rows are movements of
their own; ties of time go by id, then kind, amount and level; amounts that
are null count as zero.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.session import stage_path

# Tier prices and the time a tier lasts.
TIER_PRICE = {"bronze": 0.0, "silver": 100.0, "gold": 200.0, "diamond": 500.0}
TIER_DAYS = 30

SEGMENT = 1024  # rows

REPLAY_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("op_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),
    T.StructField("amount_cents", T.LongType()),
    T.StructField("level", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("balance_cents", T.LongType()),
    T.StructField("tier", T.StringType()),
    T.StructField("tier_end", T.DateType()),
])
INPUT = ["user_id", "op_id", "ts", "kind", "amount_cents", "level"]
ORDER = ["user_id", "ts", "op_id", "kind", "amount_cents", "level"]
_PRICE_CENTS = {k: int(round(v * 100)) for k, v in TIER_PRICE.items()}


def step(balance: int, tier: str, end: dt.date | None, kind: str, amount: int, level: str | None,
         today: dt.date) -> tuple[bool, str | None, int, str, dt.date | None]:
    """One movement: (accepted, reason, balance, tier, end of the tier)."""
    if end is not None and end < today and tier != "bronze":  # K7 sweep before the movement
        tier, end = "bronze", None
    if kind == "deposit":
        if amount > 0:
            return True, None, balance + amount, tier, end
        return False, "non_positive_deposit", balance, tier, end
    if kind == "withdraw":
        if amount < 0:
            return False, "negative_withdrawal", balance, tier, end
        if amount > balance:
            return False, "insufficient_funds", balance, tier, end
        return True, None, balance - amount, tier, end
    if kind != "tier":
        return False, "unknown_kind", balance, tier, end
    wanted = str(level).lower()
    price = _PRICE_CENTS.get(wanted)
    if price is None:
        return False, "unknown_tier", balance, tier, end
    if _PRICE_CENTS[tier] > price:
        return False, "tier_step_down", balance, tier, end
    if balance < price:
        return False, "insufficient_funds", balance, tier, end
    again = tier == wanted and end is not None and end >= today
    return True, None, balance - price, wanted, (end if again else today) + dt.timedelta(days=TIER_DAYS)


def fold(rows: pd.DataFrame, key: str = "user_id") -> pd.DataFrame:
    """Replay of ordered rows; at each new ``key`` the state starts from the
    row's ``opening_cents``, ``opening_tier`` and ``opening_end``."""
    made: list[tuple] = []
    last = object()
    balance, tier, end = 0, "bronze", None
    days = pd.to_datetime(rows["ts"]).dt.date
    for k, kind, amount, level, day, opening, opening_tier, opening_end in zip(
            rows[key], rows["kind"], rows["amount_cents"], rows["level"], days,
            rows["opening_cents"], rows["opening_tier"], rows["opening_end"]):
        if k != last:
            last, balance, tier, end = k, int(opening), opening_tier, None if pd.isna(opening_end) else opening_end
        ok, why, balance, tier, end = step(balance, tier, end, kind, int(amount), level, day)
        made.append((ok, why, balance, tier, end))
    out = rows[INPUT].reset_index(drop=True)
    for name, column in zip(("accepted", "reason", "balance_cents", "tier", "tier_end"), zip(*made) if made else [()] * 5):
        out[name] = pd.Series(list(column), dtype={"accepted": bool, "balance_cents": "int64"}.get(name, object))
    return out


# --- the three passes -----------------------------------------------------------

_CUT = T.StructType([T.StructField("what", T.StringType()), *REPLAY_SCHEMA.fields, T.StructField("opening_cents", T.LongType()),
                     T.StructField("segment", T.LongType()), T.StructField("need", T.LongType()), T.StructField("total", T.LongType()),
                     T.StructField("packed", T.BinaryType())])


def _signed(rows: pd.DataFrame) -> np.ndarray:
    kind, amount = rows["kind"].to_numpy(), rows["amount_cents"].to_numpy(np.int64)
    return np.where((kind == "deposit") & (amount > 0), amount, np.where((kind == "withdraw") & (amount > 0), -amount, 0))


def _segments(rows: pd.DataFrame, first: int) -> tuple[pd.DataFrame, pd.DataFrame, int]:
    """(rows that need their segment's opening, a row a segment or purchase,
    next segment number)."""
    users = rows["user_id"].to_numpy()
    tier = rows["kind"].to_numpy() == "tier"
    fresh = np.r_[True, users[1:] != users[:-1]] | tier | np.r_[False, tier[:-1]]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
    fresh |= (np.arange(len(rows)) - start) % SEGMENT == 0
    number = np.cumsum(fresh) - 1
    plain = ~tier
    signed = _signed(rows)
    cut = np.flatnonzero(fresh)
    sums = np.cumsum(signed)
    before = np.r_[0, sums][cut]
    heads = rows[fresh].assign(
        what="segment", segment=first + np.arange(len(cut)), total=np.add.reduceat(signed, cut),
        need=np.maximum(0, before - np.minimum.reduceat(sums, cut)),
        packed=[None if t else signed[a:b].astype("<i8").tobytes() for t, a, b in zip(tier[cut], cut.tolist(), [*cut[1:].tolist(), len(rows)])])
    waiting = rows[plain].assign(what="row", segment=first + number[plain])
    return waiting, heads, first + int(fresh.sum())


def _cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in _CUT.fields]
    held = first_user = long_user = None
    number = 0

    def shaped(df: pd.DataFrame) -> pd.DataFrame:
        return df.assign(**{c: pd.Series([None] * len(df), index=df.index, dtype=object) for c in names if c not in df.columns})[names]

    def cut(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal number
        if len(rows):
            waiting, heads, number = _segments(rows, number)
            yield shaped(waiting)
            yield shaped(heads)

    for pdf in batches:
        if not len(pdf):
            continue
        if held is None:
            first_user, number = pdf["user_id"].iloc[0], int(pdf["__range"].iloc[0]) << 40
        rows = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        users = rows["user_id"].to_numpy()
        last = int(np.searchsorted(users, users[-1]))       # the last user may go on in the next batch
        done, held = rows.iloc[:last], rows.iloc[last:]
        size = done.groupby("user_id")["user_id"].transform("size").to_numpy() if len(done) else np.zeros(0)
        long = (size > SEGMENT) | done["user_id"].isin([first_user, long_user]).to_numpy()
        if (~long).any():
            yield shaped(fold(done[~long].assign(opening_tier="bronze", opening_end=None)).assign(what="done"))
        yield from cut(done[long])
        if len(held) >= SEGMENT:
            long_user = users[-1]
            whole = len(held) // SEGMENT * SEGMENT
            yield from cut(held.iloc[:whole])
            held = held.iloc[whole:]
    if held is not None:
        yield from cut(held)


_CHAIN = T.StructType([T.StructField("what", T.StringType()), *REPLAY_SCHEMA.fields, T.StructField("segment", T.LongType()),
                       T.StructField("opening_cents", T.LongType()), T.StructField("opening_tier", T.StringType()),
                       T.StructField("opening_end", T.DateType())])


def _walk(balance: int, signed: list[int]) -> int:
    """Closing balance when withdrawals that are not covered are refused."""
    for amount in signed:
        after = balance + amount
        if after >= 0 or amount >= 0:
            balance = after
    return balance


def _chain(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments ordered by (user, time): the state each one opens with, and
    the decided tier purchases."""
    names = [f.name for f in _CHAIN.fields]
    user, balance, tier, end = None, 0, "bronze", None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.user_id != user:
                user, balance, tier, end = r.user_id, int(r.opening_cents), "bronze", None
            if r.packed is None:
                ok, why, balance, tier, end = step(balance, tier, end, r.kind, 0, r.level, r.ts.date())
                out.append(("done", user, r.op_id, r.ts, r.kind, r.amount_cents, r.level, ok, why, balance, tier, end, None, None, None, None))
            else:
                out.append(("segment", *[None] * 11, r.segment, balance, tier, end))
                balance = balance + r.total if balance >= r.need else _walk(balance, np.frombuffer(r.packed, "<i8").tolist())
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("user_id", "op_id", "amount_cents", "balance_cents", "segment", "opening_cents")})


def _replay_segment(rows: pd.DataFrame, openings: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(openings):
        return fold(rows.iloc[:0].assign(opening_tier=None, opening_end=None))
    state = openings.iloc[0]
    rows = rows.sort_values(ORDER, ignore_index=True)
    return fold(rows.assign(opening_cents=state["opening_cents"], opening_tier=state["opening_tier"], opening_end=state["opening_end"]), "segment")


def replay_ledger(ops: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Accept / reject each movement in time order per user (K1, K3, K7).

    ``ops``: user_id, op_id, ts, kind ('deposit' | 'withdraw' | 'tier'),
    amount_cents, level (tier name for 'tier' rows).
    ``users``: user_id, opening_cents (default 0).
    """
    spark = ops.sparkSession
    if "level" not in ops.columns:
        ops = ops.withColumn("level", F.lit(None).cast("string"))
    ops = ops.select(F.col("user_id").cast("long").alias("user_id"), F.col("op_id").cast("long").alias("op_id"),
                     F.col("ts").cast("timestamp_ntz").alias("ts"), "kind",
                     F.coalesce(F.col("amount_cents").cast("long"), F.lit(0)).alias("amount_cents"), "level")
    opening = F.lit(0)
    if users is not None:
        ops = ops.join(users.select("user_id", "opening_cents"), "user_id", "left")
        opening = F.coalesce(F.col("opening_cents"), F.lit(0))
    ops = ops.withColumn("opening_cents", opening.cast("long"))
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ops.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).withColumn("__range", F.spark_partition_id())
    path = stage_path(spark, f"replay-{uuid.uuid4().hex[:12]}")
    ranged.mapInPandas(_cut, _CUT).write.partitionBy("what").parquet(path)
    staged = spark.read.schema(_CUT).option("basePath", path).parquet(path)
    result = [f.name for f in REPLAY_SCHEMA.fields]

    segments = staged.where("what = 'segment'").select(*INPUT, "opening_cents", "segment", "need", "total", "packed")
    chain_path = stage_path(spark, f"chain-{uuid.uuid4().hex[:12]}")
    (segments.repartition("user_id").sortWithinPartitions(*ORDER).mapInPandas(_chain, _CHAIN)
     .write.partitionBy("what").parquet(chain_path))
    chained = spark.read.schema(_CHAIN).option("basePath", chain_path).parquet(chain_path)
    openings = chained.where("what = 'segment'").select("segment", "opening_cents", "opening_tier", "opening_end")
    waiting = staged.where("what = 'row'").select(*INPUT, "segment")
    replayed = waiting.groupBy("segment").cogroup(openings.groupBy("segment")).applyInPandas(_replay_segment, REPLAY_SCHEMA)
    return (staged.where("what = 'done'").select(*result).unionByName(chained.where("what = 'done'").select(*result))
            .unionByName(replayed))
