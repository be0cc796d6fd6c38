"""Accounts: ledger replay, tiers, prices, daily quotas, expiry, registration,
activity (K1-K9, D12, B13).

Money is kept in integer cents, so running balances are exact and
independent of the order in which partial sums are added.

The ledger replay (K1, K3) is in ``replay``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlake.operators.ordered import blocked_running_sum, top_n_per_key
from demandlake.operators.replay import REPLAY_SCHEMA, TIER_DAYS, TIER_PRICE, replay_ledger

__all__ = ["REPLAY_SCHEMA", "TIER_DAYS", "TIER_PRICE", "replay_ledger", "running_balance", "history", "owner_lookup", "owner_lookups",
           "quota", "affordability", "expire_tiers", "register_users", "monthly_active", "retention", "request_lifecycle",
           "request_price", "tier_price", "daily_quota"]

# Request prices, daily quotas.
REQUEST_PRICE = {"bronze": 20.0, "silver": 15.0, "gold": 10.0, "diamond": 5.0}
DAILY_QUOTA = {"bronze": 10, "silver": 100, "gold": 1000}  # diamond: unlimited
HISTORY_DEFAULT = 5


def _map_expr(mapping: dict, key: Column, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def request_price(tier: Column) -> Column:
    """Price of one paid request by tier (K4); unknown tiers pay the
    lowest-tier price like the reference's fall-through."""
    return _map_expr(REQUEST_PRICE, F.lower(tier), REQUEST_PRICE["diamond"])


def tier_price(tier: Column) -> Column:
    return _map_expr(TIER_PRICE, F.lower(tier))


def daily_quota(tier: Column) -> Column:
    """Requests allowed per UTC day; null = unlimited (diamond)."""
    return _map_expr(DAILY_QUOTA, F.lower(tier))


def running_balance(ops: DataFrame, signed_cents: str = "signed_cents") -> DataFrame:
    """Cumulative signed sum per user in (ts, op_id) order (K2), computed in
    two levels (per user-day, then over day totals) so a user with a huge
    history is not one task."""
    return blocked_running_sum(ops, ["user_id"], ["ts", "op_id"], signed_cents,
                               F.to_date("ts"), out="balance_cents")


def history(df: DataFrame, n: int | None = HISTORY_DEFAULT, key: str = "user_id",
            ts: str = "ts", tie: str = "op_id") -> DataFrame:
    """Newest-first history, n per user; 0 / None means the default 5."""
    n = n or HISTORY_DEFAULT
    return top_n_per_key(df, [key], [F.col(ts).desc(), F.col(tie).desc()], n, out="position")


def owner_lookup(df: DataFrame, user_id: int, item_id: int, key: str = "user_id",
                 id_col: str = "op_id") -> DataFrame:
    """Owner-scoped point lookup: nothing when the item belongs to another
    user (B13)."""
    return df.where((F.col(key) == user_id) & (F.col(id_col) == item_id))


def owner_lookups(df: DataFrame, wanted: DataFrame, key: str = "user_id", id_col: str = "op_id") -> DataFrame:
    """Many owner-scoped lookups at once: the rows of ``df`` that ``wanted``
    (owner, item) asks for and owns (B13)."""
    return df.join(wanted.select(key, id_col).distinct(), [key, id_col], "left_semi")


# --- K5/K6 quotas and affordability ----------------------------------------

MAX_QUOTA = max(DAILY_QUOTA.values())


def quota(requests: DataFrame, tiers: DataFrame, ts: str = "ts", paid: str = "paid",
          req_id: str = "request_id") -> DataFrame:
    """Daily quota by UTC day (K5).  Every request counts (paid ones too);
    only free ones are checked; a free request passes iff it is among the
    first ``quota(tier)`` requests of its user and day.  Diamond is
    unlimited.  A redelivered request id counts once.

    Only positions up to the largest quota of the tier table matter, so the
    rank is computed with ``row_number() <= MAX_QUOTA`` (a per-task group
    limit before the shuffle) and joined back on the request id; no request
    is dropped by it.
    """
    requests = requests.dropDuplicates([req_id])
    r = requests.withColumn("day", F.to_date(F.col(ts)))
    first = top_n_per_key(r.select(req_id, "user_id", "day", ts), ["user_id", "day"],
                          [F.col(ts), F.col(req_id)], MAX_QUOTA, out="rn").select(req_id, "rn")
    out = r.join(tiers.select("user_id", "tier"), "user_id", "left").join(first, req_id, "left")
    limit = daily_quota(F.coalesce(F.col("tier"), F.lit("bronze")))
    passes = F.col(paid) | limit.isNull() | (F.col("rn").isNotNull() & (F.col("rn") <= limit))
    return out.withColumn("passes", passes).drop("rn")


def affordability(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Paid request affordable at submission: price by tier <= balance (K6)."""
    j = requests.join(users.select("user_id", "tier", "balance_cents"), "user_id", "left")
    price = request_price(F.coalesce(F.col("tier"), F.lit("bronze")))
    return j.withColumns({"price": price,
                          "affordable": (price * 100 <= F.coalesce(F.col("balance_cents"), F.lit(0)))})


def expire_tiers(users: DataFrame, today: Column) -> DataFrame:
    """Expiry sweep (K7): end before today and not bronze -> bronze, no end."""
    expired = (F.col("tier_end") < today) & (F.col("tier") != "bronze") & F.col("tier_end").isNotNull()
    return users.withColumns({
        "tier": F.when(expired, F.lit("bronze")).otherwise(F.col("tier")),
        "tier_end": F.when(expired, F.lit(None).cast("date")).otherwise(F.col("tier_end")),
    })


def register_users(existing: DataFrame, names: DataFrame, name_col: str = "username") -> DataFrame:
    """Idempotent registration (K8): a known name returns its existing row;
    new names get ids after the current maximum, in name order (dense
    ordinal computed without a single-task window)."""
    from demandlake.operators.ordered import dense_ordinal
    names = names.select(name_col).distinct()
    old = existing.join(names, name_col, "left_semi").select("user_id", name_col,
                                                            F.lit(False).alias("created"))
    fresh = names.join(existing.select(name_col), name_col, "left_anti")
    # the current maximum id is one number (an autoincrement counter)
    base = existing.agg(F.coalesce(F.max("user_id"), F.lit(0))).first()[0]
    ranked = dense_ordinal(fresh, name_col, out="_ord")
    new = ranked.select((F.lit(base) + F.col("_ord")).cast("bigint").alias("user_id"), name_col,
                        F.lit(True).alias("created"))
    return old.unionByName(new)


def monthly_active(activity: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Distinct active users per month (K9)."""
    return (activity.groupBy(F.date_trunc("month", F.col(ts)).cast("date").alias("month"))
            .agg(F.countDistinct(user).alias("active_users")))


def retention(activity: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Cohort retention (K9): users first active in month m still active
    k months later.  Works on the (user, month) table, deduplicated first."""
    um = activity.select(user, F.date_trunc("month", F.col(ts)).cast("date").alias("month")).distinct()
    first = um.groupBy(user).agg(F.min("month").alias("cohort"))
    j = um.join(first, user)
    k = (F.months_between(F.col("month"), F.col("cohort"))).cast("int")
    cohort_size = first.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    out = j.groupBy("cohort", k.alias("months_since")).agg(F.count(F.lit(1)).alias("active_users"))
    return (out.join(cohort_size, "cohort")
            .withColumn("retention", F.col("active_users") / F.col("cohort_size")))


def request_lifecycle(results: DataFrame, ops: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Final status of processed requests.

    ``results``: prediction_id, user_id, ts (processing time), cost (price,
    0 = free), scored (bool: a forecast was produced).  A scored paid
    request is charged after completion: the charge is a withdrawal that
    enters the user's ledger at its processing time and goes through the
    same replay as every other movement.  A rejected charge marks the
    request failed while its result stays; an unscored request is failed.
    """
    charges = results.where(F.col("scored") & (F.col("cost") != 0)).select(
        "user_id", (-F.col("prediction_id") - 1).alias("op_id"), "ts",
        F.lit("withdraw").alias("kind"), F.floor(F.col("cost") * 100 + 0.5).cast("bigint").alias("amount_cents"),
        F.lit(None).cast("string").alias("level"))
    base = ops.select("user_id", "op_id", "ts", "kind", "amount_cents",
                      (F.col("level") if "level" in ops.columns else F.lit(None).cast("string")).alias("level"))
    replay = replay_ledger(base.unionByName(charges), users).where(F.col("op_id") < 0).select(
        (-F.col("op_id") - 1).alias("prediction_id"), F.col("accepted").alias("charged"),
        F.col("balance_cents").alias("balance_after_cents"))
    out = results.join(replay, "prediction_id", "left")
    status = (F.when(~F.col("scored"), F.lit("failed"))
              .when((F.col("cost") != 0) & ~F.coalesce(F.col("charged"), F.lit(False)), F.lit("failed"))
              .otherwise(F.lit("completed")))
    return out.withColumn("status", status)
