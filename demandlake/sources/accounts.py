"""Account tables (A16) and their driver-data mapping.

Reference tables: users (id, username, tier, balance, tier end), balance
movements (signed amount, timestamp) and predictions (requests).  The test
data has no accounts, so they are derived:

* users     <- customer: user_id = c_custkey, username = c_name; the tier
               held follows the account balance (thresholds below) with an
               end date 1 day per 100 of balance after 2024-01-01;
               balance_cents = c_acctbal in cents.
* movements <- orders: user = o_custkey, id = o_orderkey, time = o_orderdate;
               status F = deposit, O = withdrawal, P = tier purchase with the
               level by priority; amount = o_totalprice / 100 (in cents).
* requests  <- events: request_id = event_id, user_id, ts; purchases are
               paid requests, other events free ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the mapping.
TIER_BY_BALANCE = ((8000.0, "diamond"), (5000.0, "gold"), (2000.0, "silver"))
LEVEL_BY_PRIORITY = (("1-URGENT", "diamond"), ("2-HIGH", "gold"), ("3-MEDIUM", "silver"))
TIER_EPOCH = "2024-01-01"


def cents(x) -> F.Column:
    """Money in integer cents (half up)."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def users(customer: DataFrame) -> DataFrame:
    bal = F.col("c_acctbal")
    tier = F.lit("bronze")
    for threshold, name in reversed(TIER_BY_BALANCE):
        tier = F.when(bal >= threshold, F.lit(name)).otherwise(tier)
    end = F.date_add(F.to_date(F.lit(TIER_EPOCH)), F.floor(bal / 100).cast("int"))
    return customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
        tier.alias("tier"), F.when(tier != "bronze", end).alias("tier_end"),
        cents(bal).alias("balance_cents"), F.lit(0).cast("bigint").alias("opening_cents"))


def movements(orders: DataFrame, with_tiers: bool = True) -> DataFrame:
    status = F.col("o_orderstatus")
    level = F.lit("bronze")
    for prio, name in reversed(LEVEL_BY_PRIORITY):
        level = F.when(F.col("o_orderpriority") == prio, F.lit(name)).otherwise(level)
    if with_tiers:
        kind = (F.when(status == "F", F.lit("deposit")).when(status == "O", F.lit("withdraw"))
                .otherwise(F.lit("tier")))
    else:
        kind = F.when(status == "F", F.lit("deposit")).otherwise(F.lit("withdraw"))
    amount = cents(F.col("o_totalprice") / 100.0)
    return orders.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("op_id"),
        F.col("o_orderdate").alias("ts"), kind.alias("kind"), amount.alias("amount_cents"),
        F.when(kind == "tier", level).alias("level"),
        F.when(kind == "deposit", amount).otherwise(-amount).alias("signed_cents"))


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("request_id"), "user_id", "ts",
                         (F.col("event_type") == "purchase").alias("paid"))
