"""The reference's account cases, as table inputs."""

import datetime as dt

from pyspark.sql import functions as F

from demandlake.operators import ledger

T0 = dt.datetime(2025, 3, 1, 10, 0)


def _ops(spark, rows):
    return spark.createDataFrame(
        [(u, i, T0 + dt.timedelta(minutes=i), k, a, lvl) for i, (u, k, a, lvl) in enumerate(rows)],
        "user_id long, op_id long, ts timestamp_ntz, kind string, amount_cents long, level string")


def test_deposit_withdraw_history(spark):
    ops = _ops(spark, [(1, "deposit", 15000, None), (1, "withdraw", 4000, None)])
    out = ledger.replay_ledger(ops).orderBy("user_id", "ts", "op_id").collect()
    assert [r["accepted"] for r in out] == [True, True] and out[-1]["balance_cents"] == 11000
    signed = ops.withColumn("signed_cents", F.when(F.col("kind") == "deposit", F.col("amount_cents"))
                            .otherwise(-F.col("amount_cents")))
    hist = sorted(ledger.history(signed, 5).collect(), key=lambda r: r["position"])
    assert [r["signed_cents"] for r in hist] == [-4000, 15000]      # newest first


def test_rejections(spark):
    ops = _ops(spark, [(1, "deposit", -5000, None), (1, "withdraw", 100, None), (1, "deposit", 0, None),
                       (2, "tier", 0, "diamond")])
    out = {r["op_id"]: r for r in ledger.replay_ledger(ops).orderBy("user_id", "ts", "op_id").collect()}
    assert out[0]["reason"] == "non_positive_deposit"               # negative top-up
    assert out[1]["reason"] == "insufficient_funds"
    assert out[2]["reason"] == "non_positive_deposit"
    assert out[3]["reason"] == "insufficient_funds"                 # diamond without funds


def test_tier_purchase_price_and_end(spark):
    ops = _ops(spark, [(1, "deposit", 30000, None), (1, "tier", 0, "silver"),
                       (2, "deposit", 30000, None), (2, "tier", 0, "gold"), (2, "tier", 0, "silver")])
    out = {r["op_id"]: r for r in ledger.replay_ledger(ops).orderBy("user_id", "ts", "op_id").collect()}
    assert out[1]["tier"] == "silver" and out[1]["balance_cents"] == 20000
    assert out[1]["tier_end"] == T0.date() + dt.timedelta(days=30)
    assert out[3]["tier"] == "gold" and out[4]["reason"] == "tier_step_down"
    prices = spark.createDataFrame([("bronze",), ("gold",)], "tier string").select(
        ledger.request_price(F.col("tier")).alias("p")).collect()
    assert [r["p"] for r in prices] == [20.0, 10.0]


def test_same_tier_extends_and_expiry_resets(spark):
    rows = [(1, 0, T0, "deposit", 100000, None), (1, 1, T0, "tier", 0, "silver"),
            (1, 2, T0 + dt.timedelta(days=10), "tier", 0, "silver"),
            (1, 3, T0 + dt.timedelta(days=100), "withdraw", 0, None)]
    ops = spark.createDataFrame(rows, "user_id long, op_id long, ts timestamp_ntz, kind string, "
                                      "amount_cents long, level string")
    out = {r["op_id"]: r for r in ledger.replay_ledger(ops).orderBy("user_id", "ts", "op_id").collect()}
    assert out[2]["tier_end"] == T0.date() + dt.timedelta(days=60)
    assert out[3]["tier"] == "bronze" and out[3]["tier_end"] is None
    users = spark.createDataFrame([(1, "silver", dt.date(2025, 2, 28)), (2, "gold", dt.date(2025, 3, 5)),
                                   (3, "bronze", None)], "user_id long, tier string, tier_end date")
    swept = {r["user_id"]: (r["tier"], r["tier_end"])
             for r in ledger.expire_tiers(users, F.lit(dt.date(2025, 3, 1))).collect()}
    assert swept == {1: ("bronze", None), 2: ("gold", dt.date(2025, 3, 5)), 3: ("bronze", None)}


def test_bronze_quota_refuses_eleventh_free_request(spark):
    rows = [(i, 1, T0 + dt.timedelta(minutes=i), i == 3) for i in range(12)]
    req = spark.createDataFrame(rows, "request_id long, user_id long, ts timestamp_ntz, paid boolean")
    tiers = spark.createDataFrame([(1, "bronze")], "user_id long, tier string")
    out = {r["request_id"]: r["passes"] for r in ledger.quota(req, tiers).collect()}
    assert all(out[i] for i in range(10)) and not out[10] and not out[11]


def test_running_balance_two_level_equals_window(spark):
    rows = [(u, i, T0 + dt.timedelta(hours=7 * i), (i % 5) * 100 - 150) for u in (1, 2) for i in range(40)]
    ops = spark.createDataFrame(rows, "user_id long, op_id long, ts timestamp_ntz, signed_cents long")
    got = {(r["user_id"], r["op_id"]): r["balance_cents"] for r in ledger.running_balance(ops).collect()}
    for u in (1, 2):
        run = 0
        for i in range(40):
            run += (i % 5) * 100 - 150
            assert got[(u, i)] == run


def test_register_is_idempotent(spark):
    existing = spark.createDataFrame([(1, "ann"), (2, "bob")], "user_id long, username string")
    names = spark.createDataFrame([("bob",), ("cid",), ("abe",), ("cid",)], "username string")
    out = {r["username"]: (r["user_id"], r["created"]) for r in ledger.register_users(existing, names).collect()}
    assert out == {"bob": (2, False), "abe": (3, True), "cid": (4, True)}


def test_request_lifecycle_charge_after_completion(spark):
    ops = _ops(spark, [(1, "deposit", 1000, None)])
    res = spark.createDataFrame([
        (10, 1, T0 + dt.timedelta(hours=1), 5.0, True),    # charged: 10.00 -> 5.00
        (11, 1, T0 + dt.timedelta(hours=2), 10.0, True),   # 5.00 < 10.00: charge fails -> failed
        (12, 1, T0 + dt.timedelta(hours=3), 0.0, True),    # free
        (13, 1, T0 + dt.timedelta(hours=4), 5.0, False),   # not scored -> failed, not charged
    ], "prediction_id long, user_id long, ts timestamp_ntz, cost double, scored boolean")
    out = {r["prediction_id"]: (r["status"], r["charged"]) for r in ledger.request_lifecycle(res, ops).collect()}
    assert out == {10: ("completed", True), 11: ("failed", False), 12: ("completed", None),
                   13: ("failed", None)}


def _brute(rows, opening=0):
    from demandlake.operators.replay import step
    out, state = {}, {}
    for user, op, ts, kind, amount, level in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        balance, tier, end = state.get(user, (opening, "bronze", None))
        ok, why, *after = step(balance, tier, end, kind, amount, level, ts.date())
        state[user] = tuple(after)
        out[user, op] = (ok, why, *after)
    return out


def test_huge_user_is_replayed_in_many_tasks(spark, monkeypatch):
    """One user with a third of all rows, an early refusal, refusals and tier
    purchases all along; short segments, so every path is taken."""
    import random

    from demandlake.operators import replay
    rng = random.Random(1)
    rows = [(7, 0, T0, "withdraw", 500, None)]
    users = [7] * 3000 + [u for u in range(100, 400) for _ in range(20)]
    for i, u in enumerate(users, 1):
        kind = rng.choices(["deposit", "withdraw", "tier", "gift"], [50, 45, 4, 1])[0]
        amount = rng.randint(-50, 9000) if kind != "tier" else 0
        rows.append((u, i, T0 + dt.timedelta(hours=rng.randint(0, 5000)), kind, amount, rng.choice(["silver", "Gold", "diamond", "none"]) if kind == "tier" else None))
    ops = spark.createDataFrame(rows, "user_id long, op_id long, ts timestamp_ntz, kind string, amount_cents long, level string").repartition(6)
    monkeypatch.setattr(replay, "SEGMENT", 64)
    staged = []
    path = replay.stage_path
    monkeypatch.setattr(replay, "stage_path", lambda s, name: (staged.append(path(s, name)), staged[-1])[1])
    out = replay.replay_ledger(ops).collect()
    assert len(out) == len(rows)
    assert {(r["user_id"], r["op_id"]): (r["accepted"], r["reason"], r["balance_cents"], r["tier"], r["tier_end"]) for r in out} == _brute(rows)
    cut = spark.read.parquet(staged[0])
    hot = cut.where("what = 'segment' and user_id = 7")
    assert hot.select((F.col("segment") / 2 ** 40).cast("int")).distinct().count() >= 2      # several ranges
    assert hot.count() >= 3000 / 64
    assert cut.where("what = 'done'").select("user_id").distinct().count() > 250             # short users are done at once
    assert {r["user_id"] for r in cut.where("what = 'done'").select("user_id").distinct().collect()}.isdisjoint({7})


def test_openings_and_repeated_rows(spark):
    rows = [(1, 1, T0, "withdraw", 100, None)] * 3 + [(2, 2, T0, "withdraw", 100, None)]
    ops = spark.createDataFrame(rows, "user_id long, op_id long, ts timestamp_ntz, kind string, amount_cents long, level string")
    users = spark.createDataFrame([(1, 250)], "user_id long, opening_cents long")
    got = sorted((r["user_id"], r["accepted"], r["balance_cents"]) for r in ledger.replay_ledger(ops, users).collect())
    assert got == [(1, False, 50), (1, True, 50), (1, True, 150), (2, False, 0)]
    assert ledger.replay_ledger(ops.limit(0)).count() == 0
