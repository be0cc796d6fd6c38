import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlake.streaming import hourly

SCHEMA = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("zone", T.StringType())])


def test_hourly_stream_drops_late_rows_and_duplicates(spark):
    base = tempfile.mkdtemp(prefix="dl-stream-", dir="/tmp")
    src = os.path.join(base, "in")
    t = dt.datetime(2024, 1, 1)
    first = [(t + dt.timedelta(minutes=10), "A"), (t + dt.timedelta(minutes=20), "A"),
             (t + dt.timedelta(hours=5), "A")]                       # watermark -> 04:00
    second = [(t + dt.timedelta(minutes=20), "A"),                   # late: its hour closed at 01:00
              (t + dt.timedelta(hours=5, minutes=1), "A"), (t + dt.timedelta(hours=5, minutes=1), "A"),
              (t + dt.timedelta(hours=9), "A")]                      # moves the watermark past 06:00
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(os.path.join(src, "b1"))
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(os.path.join(src, "b2"))
    trips = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
             .option("recursiveFileLookup", True).parquet(src)
             .select(F.col("ts").cast("timestamp").alias("pickup"), F.col("zone").alias("location_id")))
    hourly.run_hourly(spark, trips, os.path.join(base, "out"), os.path.join(base, "ckpt"), "1 hour")
    got = {(r["hour"], r["location_id"]): r["trips_count"] for r in hourly.hourly_table(spark, os.path.join(base, "out")).collect()}
    assert got[(0, "A")] == 2            # the late copy of 00:20 is not counted again
    assert got[(5, "A")] == 2            # 05:00 and one of the two identical 05:01 rows
    assert got[(9, "A")] == 1            # the last hour is there although nothing came after it


def test_request_stream_parses_and_nulls_bad_fields(spark):
    from demandlake.streaming.requests import request_stream
    base = tempfile.mkdtemp(prefix="dl-msgs-", dir="/tmp")
    src = os.path.join(base, "queue")
    os.makedirs(src)
    with open(os.path.join(src, "m1.json"), "w") as fh:
        fh.write('{"prediction_id": 7, "user_id": 1, "model": "m", "district": "A", "hour": 3, '
                 '"city": "NYC", "cost": 0, "year": 2024, "month": 1, "day": 2}\n')
        fh.write('{"prediction_id": 8, "user_id": "oops", "hour": 25}\n')
    q = (request_stream(spark, src).writeStream.format("memory").queryName("msgs_test")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = {r["prediction_id"]: r for r in spark.sql("select * from msgs_test").collect()}
    assert rows[7]["district"] == "A" and rows[7]["day"] == 2
    assert rows[8]["hour"] == 25 and rows[8]["district"] is None


def test_scoring_stream_results_are_whole_forecasts(spark):
    import json
    import __spark_entry__ as ent
    from data_sets import SF_SMALL
    rows = ent.queries()["stream_request_scoring"](spark, SF_SMALL).collect()
    done = [r for r in rows if r["result"] is not None]
    assert any(r["status"] == "completed" for r in done)
    assert done and len({r["prediction_id"] for r in rows}) == len(rows)     # one row per request
    for r in done:
        vals = json.loads(r["result"])
        assert len(vals) == 24 and all(isinstance(v, int) and v >= 0 for v in vals)
        assert r["n_prices"] == (24 if r["cost"] > 0 else 0)            # priced only when it costs something
        assert r["status"] == ("failed" if r["charged"] == 0 else "completed")
    assert all(r["status"] == "failed" for r in rows if r["result"] is None)


def _published(spark, published):
    return {(r["location_id"], str(r["date"]), r["hour"]): (r["trips_count"], r["version"]) for r in hourly.live(spark, published).collect()}


def _trips(spark, *rows):
    return spark.createDataFrame([(dt.datetime(2024, 1, *r[:3]), r[3]) for r in rows], "pickup timestamp, location_id string")


def test_publish_survives_replays_and_half_written_versions(spark, monkeypatch):
    published = os.path.join(tempfile.mkdtemp(prefix="dl-publish-"), "p")
    first = spark.createDataFrame([(dt.date(2024, 1, 1), 1, "A", 5, 1), (dt.date(2024, 1, 2), 1, "A", 6, 1)],
                                  "date date, hour int, location_id string, trips_count long, version int")
    hourly.publish_dates(first, published, 1)
    batch = _trips(spark, (2, 1, 0, "A"), (2, 1, 1, "A"), (3, 4, 0, "B"))
    want = {("A", "2024-01-01", 1): (5, 1), ("A", "2024-01-02", 1): (2, 2), ("B", "2024-01-03", 4): (1, 2)}

    # the write succeeds, the commit does not: readers still see version 1, the replay then publishes
    writes = type(first.write).parquet

    def no_commit(self, path, *a, **kw):
        if path.endswith("manifest"):
            raise RuntimeError("lost before the commit")
        return writes(self, path, *a, **kw)

    with monkeypatch.context() as m:
        m.setattr(type(first.write), "parquet", no_commit)
        try:
            hourly.publish_epoch(batch, published, 0)
            raise AssertionError
        except RuntimeError:
            pass
    assert _published(spark, published) == {("A", "2024-01-01", 1): (5, 1), ("A", "2024-01-02", 1): (6, 1)}
    hourly.publish_epoch(batch, published, 0)
    assert _published(spark, published) == want
    hourly.publish_epoch(batch, published, 0)                    # replayed after the commit
    assert _published(spark, published) == want
    hourly.publish_epoch(_trips(spark, (2, 5, 0, "A")), published, 1)
    hourly.publish_epoch(_trips(spark, (2, 5, 0, "A")), published, 1)
    assert _published(spark, published) == want | {("A", "2024-01-02", 5): (1, 3)}
    touched = [r["date"] for r in spark.read.parquet(os.path.join(published, "manifest")).where("version = 3").collect()]
    assert {str(d) for d in touched} == {"2024-01-02"}           # only touched dates are rewritten


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _inbox(base):
    os.makedirs(os.path.join(base, "in"))
    return os.path.join(base, "in")


def test_publish_adds_up_over_batches(spark):
    """Ten and three trips of one hour in two files, one of them delivered
    twice and one in both files; then an hour of an earlier date again."""
    base = tempfile.mkdtemp(prefix="dl-publish-")
    t = dt.datetime(2024, 1, 2, 1)
    published = os.path.join(base, "p")
    first = spark.createDataFrame([(dt.date(2024, 1, 2), 1, "A", 99, 1), (dt.date(2024, 1, 2), 0, "A", 4, 1)],
                                  "date date, hour int, location_id string, trips_count long, version int")
    hourly.publish_dates(first, published, 1)
    ten = [(t + dt.timedelta(minutes=i), "A") for i in range(10)]
    three = [(t + dt.timedelta(minutes=20 + i), "A") for i in range(3)]
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(_inbox(base))
    trips = raw.select(F.col("ts").cast("timestamp").alias("pickup"), F.col("zone").alias("location_id"))
    seen = []
    for rows in (ten + ten[:1], three + ten[:1], [(t + dt.timedelta(hours=5), "B")], [(t + dt.timedelta(minutes=50), "A")]):
        _write(spark, os.path.join(base, "in"), rows, SCHEMA)
        hourly.run_incremental_publish(spark, trips, published, os.path.join(base, "ck"), "1 day")
        seen.append({k: v[0] for k, v in _published(spark, published).items()})
    hour, other, later = ("A", "2024-01-02", 1), ("A", "2024-01-02", 0), ("B", "2024-01-02", 6)
    assert [s[hour] for s in seen] == [10, 13, 13, 14]
    assert all(s[other] == 4 for s in seen) and seen[-1][later] == 1
    folders = os.listdir(os.path.join(published, "data"))
    assert len([f for f in folders if f.startswith("folder=")]) <= 3            # replaced folders are removed


def test_increments_are_folded_and_replays_change_nothing(spark):
    from demandlake.streaming.increments import Increments
    path = tempfile.mkdtemp(prefix="dl-increments-")
    keys = T.StructType([T.StructField("k", T.LongType())])
    counts = Increments(spark, path, keys, "n", fold=5)

    def batch(epoch):
        return spark.createDataFrame([(epoch % 3, 1), (7, epoch)], "k long, n long").coalesce(1)

    def table(before=None, where=None):
        return {r["k"]: r["n"] for r in counts.total(before, where).collect()}

    want = {}
    for epoch in range(23):
        counts.write(epoch, batch(epoch))
        want[epoch % 3] = want.get(epoch % 3, 0) + 1
        want[7] = want.get(7, 0) + epoch
        counts.write(epoch, batch(epoch))                         # replayed, also right after a fold
        assert table() == want
        assert len([f for f in os.listdir(path) if f.startswith("epoch=")]) <= 11
    assert len([f for f in os.listdir(os.path.join(path, "folded")) if not f.startswith(".")]) <= 2
    counts.write(22, batch(22).where("k = 7"))                    # a replay with another outcome replaces the first
    assert table()[22 % 3] == want[22 % 3] - 1
    assert table(22)[7] == want[7] - 22 and table(where=F.col("k") == 7) == {7: want[7]}
    assert Increments(spark, path + "-none", keys, "n").total().count() == 0


def test_folders_stay_bounded_over_200_epochs(spark):
    from demandlake.streaming.increments import FOLD, Increments
    path = tempfile.mkdtemp(prefix="dl-increments-")
    counts = Increments(spark, path, T.StructType([T.StructField("k", T.LongType())]), "n")
    one = spark.createDataFrame([(1, 1)], "k long, n long").coalesce(1).persist()
    for epoch in range(200):
        counts.write(epoch, one)
    assert counts.total().first()["n"] == 200
    assert len(os.listdir(path)) <= 2 * FOLD + 2


def test_quota_over_several_batches(spark):
    from demandlake.streaming import quota
    base = tempfile.mkdtemp(prefix="dl-quota-")
    schema = "request_id long, user_id long, ts timestamp, paid boolean"
    tiers = spark.createDataFrame([(7, "Bronze"), (8, "diamond")], "user_id long, tier string")
    d2, d1 = dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 1, 1)

    def requests(ids, day, user=7, paid=False):
        return [(i, user, day + dt.timedelta(minutes=i % 60), paid) for i in ids]

    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_inbox(base))
    parts = [requests(range(8), d2) + requests([900], d2, paid=True),            # nine of day 2, one of them paid
             requests(range(100, 101), d1) + requests(range(3), d2),             # a late one of day 1, three delivered again
             requests(range(10, 20), d2) + requests(range(200, 230), d2, user=8) + requests(range(300, 312), d2, user=9),
             requests([901], d2, paid=True)]
    for rows in parts:
        _write(spark, os.path.join(base, "in"), rows, schema)
        out = quota.run_quota(spark, raw, tiers, base, os.path.join(base, "ck"), "3 days")
    got = {r["request_id"]: r["passes"] for r in out.collect()}
    assert len(got) == out.count() == 8 + 1 + 1 + 10 + 30 + 12 + 1
    assert [i for i in range(20) if got.get(i)] == [*range(8), 10]              # room for one more after nine
    assert got[100] and got[900] and got[901] and all(got[i] for i in range(200, 230))
    assert [i for i in range(300, 312) if got[i]] == list(range(300, 310))      # an unknown user is bronze


def test_ledger_state_over_several_batches(spark):
    """Out of order over batches, delivered again, late, with a tick at the
    end: what is decided equals the batch replay."""
    import random

    from demandlake.operators import ledger
    from demandlake.streaming import balances
    base = tempfile.mkdtemp(prefix="dl-ledger-")
    rng = random.Random(3)
    schema = "user_id long, op_id long, ts timestamp, kind string, amount_cents long, level string"
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        kind = rng.choices(["deposit", "withdraw", "tier", "gift"], [50, 40, 9, 1])[0]
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, t + dt.timedelta(minutes=rng.randint(0, 5 * 1440)), kind,
                     0 if kind == "tier" else rng.randint(-50, 40000), rng.choice(["silver", "gold"]) if kind == "tier" else None))
    batches = [[] for _ in range(7)]
    for r in rows:
        day = (r[2] - t).days
        batches[day + (r[1] % 3 == 0)].append(r)                 # a third comes a day late
        if r[1] % 4 == 0:
            batches[day + 1].append(r)                           # delivered again
    batches[6] += [(1, 9000, t + dt.timedelta(days=1), "deposit", 10 ** 6, None), (None, 9001, t + dt.timedelta(days=5), "deposit", 5, None),
                   rows[0]]                                      # late, without a user, late copy
    batches.append([(None, None, t + dt.timedelta(days=60), "tick", 0, None)])
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_inbox(base))
    decided = []
    for part in batches:
        _write(spark, os.path.join(base, "in"), part, schema)
        out = balances.run_ledger(spark, raw, os.path.join(base, "out"), os.path.join(base, "ck"), "2 days")
        decided.append(out.count())
    assert decided[0] == 0 and 0 < decided[4] < decided[5] < 400 and decided[-1] == 400     # decided as the watermark passes
    ops = spark.createDataFrame(rows, schema)
    names = ["user_id", "op_id", "accepted", "reason", "balance_cents", "tier", "tier_end"]
    want = ledger.replay_ledger(ops).select(*names).collect()
    assert sorted(map(tuple, out.select(*names).collect()), key=str) == sorted(map(tuple, want), key=str)


def test_ledger_state_keys_do_not_grow_with_the_users(spark):
    """Users share state keys, so the calls of the processor are bounded; what
    is decided stays that of every user alone."""
    from demandlake.operators import ledger
    from demandlake.streaming import balances
    base = tempfile.mkdtemp(prefix="dl-ledger-")
    schema = "user_id long, op_id long, ts timestamp, kind string, amount_cents long, level string"
    t, far = dt.datetime(2024, 1, 1), 2 ** 60
    rows = [(far + u, far + 3 * u + i, t + dt.timedelta(hours=(u * 7 + i * 11) % 48), kind, amount, None)
            for u in range(200) for i, (kind, amount) in enumerate([("deposit", 500), ("withdraw", 300), ("withdraw", 400)])]
    batches = [rows[::2] + [(far, None, t, "deposit", 9, None)], rows[1::2] + rows[::10] + [(None, far, t, "deposit", 9, None)],
               [(None, None, t + dt.timedelta(days=60), "tick", 0, None)]]
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_inbox(base))
    for part in batches:
        _write(spark, os.path.join(base, "in"), part, schema)
        out = balances.run_ledger(spark, raw, os.path.join(base, "out"), os.path.join(base, "ck"), "3 days", buckets=4)
    keys = spark.read.format("statestore").option("stateVarName", "accounts").load(os.path.join(base, "ck"))
    assert 0 < keys.count() <= 4
    names = ["user_id", "op_id", "accepted", "reason", "balance_cents"]
    want = ledger.replay_ledger(spark.createDataFrame(rows, schema)).select(*names).collect()
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(map(tuple, want))
