import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandlake.operators import ordered

T0 = dt.datetime(2024, 1, 1)


def _rows(spark):
    rows = [(u, i, T0 + dt.timedelta(minutes=37 * i + u), (i * 7) % 11 - 5)
            for u in (1, 2, 3) for i in range(300 if u == 1 else 20)]   # user 1 is hot
    return spark.createDataFrame(rows, "user_id long, op_id long, ts timestamp_ntz, v long")


def test_blocked_running_sum_equals_window(spark):
    df = _rows(spark)
    got = ordered.blocked_running_sum(df, ["user_id"], ["ts", "op_id"], "v", F.to_date("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "op_id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    j = got.join(ref, ["user_id", "op_id"])
    assert j.where(F.col("running") != F.col("ref")).count() == 0


def test_dense_ordinal_over_several_ranges(spark):
    names = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)] * 2, "name string")
    out = sorted((r["name"], r["ordinal"]) for r in ordered.dense_ordinal(names, "name", partitions=7).collect())
    assert [o for _, o in out] == list(range(1, 501))


def test_top_n_per_key_keeps_first_n(spark):
    df = _rows(spark)
    top = ordered.top_n_per_key(df, ["user_id"], [F.col("ts").desc(), F.col("op_id").desc()], 5)
    got = {(r["user_id"], r["rank"]): r["op_id"] for r in top.collect()}
    assert got[(1, 1)] == 299 and got[(1, 5)] == 295 and len(got) == 15
