"""Models by name and the message queue."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlake.operators import models
from demandlake.sources import queue
from demandlake.sources.registry import ModelRegistry
from demandlake.streaming.requests import MESSAGE_SCHEMA, last_value_model


def constant(value):
    return lambda x: np.full((len(x), 24), float(value))


def test_versions_are_kept_and_switched(spark):
    registry = ModelRegistry(spark, tempfile.mkdtemp(prefix="dl-registry-"))
    assert registry.current() == {} and registry.ship().files == {}
    assert [registry.publish("a", constant(1)), registry.publish("a", constant(2)), registry.publish("b", last_value_model)] == [1, 2, 1]
    assert registry.current() == {"a": 2, "b": 1}
    first = registry.ship()
    registry.use("a", 1)
    assert registry.current()["a"] == 1 and registry.versions("a") == [1, 2]
    assert first.model("a")(np.zeros((1, 72, 24)))[0, 0] == 2            # a job keeps what it started with
    assert registry.ship().model("a")(np.zeros((1, 72, 24)))[0, 0] == 1
    assert registry.publish("a", constant(3)) == 3                       # never an old number again
    for bad in ("../a", "", "a/b"):
        with pytest.raises(ValueError):
            registry.publish(bad, constant(0))
    with pytest.raises(ValueError):
        registry.use("a", 9)


def test_two_publishers_get_two_versions(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="dl-registry-")
    one, two = ModelRegistry(spark, path), ModelRegistry(spark, path)
    seen = two.versions
    one.publish("m", constant(1))
    calls = []
    monkeypatch.setattr(two, "versions", lambda name: (calls.append(1), [] if len(calls) == 1 else seen(name))[1])   # looked before the other published
    assert two.publish("m", constant(2)) == 2 and one.current() == {"m": 2}


def test_rows_go_to_the_model_they_name(spark):
    registry = ModelRegistry(spark, tempfile.mkdtemp(prefix="dl-registry-"))
    registry.publish("one", constant(1))
    registry.publish("last", last_value_model)
    window = [[float(i)] + [0.0] * 23 for i in range(72)]
    names = ["one", "last", None, "gone", "one", "last"]
    rows = spark.createDataFrame([(i, n, window) for i, n in enumerate(names)], "request_id long, model string, x array<array<double>>").repartition(2)
    out = {r["request_id"]: r for r in models.score_by_name(rows, registry.ship()).collect()}
    assert [out[i]["model_status"] for i in range(6)] == ["ok", "ok", "unknown_model", "unknown_model", "ok", "ok"]
    assert [out[i]["forecast"] and out[i]["forecast"][0] for i in range(6)] == [1.0, 71.0, None, None, 1.0, 71.0]
    assert models.score_by_name(rows.limit(0), registry.ship()).count() == 0


def test_price_table(spark):
    train = spark.createDataFrame([("A", 1, 1, 3.0), ("A", 1, 2, 5.0), ("A", 2, 4, 7.0), ("A", 2, 4, 8.0), ("A", 3, None, 1.0)],
                                  "location_id string, hour int, trips_count long, avg_cost_per_mile double")
    lines = {(r["location_id"], r["hour"]): (r["slope"], r["intercept"]) for r in models.fit_cost_lines(train).collect()}
    assert lines == {("A", 1): (2.0, 1.0), ("A", 2): (0.0, 7.5)}


# --- queue ------------------------------------------------------------------------

def message(i, model="m"):
    return (i, 1, model, "A", 3, "NYC", 1.5, 2024, 1, 2)


def collect(spark, path, out, checkpoint, fail_at=None, consumer="default"):
    def sink(batch, epoch):
        if epoch == fail_at:
            raise RuntimeError("lost before the commit")
        batch.select("prediction_id").write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    q = (spark.readStream.format(queue.register(spark)).schema(MESSAGE_SCHEMA).option("path", path).option("consumer", consumer).load()
         .writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def send(spark, path, ids):
    rows = spark.createDataFrame([message(i) for i in ids], MESSAGE_SCHEMA).repartition(2)
    rows.write.format(queue.register(spark)).mode("append").option("path", path).save()


def ids(spark, out):
    return sorted(r[0] for r in spark.read.schema("prediction_id long").parquet(out).collect())


def test_delivery_again_until_the_sink_has_finished(spark):
    base = tempfile.mkdtemp(prefix="dl-queue-")
    path, out, ck = (os.path.join(base, x) for x in ("q", "out", "ck"))
    send(spark, path, range(5))
    collect(spark, path, out, ck)
    assert ids(spark, out) == list(range(5))
    send(spark, path, range(5, 9))
    with pytest.raises(Exception, match="lost before the commit"):
        collect(spark, path, out, ck, fail_at=1)
    assert ids(spark, out) == list(range(5))
    send(spark, path, range(9, 12))
    collect(spark, path, out, ck)                                    # the failed epoch is delivered again
    assert ids(spark, out)[:9] == list(range(9))
    collect(spark, path, out, ck)                                    # and what came since
    assert ids(spark, out) == list(range(12))
    collect(spark, path, out, ck)
    assert ids(spark, out) == list(range(12))                        # nothing is delivered twice to a sink that keeps epochs
    # a lost checkpoint: delivery goes on from the last acknowledged entry
    send(spark, path, [12])
    collect(spark, path, os.path.join(base, "out2"), os.path.join(base, "ck2"))
    again = ids(spark, os.path.join(base, "out2"))
    assert again[-1] == 12 and set(again) <= set(range(9, 13))
    collect(spark, path, os.path.join(base, "out3"), os.path.join(base, "ck3"), consumer="other")
    assert ids(spark, os.path.join(base, "out3")) == list(range(13))  # another consumer has a pointer of its own


def test_odd_lines_and_unfinished_writes(spark):
    base = tempfile.mkdtemp(prefix="dl-queue-")
    path = os.path.join(base, "q")
    send(spark, path, [1])
    os.makedirs(os.path.join(path, "data"), exist_ok=True)
    with open(os.path.join(path, "data", "orphan.jsonl"), "w") as f:
        f.write('{"prediction_id": 99}\n')                           # no entry names it
    with open(os.path.join(path, "data", "odd.jsonl"), "w") as f:
        f.write('{"prediction_id": 2, "user_id": "oops", "hour": 25}\nnot json\n[3]\n{"prediction_id": 4, "cost": 1}')
    with open(os.path.join(path, "log", "7"), "w") as f:
        f.write("data/odd.jsonl")
    q = (spark.readStream.format(queue.register(spark)).schema(MESSAGE_SCHEMA).option("path", path).load()
         .writeStream.format("memory").queryName("odd_lines").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.sql("select prediction_id, user_id, hour, cost from odd_lines").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 1, 3, 1.5), (2, None, 25, None), (None,) * 4, (None,) * 4, (4, None, None, 1.0)], key=str)


def test_stream_writes_each_epoch_once(spark):
    base = tempfile.mkdtemp(prefix="dl-queue-")
    path, src = os.path.join(base, "q"), os.path.join(base, "in")
    for k in range(2):
        spark.createDataFrame([message(i) for i in range(k * 3, k * 3 + 3)], MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        q = (spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).writeStream.format(queue.register(spark))
             .option("path", path).option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    assert sorted(os.listdir(os.path.join(path, "log"))) == ["0", "1"]
    writer = queue.QueueStreamWriter({"path": path})
    writer.commit([queue.Written(["data/again.jsonl"])], 1)          # the commit of an epoch again
    collect(spark, path, os.path.join(base, "out"), os.path.join(base, "ck2"))
    assert ids(spark, os.path.join(base, "out")) == list(range(6))
    assert spark.read.schema("prediction_id long").parquet(os.path.join(base, "out")).where(F.col("prediction_id").isNull()).count() == 0
