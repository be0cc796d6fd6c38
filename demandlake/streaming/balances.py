"""Streaming ledger (L3): balance and tier of every user as state.

Movements arrive out of order and may be delivered again.  They wait in the
state until the watermark has passed their time, when no earlier one can
arrive any more, and are then decided in (time, id) order of their user by the
rule of the batch replay (``replay.step``).

A state key is a bucket of users (by a hash of the user id; ``BUCKETS``, fixed
for a checkpoint), since a call of the processor and each of its state reads
cost about a millisecond, whatever they carry: users share them.  State per
bucket (RocksDB store): the accounts of its users (balance, tier, end of the
tier), the waiting movements, both as Arrow data, and the time of the timer.
An event-time timer per bucket, set to its earliest waiting movement, wakes the
bucket up.  What waits is bounded by what its users move within the delay;
decided movements leave the state.

Defined results: a movement that is delivered again while the first copy waits
counts once (same id); one that arrives behind the watermark is late and
dropped, be it a copy or not - its first copy, if there was one, has been
decided; movements with a null user, id or time are ignored; a 'tick' row
only moves the watermark.  Each decided movement is written once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from demandlake.operators.replay import REPLAY_SCHEMA, step

INPUT = ("user_id", "op_id", "ts", "kind", "amount_cents", "level", "opening_cents")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


BUCKETS = 512  # of users; the state keys

_ACCOUNTS = pa.schema([("user_id", pa.int64()), ("balance", pa.int64()), ("tier", pa.string()), ("tier_end", pa.date32())])
_WAITING = pa.schema([("user_id", pa.int64()), ("op_id", pa.int64()), ("ts", pa.int64()), ("kind", pa.string()),
                      ("amount_cents", pa.int64()), ("level", pa.string())])


def _micros(ts: pd.Series) -> np.ndarray:
    return pd.to_datetime(ts).astype("datetime64[us]").astype("int64").to_numpy()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(bytes(b)).read_all() for b in blobs]])


class Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accounts = handle.getValueState("accounts", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.timer = handle.getValueState("timer", "at long")

    def _accounts(self) -> dict[int, tuple]:
        """user -> (balance, tier, end of the tier)"""
        held = self.accounts.get() if self.accounts.exists() else None
        columns = _unpacked([held[0]] if held else [], _ACCOUNTS).to_pydict()
        return dict(zip(columns["user_id"], zip(columns["balance"], columns["tier"], columns["tier_end"])))

    def _keep(self, accounts: dict[int, tuple]) -> None:
        columns = [list(accounts), *map(list, zip(*accounts.values()))]
        self.accounts.update((_packed(pa.table(columns, schema=_ACCOUNTS)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        wake, openings = None, {}
        for pdf in rows:
            pdf = pdf[pdf["kind"] != "tick"]
            if not len(pdf):
                continue
            pdf = pdf.assign(ts=_micros(pdf["ts"]))
            new = pdf[pdf["ts"] > passed]
            if not len(new):
                continue
            columns = [pa.array(new[f.name], f.type, from_pandas=True) for f in _WAITING]
            self.waiting.appendValue((_packed(pa.table(columns, schema=_WAITING)),))
            first = pdf[pdf["user_id"].isin(new["user_id"])].drop_duplicates("user_id")
            for user, opening in zip(first["user_id"].tolist(), first["opening_cents"].tolist()):
                openings.setdefault(int(user), (int(opening), "bronze", None))
            earliest = int(new["ts"].min()) // 1000 + 1
            wake = earliest if wake is None else min(wake, earliest)
        if wake is not None:
            accounts = self._accounts()
            if not openings.keys() <= accounts.keys():
                self._keep(openings | accounts)
            at = self.timer.get()[0] if self.timer.exists() else 0
            if not at or wake < at:
                self.handle.registerTimer(wake)
                self.timer.update((wake,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked([r[0] for r in self.waiting.get()], _WAITING)
        ordered = np.lexsort((held["op_id"].to_numpy(), held["ts"].to_numpy()))  # stable: copies stay in order of arrival
        held = held.take(ordered)
        again = pd.DataFrame({c: held[c].to_numpy() for c in ("user_id", "op_id")}).duplicated().to_numpy()
        held = held.filter(pa.array(~again))
        n_due = int(np.searchsorted(held["ts"].to_numpy(), passed, "right"))
        rest = held.slice(n_due)
        accounts = self._accounts()
        out = []
        for user, op, ts, kind, amount, level in zip(*held.slice(0, n_due).to_pydict().values()):
            at = _EPOCH + dt.timedelta(microseconds=ts)
            ok, why, balance, tier, end = step(*accounts[user], kind, amount, level, at.date())
            accounts[user] = (balance, tier, end)
            out.append((user, op, at, kind, amount, level, ok, why, balance, tier, end))
        wake = 0
        if len(rest):
            self.waiting.put([(_packed(rest.combine_chunks()),)])
            wake = int(rest["ts"][0].as_py()) // 1000 + 1
            self.handle.registerTimer(wake)
        else:
            self.waiting.clear()
        self.timer.update((wake,))
        if out:
            self._keep(accounts)
            yield pd.DataFrame(out, columns=REPLAY_SCHEMA.names)

    def close(self) -> None:
        pass


def ledger_stream(movements: DataFrame, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """movements: streaming (user_id, op_id, ts TIMESTAMP, kind, amount_cents,
    level[, opening_cents]); the decided movements, in append mode."""
    if "opening_cents" not in movements.columns:
        movements = movements.withColumn("opening_cents", F.lit(0).cast("long"))
    # ignored rows become ticks without nulls: a null makes floats of the ids beside it
    ignored = F.col("user_id").isNull() | F.col("op_id").isNull() | F.col("ts").isNull()
    numbers = {c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("user_id", "op_id", "amount_cents", "opening_cents")}
    return (movements.select(*INPUT).withWatermark("ts", delay)
            .withColumns(numbers | {"kind": F.when(ignored, "tick").otherwise(F.col("kind"))})
            .withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets))).groupBy("bucket")
            .transformWithStateInPandas(Ledger(), REPLAY_SCHEMA, "append", "eventTime"))


def run_ledger(spark: SparkSession, movements: DataFrame, out: str, checkpoint: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Run over what has arrived; returns everything decided so far.  The
    file sink commits each epoch once."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        q = (ledger_stream(movements, delay, buckets).writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(REPLAY_SCHEMA).parquet(out)
