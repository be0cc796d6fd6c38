"""Life cycle of requests as a folded log, step by step."""

import datetime as dt

import pytest

from demandlake.operators import lifecycle as lc

T0 = dt.datetime(2024, 3, 1, 8)
MINUTE = dt.timedelta(minutes=1)
SCHEMA = "prediction_id long, event string, attempt int, ts timestamp_ntz, reason string"


def _state(events):
    return {r["prediction_id"]: (r["status"], r["ts"], r["attempt"]) for r in lc.state(events).collect()}


def test_status_and_time_after_each_step(spark, tmp_path):
    log = lc.RequestLog(spark, str(tmp_path / "log"))
    log.append(0, lc.made(spark.createDataFrame([(i, T0) for i in (1, 2, 3, 4)], "prediction_id long, ts timestamp_ntz")))
    assert set(_state(log.events()).values()) == {("pending", T0, 0)}
    t1 = T0 + 5 * MINUTE
    log.append(1, lc.claim(log.events(1), t1))
    assert set(_state(log.events()).values()) == {("processing", t1, 1)}

    def results(rows):
        return spark.createDataFrame(rows, "prediction_id long, attempt int, scored boolean")
    t2 = t1 + MINUTE
    log.append(2, lc.finish(results([(1, 1, True), (2, 1, False), (3, 1, True)]), t2))     # the worker of 4 is lost
    t3 = t2 + MINUTE
    log.append(3, lc.reject_charges(log.events(3), spark.createDataFrame([(3,), (2,), (9,)], "prediction_id long"), t3))
    want = {1: ("completed", t2, 1), 2: ("failed", t2, 1), 3: ("failed", t3, 1), 4: ("processing", t1, 1)}
    assert _state(log.events()) == want
    assert lc.return_stuck(log.events(), t1 + 9 * MINUTE, 10 * MINUTE).count() == 0
    t4 = t1 + 10 * MINUTE
    for _ in range(2):                                                                      # a repeated step changes nothing
        log.append(4, lc.return_stuck(log.events(4), t4, 10 * MINUTE))
    assert _state(log.events()) == want | {4: ("pending", t4, 1)}
    log.append(5, lc.claim(log.events(5), t4))
    assert _state(log.events())[4] == ("processing", t4, 2)
    log.append(6, lc.finish(results([(4, 1, True)]), t4 + MINUTE))                          # the lost one writes after all: refused
    assert _state(log.events())[4] == ("processing", t4, 2)
    log.append(7, lc.finish(results([(4, 2, True), (1, 1, True)]), t4 + 2 * MINUTE))        # 1 is delivered again
    want |= {4: ("completed", t4 + 2 * MINUTE, 2)}
    assert _state(log.events()) == want
    steps = [(r["status"], r["attempt"], r["reason"]) for r in lc.transitions(log.events()).where("prediction_id = 4").orderBy("step").collect()]
    assert steps == [("pending", 0, None), ("processing", 1, None), ("pending", 1, "timeout"), ("processing", 2, None), ("completed", 2, None)]


@pytest.mark.parametrize("seed", range(3))
def test_any_order_and_repeats_give_the_same_fold(spark, seed):
    """Against a plain replay of each request, events shuffled and repeated."""
    import random
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        if i % 10:
            rows.append((i, "pending", 0, T0, None))
        for a in range(1, rng.randint(1, 4)):
            for event in ("processing", "completed", "failed", "pending"):
                if rng.random() < (0.9 if event == "processing" else 0.4):
                    rows.append((i, event, a, T0 + (10 * a + rng.randint(0, 9)) * MINUTE, None))
    odd = [(None, "pending", 0, T0, None), (5, "processing", None, T0, None), (5, "completed", 1, None, None), (5, "unknown", 9, T0, None)]
    given = rows + rng.sample(rows, len(rows) // 2) + odd
    rng.shuffle(given)
    want = {}
    for i in {r[0] for r in rows if r[1:3] == ("pending", 0)}:
        now = ("pending", T0, 0)
        for a in (1, 2, 3):
            ev = {r[1]: r[3] for r in rows if r[0] == i and r[2] == a}
            if "processing" not in ev:
                continue
            back = ev.get("pending", dt.datetime.max)
            got = {e: ev[e] for e in ("completed", "failed") if e in ev and ev["processing"] <= ev[e] < back}
            if got:
                end = "failed" if "failed" in got else "completed"
                now = (end, got[end], a)
                break
            now = ("pending", back, a) if "pending" in ev else ("processing", ev["processing"], a)
        want[i] = now
    events = spark.createDataFrame(given, SCHEMA)
    assert _state(events) == want
    last = {}
    for r in lc.transitions(events).orderBy("prediction_id", "step").collect():
        last[r["prediction_id"]] = (r["status"], r["attempt"])
    assert last == {i: (s, a) for i, (s, _, a) in want.items()}


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lc.state(empty).count() == lc.transitions(empty).count() == lc.claim(empty, T0).count() == 0
