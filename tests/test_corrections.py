"""L1 with corrections: any order of arrival within the horizon equals the batch rule."""

import datetime as dt
import random

import pytest

from staywise.operators import history as H
from staywise.streaming import corrections as C

LEVELS = ("low", "medium", "high", "critical")
START = dt.date(2001, 8, 1)
SCHEMA = "client_id long, prediction_day date, risk_level string"


def land(spark, folder, k, rows):
    """One file for each micro-batch, dated in order of arrival."""
    import os

    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    for f in os.listdir(f"{folder}/{k:03d}"):
        os.utime(f"{folder}/{k:03d}/{f}", (1_000_000_000 + 10 * k,) * 2)


def batch_rule(spark, rows):
    got = H.confirm_levels(spark.createDataFrame(rows, SCHEMA), "client_id").collect()
    return {(r["client_id"], r["prediction_day"]): r["confirmed_level"] for r in got}


def test_any_order_equals_the_batch_rule(spark, tmp_path):
    rng = random.Random(4)
    rows = {(c, START + dt.timedelta(days=d)): rng.choice(LEVELS) for c in range(8) for d in rng.sample(range(20), 12)}
    order = sorted(rows, key=lambda k: rng.random())
    parts = [order[i::5] for i in range(5)]
    for k, part in enumerate(parts):
        land(spark, tmp_path / "src", k, [(c, d, rows[c, d]) for c, d in part])
    again = parts[1][:6]  # a repeat changes nothing, a new level of a known day does
    changed = {k: LEVELS[(LEVELS.index(rows[k]) + 1) % 4] for k in parts[2][:4]}
    land(spark, tmp_path / "src", 5, [(c, d, rows[c, d]) for c, d in again] + [(c, d, v) for (c, d), v in changed.items()])
    rows |= changed
    got = C.run_confirm(spark, str(tmp_path / "src" / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), horizon=60, state_partitions=3).collect()
    assert {(r["client_id"], r["prediction_day"]): r["confirmed_level"] for r in got} == batch_rule(spark, [(c, d, v) for (c, d), v in rows.items()])
    assert sum(r["corrections"] for r in got) > 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != C.ROCKSDB


def test_rows_behind_the_horizon_are_late(spark, tmp_path):
    days = [START + dt.timedelta(days=d) for d in (0, 1, 2, 30, 31)]
    land(spark, tmp_path / "src", 0, [(1, d, "low") for d in days[:3]])
    land(spark, tmp_path / "src", 1, [(1, days[3], "critical"), (2, days[0], "high")])
    land(spark, tmp_path / "src", 2, [(1, days[1], "critical"), (1, days[4], "critical")])
    got = C.run_confirm(spark, str(tmp_path / "src" / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), horizon=5, state_partitions=2)
    levels = {(r["client_id"], r["prediction_day"]): r["confirmed_level"] for r in got.collect()}
    assert levels == {(1, days[0]): "low", (1, days[1]): "low", (1, days[2]): "low", (1, days[3]): "high", (1, days[4]): "critical", (2, days[0]): "high"}
    late = spark.read.parquet(str(tmp_path / "out")).where("late").collect()
    assert [(r["client_id"], r["prediction_day"], r["confirmed_level"]) for r in late] == [(1, days[1], None)]


@pytest.mark.parametrize("seed", range(20))
def test_refold_equals_folding_all(seed):
    rng = random.Random(seed)
    rows = {d: rng.choice(LEVELS) for d in range(15)}
    days, told = {}, {}
    for k in range(0, 15, 4):
        new = {d: rows[d] for d in sorted(rows, key=lambda d: hash((seed, d)))[k:k + 4]}
        for day, level, confirmed, correction in C.refold(days, None, new):
            assert correction == (day in told)
            told[day] = confirmed
    want, prev = {}, None
    for d in range(15):
        want[d] = prev = C._confirm_step(prev, rows[d])
    assert told == want


def test_a_group_of_the_stream_needs_no_pandas_steps(monkeypatch):
    """F16: a group's few rows are sorted as a list; frames of a group in any order, late rows marked."""
    import datetime as dt

    import pandas as pd

    from staywise.streaming import jobs as J

    class State:
        exists, get = True, (dt.date(2024, 1, 1), "low")

        def update(self, value):
            self.value = value

    def frame(*rows):
        return pd.DataFrame([(7, dt.date(2024, 1, d), level) for d, level in rows], columns=["client_id", "prediction_day", "risk_level"])

    frames = [frame((4, "critical"), (1, "high")), frame((3, "high"), (2, "low"))]
    for name in ("concat",):
        monkeypatch.setattr(J.pd, name, None)
    state = State()
    (out,) = J._confirm_group((7,), iter(frames), state)
    assert [(r.prediction_day.day, r.confirmed_level, r.late) for r in out.itertuples()] == [
        (1, None, True), (2, "low", False), (3, "medium", False), (4, "high", False)]
    assert state.value == (dt.date(2024, 1, 4), "high")


def test_a_group_reads_and_writes_its_state_once():
    """a step of the state store for each day of a group cost more than the fold."""
    class State:
        value, steps = None, 0

        def get(self):
            self.steps += 1
            return self.value

        def update(self, value):
            self.steps += 1
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return state

    state, p = State(), C.Confirm(3)
    p.init(Handle())
    batches = [{0: "low", 1: "critical", 2: "low"}, {1: "low", 4: "high", 6: "critical"}, {0: "high", 5: "medium", 8: None}]
    emitted = {}
    for k, batch in enumerate(batches, 1):
        rows = iter([{"prediction_day": START + dt.timedelta(days=d), "risk_level": level} for d, level in batch.items()])
        for r in p.handleInputRows((7,), rows, None):
            emitted[(r.prediction_day - START).days] = (r.risk_level, r.confirmed_level, r.correction, r.late)
        assert state.steps == 2 * k
    assert emitted == {0: ("high", None, False, True), 1: ("low", "low", True, False), 2: ("low", "low", False, False),
                       4: ("high", "medium", False, False), 5: ("medium", "medium", False, False), 6: ("critical", "high", False, False), 8: (None, None, False, False)}
    assert state.value[0] == START + dt.timedelta(days=4) and [(d - START).days for d in state.value[2]] == [5, 6, 8]
