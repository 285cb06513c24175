"""L1 with correction of late rows: the two-strike rule over days that may come
in any order.

The state of an entity is its recent days (raw and confirmed level) and, before
them, its last settled day.  A micro-batch puts its rows among the days, folds again from the earliest day that changed, and emits every day whose
confirmed level is new or different, so the table of the last emitted level of
each day is that of the batch rule whatever the order of arrival.  Days more
than ``horizon`` behind an entity's latest one are settled and leave them,
which bounds the state; a row for a settled day is emitted as late and changes
nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from staywise.session import ship_package
from staywise.sources.tables import read_if_exists
from staywise.streaming.jobs import _confirm_step, files_stream

OUT = "client_id long, prediction_day date, risk_level string, confirmed_level string, correction boolean, late boolean"
COLUMNS = ("client_id", "prediction_day", "risk_level", "confirmed_level", "correction", "late")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def refold(days: dict, settled: tuple | None, new: dict) -> list[tuple]:
    """Puts ``new`` ({day: level}) into ``days`` ({day: (level, confirmed)}) and
    folds again; the (day, level, confirmed, correction) whose confirmed or raw
    level is not what ``days`` held.  ``settled``: (day, confirmed) before all."""
    changed = []
    if not new:
        return changed
    level_before = settled[1] if settled else None
    for day in sorted({*days, *new}):
        level, old = new.get(day, (days.get(day) or (None,))[0]), days.get(day)
        confirmed = _confirm_step(level_before, level)
        if old != (level, confirmed):
            changed.append((day, level, confirmed, old is not None))
            days[day] = (level, confirmed)
        level_before = confirmed
    return changed


class Confirm(StatefulProcessor):
    """An entity's state is one value: a step of the state store costs more than
    the days that it carries, so a group takes one to read and one to write."""

    def __init__(self, horizon: int):
        self.horizon = dt.timedelta(days=horizon)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "settled_day date, settled_level string, "
                                                   "days array<date>, levels array<string>, confirmed array<string>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get()
        settled = (kept[0], kept[1]) if kept and kept[0] is not None else None
        days = {d: (level, confirmed) for d, level, confirmed in zip(*kept[2:5])} if kept else {}
        new, out = {}, []
        for row in rows:
            day, level = row["prediction_day"], row["risk_level"]
            if settled and day <= settled[0]:
                out.append((key[0], day, level, None, False, True))
            else:
                new[day] = level  # of one day's rows the last one counts
        changed = refold(days, settled, new)
        out += [(key[0], day, level, confirmed, correction, False) for day, level, confirmed, correction in changed]
        gone = sorted(d for d in days if d < max(days) - self.horizon)
        if gone:
            settled = (gone[-1], days[gone[-1]][1])
        if changed or gone:
            left = [(d, *days[d]) for d in sorted(set(days).difference(gone))]
            self.state.update((*(settled or (None, None)), *[[x[i] for x in left] for i in range(3)]))
        for x in out:
            yield Row(**dict(zip(COLUMNS, x)))

    def close(self) -> None:
        pass


def stream_confirm(daily_stream: DataFrame, horizon: int = 60) -> DataFrame:
    """Rows of ``OUT`` for a stream of (client_id, prediction_day, risk_level)."""
    ship_package(daily_stream.sparkSession)
    return daily_stream.groupBy("client_id").transformWithState(
        statefulProcessor=Confirm(horizon), outputStructType=OUT, outputMode="Append", timeMode="None")


def run_confirm(spark: SparkSession, src: str, out: str, checkpoint: str, max_files: int = 1, horizon: int = 60,
                state_partitions: int | None = None) -> DataFrame:
    """Runs the stream over the files in ``src`` to completion; returns ``current``.
    Each micro-batch overwrites the folder of its own number, so a replayed one
    leaves the same table.  Session settings are restored once the query runs."""
    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        stream = files_stream(spark, src, "client_id long, prediction_day date, risk_level string", max_files)
        q = (stream_confirm(stream, horizon).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return current(spark, out)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last emitted level of every entity and day, with how often it was corrected."""
    rows = read_if_exists(spark, out)
    if rows is None:
        return spark.createDataFrame([], "client_id long, prediction_day date, risk_level string, confirmed_level string, corrections long")
    last = rows.where(~F.col("late")).groupBy("client_id", "prediction_day").agg(
        F.max_by(F.struct("risk_level", "confirmed_level"), "batch").alias("r"), F.count_if("correction").alias("corrections"))
    return last.select("client_id", "prediction_day", "r.*", "corrections")
