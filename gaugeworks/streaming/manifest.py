"""A manifest followed as a stream: beyond what a batch run needs, for watching a grid as it fills."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.operators.grid import coverage
from gaugeworks.sources.records import MANIFEST


def read(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """New manifest files as they arrive, each unit's first row once; `started` is the event time, and units seen longer ago than `late` are forgotten."""
    rows = spark.readStream.schema(MANIFEST).json(folder).withColumn("event_time", F.to_timestamp("started"))
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["unit"])


def progress(rows: DataFrame) -> DataFrame:
    """Coverage so far: run in complete mode over rows without deduplication, or in a foreachBatch."""
    return coverage(rows)


def hourly(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """Finished cells by status in tumbling windows of event time."""
    return rows.groupBy(F.window("event_time", window), "status").agg(F.count(F.lit(1)).alias("n"), F.avg("wall_s").alias("mean_wall_s"))


LEG = "unit string, dataset string, protocol string, model string, seed int, status string, started string, finished string, wall_s double"
_LEG = ["dataset", "protocol", "model", "seed", "status", "started", "finished", "wall_s"]


def latest(rows: DataFrame, keep: str = "30 days") -> DataFrame:
    """A stream's rows of cells as they change: a cell belongs to the latest leg that ran it, whatever the order in which rows arrive.

    rows: a manifest as a stream, with event_time and a watermark. The state of a cell is its latest row (started, then finished, then status); an older or equal row changes nothing, and a row that comes later than the watermark is dropped. A cell that nothing
    happens to for `keep` of event time after its last row is forgotten; its last row has been emitted.
    """
    import pandas as pd

    wait = int(pd.Timedelta(keep).total_seconds() * 1000)
    order = lambda r: (r["started"] or "", r["finished"] or "", r["status"] or "")

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = dict(zip(_LEG, state.get, strict=True)) if state.exists else None
        before = now
        for b in batches:
            for r in b[_LEG].astype(object).where(b[_LEG].notna(), None).to_dict("records"):
                if now is None or order(r) > order(now):
                    now = r
        if now is not None:
            state.update(tuple(now[c] for c in _LEG))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + wait)
            if now is not before:
                yield pd.DataFrame([{"unit": key[0]} | now])

    return rows.groupBy("unit").applyInPandasWithState(follow, LEG, LEG.removeprefix("unit string, "), "update", GroupStateTimeout.EventTimeTimeout)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "1 day", keep: str = "30 days"):
    """A query that writes changes of cells below target, one folder a batch. A batch that is run again, after a failure, writes its folder again: the table has each batch once."""
    rows = spark.readStream.schema(MANIFEST).json(source).withColumn("event_time", F.coalesce(F.to_timestamp("started"), F.current_timestamp())).withWatermark("event_time", late)
    return latest(rows, keep).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch_sink(target)).trigger(availableNow=True).start()


def batch_sink(target: str):
    """What foreachBatch calls: a batch's rows replace what its number has."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def current(spark: SparkSession, target: str) -> DataFrame:
    """Each cell's latest row of all batches; coverage() of it is what a batch run over the whole manifest gives."""
    rows = spark.read.schema(f"{LEG}, batch long").parquet(target)
    newest = F.max_by(F.struct(*_LEG), F.struct(F.coalesce("started", F.lit("")), F.coalesce("finished", F.lit("")), F.coalesce("status", F.lit("")), "batch"))
    return rows.groupBy("unit").agg(newest.alias("r")).select("unit", "r.*")
