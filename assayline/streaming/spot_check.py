"""Spot checks of a running system, as a stream.

A stream of outputs is sampled by key, decided by the gate, and counted per tumbling window. Every
micro-batch writes its part of three tables under the name of its batch number:

* ``decisions``: the decided rows that were on time (``attempt`` holds all of a batch until then);
* ``late``: the decided rows whose window had closed before the batch began, which are counted
  nowhere else;
* ``windows``: the new totals of those windows, suites and decisions that the batch changed. A total
  is the newest one of a batch before plus the batch's own count, so the table is an upsert
  by key whose old versions stay readable.

``progress`` holds what the batches have seen: rows, sampled rows, late rows, and the latest time, from
which the next batch takes its watermark. Whatever a batch writes depends on its rows and on
batches before it only, and it replaces what an interrupted attempt has left. So a restart from the
checkpoint, or a batch that runs twice, gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("window_start", "window_end", "suite_id", "decision")
_DECIDED = "key string, time timestamp, window_start timestamp, window_end timestamp, suite_id string, decision string"
_SCHEMAS = {
    "decisions": _DECIDED,
    "late": _DECIDED,
    "windows": "window_start timestamp, window_end timestamp, suite_id string, decision string, n long",
    "progress": "latest timestamp, seen long, sampled long, late long",
}


def sampled(key: Column, rate: float) -> Column:
    """Keep a fixed share of the keys: the same ones in every batch, and after a restart."""
    first = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return first < F.lit(round(rate * 2**32))


def read_table(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """A table of a spot check with its ``batch`` number, of all batches or of those before one."""
    files = spark.read.schema(f"{_SCHEMAS[name]}, batch long").option("basePath", f"{path}/{name}")
    table = files.parquet(f"{path}/{name}")
    return table if before is None else table.where(F.col("batch") < before)


def current_windows(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of every window, suite and decision."""
    return _newest(read_table(spark, path, "windows"))


def _newest(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEYS).agg(F.max_by("n", "batch").alias("n"))


def _at(micros: int | None) -> Column:
    return F.timestamp_micros(F.lit(micros).cast("long"))


class SpotCheck:
    """What is done with each micro-batch."""

    def __init__(
        self, decide: Callable[[DataFrame], DataFrame], path: str, key: str, time: str, rate: float, window: str,
        lateness: str,
    ):
        self.decide, self.path, self.key, self.time = decide, path.rstrip("/"), key, time
        self.rate, self.window, self.lateness = rate, window, lateness

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def watermark(self, spark: SparkSession, batch: int) -> Column:
        """The latest time of all batches before, less the lateness; null for the first."""
        latest = None
        if batch > 0:
            latest = read_table(spark, self.path, "progress", batch).agg(F.max(F.unix_micros("latest"))).first()[0]
        return _at(latest) - F.expr(f"INTERVAL {self.lateness}")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        chosen = rows.where(sampled(F.col(f"`{self.key}`"), self.rate))
        window = F.window("time", self.window)
        decided = (
            self.decide(chosen)
            .select(F.col(f"`{self.key}`").cast("string").alias("key"), F.col(f"`{self.time}`").alias("time"), "suite_id", "decision")
            .select("key", "time", window.start.alias("window_start"), window.end.alias("window_end"), "suite_id", "decision")
            .withColumn("is_late", F.coalesce(F.col("window_end") <= self.watermark(spark, batch), F.lit(False)))
        )
        # decided once; the tables are cut from what was written
        self._write(decided, "attempt", batch)
        done = spark.read.parquet(f"{self.path}/attempt/batch={batch}")
        late, on_time = done.where("is_late").drop("is_late"), done.where("not is_late").drop("is_late")
        self._write(late, "late", batch)
        self._write(on_time, "decisions", batch)
        counts = on_time.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("more"))
        before = spark.createDataFrame([], f"{_SCHEMAS['windows']}, batch long")
        if batch > 0:
            first = on_time.agg(F.min(F.unix_micros("window_start"))).first()[0]
            # only versions of windows that this batch can change
            before = read_table(spark, self.path, "windows", batch).where(
                F.col("window_start") >= _at(first)
            )
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
        totals = counts.alias("a").join(_newest(before).alias("b"), same, "left")
        new = F.col("a.more") + F.coalesce("b.n", F.lit(0))
        self._write(totals.select(*(f"a.{k}" for k in KEYS), new.alias("n")), "windows", batch)
        latest, seen = rows.agg(F.max(F.unix_micros(f"`{self.time}`")), F.count(F.lit(1))).first()
        checked = done.agg(
            _at(latest).alias("latest"), F.lit(seen).cast("long").alias("seen"),
            F.count(F.lit(1)).alias("sampled"), F.count_if("is_late").alias("late"),
        )
        self._write(checked, "progress", batch)


def start_spot_check(
    outputs: DataFrame,
    decide: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    key: str,
    time: str,
    rate: float = 1.0,
    window: str = "1 hour",
    lateness: str = "10 minutes",
    available_now: bool = False,
) -> StreamingQuery:
    """Sample a stream of outputs, decide each (``decide`` is a DataFrame function such as
    ``plans.gate.decide``, which has to keep ``key`` and ``time``), and upsert the counts per window.

    Read the result with :func:`current_windows` and :func:`read_table`. The state is in the tables;
    the stream itself keeps none.
    """
    check = SpotCheck(decide, path, key, time, rate, window, lateness)
    writer = outputs.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
