"""Job rows as a stream: changes of state and throttled progress, in the order of event time, with late rows and an end.

Rows of a job may come in any order within the watermark's delay. They wait in state until the watermark has passed them,
and are then judged in order, each against the one before it, so the stream gives the rows of the batch operators
(``jobs.transitions``, ``store.throttled``). A job's state goes ``keep`` after its last row, by a timer, so the store holds live jobs
and not all that ever were; rows that come later than the watermark are dropped by the engine. ``JOBS`` neighbouring ids share a
state and its timers, as each call of the store takes as long for one job as for many.

Defined cases: rows of a job with equal time stand in the order of seq; a repeated (ts, seq) counts once; null status or progress
is a value like others; a job that starts again after its state has gone is a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spindrift.operators.graph import Rounds

TRACKED = "job_id long, seq long, ts_us long, previous string, status string, progress int, is_transition boolean, is_progress boolean"
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: The ids of jobs that one state spans.
JOBS = 256


class JobTracker(StatefulProcessor):
    """Emits jobs' rows that change their state, or their progress by the rule of the throttle. A key is a range of jobs, which rows
    name in job_id; without that column it is the job itself."""

    def __init__(self, every_s: float, keep_s: float):
        self.every_us, self.keep_us = int(every_s * 1e6), int(keep_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "job_id long, ts_us long, seq long, status string, progress int")
        self.last = handle.getListState("last", "job_id long, ts_us long, status string, progress int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for f in rows:
            jobs = f["job_id"].tolist() if "job_id" in f and key[0] is not None else repeat(key[0], len(f))
            progress = [None if x else int(p) for p, x in zip(f["progress"].tolist(), f["progress"].isna().tolist(), strict=True)]
            came += zip(jobs, f["ts_us"].tolist(), f["seq"].tolist(), f["status"].tolist(), progress, strict=True)
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(-(-min(x[1] for x in came) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed; one timer is enough, as the next is set for the first row that waits or the first
        job that ends. A timer that finds nothing to do comes after one that has set the next."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {(job, ts, seq): (status, progress) for job, ts, seq, status, progress in self.waiting.get()}
        # Jobs of a state without an id are all of them.
        ready = sorted((k for k in waiting if k[1] <= passed), key=lambda k: (k[0] or 0, k[1], k[2]))
        known = {job: (ts, status, progress) for job, ts, status, progress in self.last.get()}
        ended = [job for job, x in known.items() if x[0] + self.keep_us <= passed]
        if not ready and not ended:
            return
        out = []
        for job, ts, seq in ready:
            status, progress = waiting.pop((job, ts, seq))
            last = known.get(job)
            if last and ts >= last[0] + self.keep_us:
                last = None
            changed = status != (last[1] if last else None)
            told = last is None or progress != last[2] or ts >= last[0] + self.every_us
            if changed or told:
                out.append((job, seq, ts, last[1] if last else None, status, progress, changed, told))
            known[job] = (ts, status, progress)
        # A row that waits is later than the end of such a job, and so of a new one.
        known = {job: x for job, x in known.items() if x[0] + self.keep_us > passed}
        self._put(self.last, [(job, *x) for job, x in known.items()])
        if ready:
            self._put(self.waiting, [(*k, *x) for k, x in waiting.items()])
        due = [*(ts for _, ts, _ in waiting), *(x[0] + self.keep_us for x in known.values())]
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        if out:
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in TRACKED.split(", ")])
            yield frame.astype({"job_id": "Int64", "progress": "Int32"})

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def close(self) -> None:
        pass


def track(jobs: DataFrame, every_s: float = 2.0, delay: str = "10 minutes", keep_s: float = 86_400.0) -> DataFrame:
    """The stream of a stream of job rows (job_id, seq, ts, status, progress): rows of ``TRACKED`` in append mode."""
    rows = jobs.withWatermark("ts", delay).select(F.floor(F.col("job_id").cast("long") / JOBS).alias("jobs"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job_id"), F.col("seq").cast("long"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "status", F.col("progress").cast("int"))
    return rows.groupBy("jobs").transformWithStateInPandas(JobTracker(every_s, keep_s), outputStructType=TRACKED, outputMode="Append", timeMode="EventTime")


@contextmanager
def state_store(spark: SparkSession, more: dict[str, str] | None = None):
    """The store of states on disk that timers need, for what starts inside, and more settings. A state's part costs time in each
    batch however little it holds, so there are two for each core at most."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    settings = _STORE | {"spark.sql.shuffle.partitions": str(parts)} | (more or {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_available(stream: DataFrame, sink: str, checkpoint: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what its source has now, into a folder, and go on from its checkpoint if it has one; the folder."""
    with state_store(stream.sparkSession, settings):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)


def replayed(table: DataFrame, order: str, marker: DataFrame, transform: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """A table as a stream: its rows by ranges of a time, one part after the other, then a marker row that moves the watermark
    past all of them; what the transformed stream gives. The stream stops after each part and goes on with the next, so a part is
    one batch, of however many files, and none of its rows is late to another."""
    rounds, spark = Rounds(table.sparkSession), table.sparkSession
    source, sink, checkpoint = rounds.path(), rounds.path(), rounds.path()
    cores = spark.sparkContext.defaultParallelism
    dealt = rounds.keep(table.repartitionByRange(parts * cores, order).withColumn("_part", F.floor(F.spark_partition_id() / cores)))

    def after(rows: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
        rows.write.mode("append").parquet(source)
        return run_available(transform(spark.readStream.schema(table.schema).parquet(source)), sink, checkpoint, settings)

    for k in range(parts):
        after(dealt.where(F.col("_part") == k).drop("_part"), {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    return after(marker.select(*table.columns).coalesce(1))
