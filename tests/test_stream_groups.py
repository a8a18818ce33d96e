"""Jobs that share a state, and parts of a replayed table that are many files."""

import pandas as pd
from pyspark.sql import functions as F

from spindrift.streaming import jobs, tracker


class State:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def put(self, rows):
        self.calls.append("put")
        self.rows = rows

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getListState(self, *_):
        return State(self.calls)

    def registerTimer(self, at):
        self.timers.append(at)


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_of_the_store_do_not_grow_with_jobs():
    t, handle = tracker.JobTracker(1, 100), Handle()
    t.init(handle)
    n = 200
    rows = pd.DataFrame({"job_id": list(range(n)) * 2, "ts_us": [1_000_000] * n + [2_000_000] * n, "seq": range(2 * n), "status": ["queued"] * n + ["running"] * n, "progress": 0})
    assert list(t.handleInputRows((0,), iter([rows]), None)) == []
    first = pd.concat(t.handleExpiredTimer((0,), Time(1_500), None))
    assert first["job_id"].tolist() == list(range(n)) and handle.timers == [1000, 2000]
    second = pd.concat(t.handleExpiredTimer((0,), Time(3_000), None))
    assert set(second["previous"]) == {"queued"} and len(second) == n and handle.timers[2:] == [102_000]
    assert list(t.handleExpiredTimer((0,), Time(102_000), None)) == [] and t.last.rows == [] and t.waiting.rows == []
    assert len(handle.calls) < 20


def test_no_row_is_late_where_a_part_has_many_files(spark):
    """Parts of the replayed table are several files each, over times far beyond the watermark's delay."""
    table = spark.range(0, 4000, 1, 8).select((F.col("id") % 300 * 7 - 900).alias("job_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 7919 % 4000 * 3600 + 1_000_000).alias("ts"), F.when(F.col("id") % 3 == 0, "running").otherwise("queued").alias("status"), F.lit(1).alias("progress"))
    end = spark.range(1).selectExpr("-99999L AS job_id", "0L AS seq", "timestamp_seconds(9000000000) AS ts", "'end' AS status", "0 AS progress")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 200)
    try:
        got = tracker.replayed(table, "ts", end, lambda s: tracker.track(s, 100, "1 hour", 1e9)).where("is_transition AND job_id <> -99999")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    want = {tuple(r) for r in jobs.transitions(table).collect()}
    assert sorted(map(tuple, got.select("job_id", "seq", "previous", "status").collect()), key=str) == sorted(want, key=str)
