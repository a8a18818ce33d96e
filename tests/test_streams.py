"""Job streams that are stopped and go on, with rows out of order, against the batch operators."""

import random

from pyspark.sql import functions as F

from spindrift.operators import store
from spindrift.streaming import jobs, tracker

SCHEMA = "job_id long, seq long, ts timestamp, status string, progress int"


def _rows(seed=1, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(12), k, k * 40 + rng.randrange(200), rng.choice(["queued", "running", "running", "success", None]), rng.choice([0, 10, 10, 50, None])) for k in range(n)]


def _table(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, seq long, s long, status string, progress int")
    return df.select("job_id", "seq", F.timestamp_seconds("s").alias("ts"), "status", "progress")


def _add(spark, rows, path):
    _table(spark, rows).coalesce(1).write.mode("append").parquet(path)


def _run(spark, tmp_path, delay="10 minutes", keep_s=1e6):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return tracker.run_available(tracker.track(stream, 100, delay, keep_s), str(tmp_path / "out"), str(tmp_path / "cp"))


def test_a_stream_that_stops_and_goes_on_gives_the_batch_rows(spark, tmp_path):
    rows, source = _rows(), str(tmp_path / "in")
    _add(spark, rows[:120], source)
    first = _run(spark, tmp_path).count()
    _add(spark, rows[120:200], source)
    second = _run(spark, tmp_path).count()
    assert 0 < first < second  # what has passed is there before the end
    _add(spark, rows[200:], source)
    _add(spark, [(99, 0, 10**7, "end", 0)], source)
    got = _run(spark, tmp_path).where("job_id < 99")
    table = _table(spark, rows)
    want = {tuple(r) for r in jobs.transitions(table).collect()}
    assert {tuple(r) for r in got.where("is_transition").select("job_id", "seq", "previous", "status").collect()} == want
    want = sorted(tuple(r) for r in store.throttled(table, "job_id", "ts", "progress", ["seq"], 100).select("job_id", "seq").collect())
    assert sorted(tuple(r) for r in got.where("is_progress").select("job_id", "seq").collect()) == want


def test_late_rows_are_left_out_and_states_end(spark, tmp_path):
    source = str(tmp_path / "in")
    _add(spark, [(1, 0, 1000, "queued", 0), (1, 1, 1010, "running", 5), (2, 0, 1005, "queued", 0)], source)
    _add(spark, [(3, 0, 5000, "queued", 0)], source)  # the watermark is at 4400
    _run(spark, tmp_path, keep_s=600)
    _add(spark, [(1, 2, 1500, "success", 100), (1, 3, 9000, "running", 5)], source)  # the first is late, and the job has gone
    _add(spark, [(9, 0, 10**6, "end", 0)], source)
    got = {(r["job_id"], r["seq"], r["previous"], r["status"]) for r in _run(spark, tmp_path, keep_s=600).where("is_transition").collect()}
    assert got == {(1, 0, None, "queued"), (1, 1, "queued", "running"), (2, 0, None, "queued"), (3, 0, None, "queued"), (1, 3, None, "running")}


def test_equal_times_stand_in_the_order_of_seq(spark, tmp_path):
    _add(spark, [(1, 5, 100, "success", 9), (1, 2, 100, "queued", 0), (1, 3, 100, "running", 0)], str(tmp_path / "in"))
    _add(spark, [(9, 0, 10**6, "end", 0)], str(tmp_path / "in"))
    got = [(r["seq"], r["previous"]) for r in _run(spark, tmp_path).where("job_id = 1").orderBy("seq").collect()]
    assert got == [(2, None), (3, "queued"), (5, "running")]
