"""Users and jobs of a stream share calls and states, and the arrivals of a stream are made in one pass."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.streaming import streams, timed
from test_event_time import EVENTS, START, arrivals, decided, in_batches

UPDATES = "job int, event_id long, ts timestamp, status string, n bigint, share double, seen timestamp, day date, tags array<string>"


def run(stream, mode="append"):
    """Rows of a stream with their batch, and the rows of its state after each batch."""
    base, spark = streams.scratch(stream.sparkSession), stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.parquet(f"{base}/out/batch_id={i}"))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch_id", T.LongType())])).parquet(f"{base}/out")
    return rows, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("groups", [1, 7])
def test_users_share_a_state(spark, groups):
    rng = random.Random(4)
    rows = [
        (rng.randint(1, 60), i, START + datetime.timedelta(minutes=rng.randint(0, 60 * 24 * 6)), rng.choice([None] * 5 + ["pro"])) for i in range(600)
    ]
    end = [(-1, -1, START + datetime.timedelta(days=900), "pro")]
    stream = arrivals(spark, [*in_batches(rows, 2, 10, 4, rng), end], EVENTS)
    got, kept = run(timed.stream_free_quota(stream, "12 hours", 3, 1, groups=groups))
    assert got.schema["user"].dataType == T.IntegerType()
    assert sorted(map(tuple, got.drop("batch_id").collect())) == decided(rows, 3, 1)
    assert max(kept) <= groups


def test_jobs_share_a_state_and_end_one_by_one(spark):
    rows = [
        [(1, 1, START, "running", 2**60 + 1, 0.1, START, datetime.date(2024, 1, 1), ["a"]), (2, 2, START, "complete", None, math.nan, None, None, None),
         (3, 3, START, "running", 5, 2.0, None, None, [])],
        [(1, 4, START + datetime.timedelta(hours=5), None, None, None, START + datetime.timedelta(microseconds=7), None, None)],
        [(9, 5, START + datetime.timedelta(hours=9), "running", 1, None, None, None, None)],
        [(2, 6, START + datetime.timedelta(hours=8), None, 7, None, None, None, None),
         (1, 7, START + datetime.timedelta(hours=8), "complete", None, None, None, None, None)],
    ]
    stream = arrivals(spark, rows, UPDATES)
    fields = ["status", "n", "share", "seen", "day", "tags"]
    got, kept = run(timed.stream_job_latest(stream, fields, delay="2 hours", keep_hours=2, groups=1), "update")
    assert [got.schema[f] for f in fields] == [stream.schema[f] for f in fields]
    last = {r.job: r for r in streams.latest_batch(got, "job").collect()}
    seen = START + datetime.timedelta(microseconds=7)
    assert tuple(last[1])[1:7] == ("complete", 2**60 + 1, 0.1, seen, datetime.date(2024, 1, 1), ["a"])
    assert (last[1].created_at, last[1].updated_at) == (START, START + datetime.timedelta(hours=8))
    # the second job was done and left the state before its last update, which starts it anew
    assert tuple(last[2])[1:] == (None, 7, None, None, None, None, START + datetime.timedelta(hours=8), START + datetime.timedelta(hours=8))
    assert tuple(last[3])[1:7] == ("running", 5, 2.0, None, None, []) and got.count() == 7 and max(kept) == 1


def test_arrivals_are_made_in_one_pass(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def ts(i):
        made.add(1)
        return START + datetime.timedelta(hours=i)

    rows = spark.range(0, 400, 1, 4).select(F.col("id").alias("event_id"), ts("id").alias("ts"))
    back = spark.read.parquet(timed.late_arrivals(rows, 10, 1, f"{tmp_path}/arrivals"))
    assert made.value <= 5 * 400  # the bounds and the rows, each with a filter
    files = sorted((tmp_path / "arrivals").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    parts = [sorted(r.event_id for r in spark.read.parquet(str(f)).collect()) for f in files]
    assert back.count() == 400 and len(parts) == 10
    assert all(a[0] < b[0] and a[-1] < b[-1] for a, b in zip(parts, parts[1:]))
