"""Streams in event time: shuffled arrival, late activations, and state that ends."""

import datetime
import random
import uuid

from pyspark.sql import functions as F

from pagetables.streaming import streams, timed

START = datetime.datetime(2024, 1, 1)
EVENTS = "user int, event_id long, ts timestamp, plan string"
UPDATES = "job string, event_id long, ts timestamp, status string, counts int"


def arrivals(spark, batches, schema):
    """One file a batch, read in this order."""
    folder = f"{streams.scratch(spark)}/in-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def in_batches(rows, at, hours, count, rng):
    """Rows in the order in which they come, up to `hours` late, cut into batches."""
    come = sorted(rows, key=lambda r: r[at] + datetime.timedelta(hours=rng.random() * hours))
    return [come[i * len(come) // count:(i + 1) * len(come) // count] for i in range(count)]


def decided(rows, limit, days):
    out, state = [], {}
    for user, event_id, ts, plan in sorted(rows, key=lambda r: (r[2], r[1])):
        used, have, since = state.get(user, (0, None, None))
        if plan:
            state[user] = used, plan, ts
            continue
        running = have is not None and since + datetime.timedelta(days=days) > ts
        allowed = running or used < limit
        used += not running and allowed
        state[user] = used, have, since
        out.append((event_id, user, have if running else "free", allowed, used, max(0, limit - used)))
    return sorted(out)


def test_quota_is_decided_in_event_order(spark):
    rng = random.Random(1)
    rows = [
        (rng.randint(1, 4), i, START + datetime.timedelta(minutes=rng.randint(0, 60 * 24 * 6)), rng.choice([None] * 5 + ["pro"])) for i in range(120)
    ]
    end = [(-1, -1, START + datetime.timedelta(days=900), "pro")]
    stream = arrivals(spark, [*in_batches(rows, 2, 10, 4, rng), end], EVENTS)
    got = streams.drain(timed.stream_free_quota(stream, "12 hours", 3, 1)).drop("batch_id")
    assert sorted(map(tuple, got.collect())) == decided(rows, 3, 1)


def test_nothing_is_decided_before_the_watermark(spark):
    first = [(1, 1, START, None), (1, 2, START + datetime.timedelta(hours=5), None)]
    late = [(1, 3, START - datetime.timedelta(hours=1), "pro"), (2, 4, START + datetime.timedelta(hours=30), None)]
    stream = arrivals(spark, [first, late], EVENTS)
    got = streams.drain(timed.stream_free_quota(stream, "24 hours", 3, 1)).drop("batch_id")
    # the watermark ends at hour six: the activation came after the requests and counts, the last request waits
    assert sorted(map(tuple, got.collect())) == [(1, 1, "pro", True, 0, 3), (2, 1, "pro", True, 0, 3)]


def test_jobs_leave_the_state(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for job in range(60):  # a job an hour, each done within two hours
        begin = START + datetime.timedelta(hours=job)
        for minute, status in ((0, "running"), (30, None), (90, "complete" if job % 3 else "error")):
            n += 1
            rows.append((f"j{job}", n, begin + datetime.timedelta(minutes=minute), status, rng.choice([None, n])))
    stream = arrivals(spark, in_batches(rows, 2, 1, 5, rng), UPDATES)
    latest = timed.stream_job_latest(stream, ["status", "counts"], delay="2 hours", keep_hours=2)
    folder = streams.scratch(spark)

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    query = latest.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows_out = streams.latest_batch(spark.read.parquet(f"{folder}/out").withColumn("batch_id", F.col("batch_id").cast("long")), "job")
    got = {r.job: (r.status, r.counts, r.created_at, r.updated_at) for r in rows_out.collect()}
    for job in range(60):
        own = [r for r in rows if r[0] == f"j{job}"]
        counts = [r[4] for r in own if r[4] is not None]
        assert got[f"j{job}"] == (own[-1][3], counts[-1] if counts else None, own[0][2], own[-1][2])
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(got) == 60 and kept and kept[-1] < 30  # state and timers of the last hours only
