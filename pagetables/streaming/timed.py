"""Streams that decide in event time: state is kept until the watermark says that nothing earlier can come.

Both need the RocksDB state store, which `timed_session` sets. A row at or before the watermark is late and is dropped;
everything else is decided in (ts, event_id) order, whatever the order of arrival.

Users and jobs are held in groups by the hash of their key, since a call of Python and its state cost milliseconds
whatever they hold. A batch reads and writes the state of the groups that it touches as a whole, so a stream of very
many users or jobs asks for more `groups`; a stream keeps their number.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagetables.operators.accounts import FREE_REQUESTS, SUBSCRIPTION_DAYS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000
#: A job with one of these states is finished.
FINISHED = ("complete", "error")
#: Groups of users or jobs that share a call and a state.
GROUPS = 1024
Calls = Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]


def timed_session(spark: SparkSession) -> SparkSession:
    """Streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _as_text(name: str, kind: T.DataType) -> Column:
    """A value as text that `_from_text` reads back."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(F.col(name).isNotNull(), F.to_json(F.struct(F.col(name).alias("v"))))
    return F.col(name).cast("string")


def _from_text(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.col(name).cast("bigint"))
    if isinstance(kind, T.BinaryType):
        return F.unhex(name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(name, T.StructType([T.StructField("v", kind)]))["v"]
    return F.col(name).cast(kind)


def _in_groups(rows: DataFrame, key: str, groups: int, delay: str) -> GroupedData:
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).withWatermark("ts", delay).groupBy("_group")


def _held(state: GroupState) -> dict[str, list]:
    """What a group keeps for each of its keys, as JSON in one text."""
    return {key: rest for key, *rest in json.loads(state.get[0])} if state.exists else {}


def _hold(state: GroupState, held: dict[str, list], wake_ms: int | None) -> None:
    """Keep this and call the group again once the watermark has reached `wake_ms`, which is ahead of it."""
    if held:
        state.update((json.dumps([(key, *rest) for key, rest in held.items()], ensure_ascii=False, separators=(",", ":")),))
    elif state.exists:
        state.remove()
    if wake_ms is not None:
        state.setTimeoutTimestamp(max(1, wake_ms - 1))  # a group is called when the watermark is beyond its time


def _free_quota(limit: int, days: int) -> Calls:
    """Requests and activations of a user wait in the state until the watermark has passed them.

    Then they are decided in (ts, event_id) order. What stays for good is one small row: the requests used and the
    last activation. The waiting rows are those of one watermark delay.
    """
    span = days * DAY_US

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        users = _held(state)  # requests used, plan and time of the last activation, waiting (ts, event, plan) in order
        fresh = set()
        for frame in () if state.hasTimedOut else frames:
            for user, *row in zip(*(frame[c].tolist() for c in ("user", "ts_us", "event_id", "plan"))):
                users.setdefault(user, [0, "", 0, []])[3].append(row)
                fresh.add(user)
        for user in fresh:
            users[user][3].sort()
        until, nearest, out = state.getCurrentWatermarkMs() * 1000, None, []
        for user, account in users.items():
            used, plan, since, waiting = account
            n = bisect_right(waiting, until, key=itemgetter(0))
            for ts, event_id, new_plan in waiting[:n]:
                if new_plan:
                    plan, since = new_plan, ts
                    continue
                running = bool(plan) and since + span > ts
                allowed = running or used < limit
                used += not running and allowed
                out.append((event_id, user, plan if running else "free", allowed, used, max(0, limit - used)))
            if n:
                account[:] = used, plan, since, waiting[n:]
            if account[3] and (nearest is None or account[3][0][0] < nearest):
                nearest = account[3][0][0]
        _hold(state, users, None if nearest is None else -(-nearest // 1000))
        if out:
            yield pd.DataFrame(out, columns=["event_id", "user", "effective_plan", "allowed", "used", "remaining"])

    return decide


def stream_free_quota(
    events: DataFrame, delay: str = "1 hour", limit: int = FREE_REQUESTS, days: int = SUBSCRIPTION_DAYS, groups: int = GROUPS,
) -> DataFrame:
    """Quota decisions per user (user, event_id, ts, plan), in event order once the watermark has passed an event.

    Rows with a `plan` are activations, the others are requests; an activation that arrives late, but before the
    watermark, counts for every later request. Append mode. Rows without a user or a time are left out.
    """
    timed_session(events.sparkSession)
    kind = events.schema["user"].dataType
    slim = events.filter(F.col("user").isNotNull() & F.col("ts").isNotNull()).select(
        _as_text("user", kind).alias("user"), "event_id", F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("ts_us"),
        F.coalesce("plan", F.lit("")).alias("plan"),
    )
    output = "event_id bigint, user string, effective_plan string, allowed boolean, used int, remaining int"
    decided = _in_groups(slim, "user", groups, delay).applyInPandasWithState(
        _free_quota(limit, days), output, "users string", "append", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumn("user", _from_text("user", kind))


def _job_latest(fields: Sequence[str], status: str, keep_ms: int, idle_ms: int | None) -> Calls:
    """The latest value of each field of a job, as text. A job is forgotten when it has been quiet long enough.

    `keep_ms` counts for finished jobs, `idle_ms` for others; None keeps them.
    """
    columns, at_status = ["job", "ts_us", "event_id", *fields], 2 + 3 * list(fields).index(status)
    names = ["job", *fields, "created_us", "updated_us"]

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = _held(state)  # created, updated, and of each field the value, its time and its event
        changed: dict[str, list] = {}
        for frame in () if state.hasTimedOut else frames:
            for job, ts, event, *values in zip(*(frame[c].tolist() for c in columns)):
                known = changed[job] = jobs.setdefault(job, [ts, ts] + [None, None, None] * len(fields))
                known[0], known[1] = min(known[0], ts), max(known[1], ts)
                for at, value in zip(range(2, len(known), 3), values):
                    if value is not None and (known[at + 1] is None or (ts, event) >= (known[at + 1], known[at + 2])):
                        known[at:at + 3] = [value, ts, event]
        now, nearest, kept = state.getCurrentWatermarkMs(), None, {}
        for job, known in jobs.items():
            quiet = keep_ms if known[at_status] in FINISHED else idle_ms
            end = None if quiet is None else known[1] // 1000 + 1 + quiet
            if end is None or end > now:
                kept[job] = known
                if end is not None and (nearest is None or end < nearest):
                    nearest = end
        _hold(state, kept, nearest)
        if changed:
            yield pd.DataFrame([(job, *known[2::3], *known[:2]) for job, known in changed.items()], columns=names, dtype=object)

    return latest


def stream_job_latest(
    updates: DataFrame, fields: Sequence[str], status: str = "status", delay: str = "1 hour", keep_hours: float = 24,
    idle_hours: float | None = None, groups: int = GROUPS,
) -> DataFrame:
    """Latest state per job (job, ts, event_id + fields), one row for each batch that changes it; use update mode.

    A field that an update leaves out keeps its value. A finished job leaves the state `keep_hours` after its last
    update, another one after `idle_hours`, if given; an update that comes later starts the job anew.
    """
    timed_session(updates.sparkSession)
    kinds = {c: updates.schema[c].dataType for c in ("job", *fields)}
    # not a number counts as no value
    given = [F.nanvl(f, F.lit(None)) if isinstance(kinds[f], (T.FloatType, T.DoubleType)) else F.col(f) for f in fields]
    slim = updates.filter(F.col("job").isNotNull() & F.col("ts").isNotNull()).select(
        "job", "event_id", F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("ts_us"), *[g.alias(f) for f, g in zip(fields, given)]
    ).withColumns({c: _as_text(c, kind) for c, kind in kinds.items()})
    output = ", ".join([*(f"{c} string" for c in kinds), "created_us bigint", "updated_us bigint"])
    latest = _job_latest(fields, status, int(keep_hours * 3_600_000), None if idle_hours is None else int(idle_hours * 3_600_000))
    rows = _in_groups(slim, "job", groups, delay).applyInPandasWithState(
        latest, output, "jobs string", "update", GroupStateTimeout.EventTimeTimeout)
    times = [F.timestamp_micros(f"{c}_us").cast(updates.schema["ts"].dataType).alias(f"{c}_at") for c in ("created", "updated")]
    return rows.select(*[_from_text(c, kind).alias(c) for c, kind in kinds.items()], *times)


def late_arrivals(events: DataFrame, batches: int, jitter_hours: float, folder: str, end: DataFrame | None = None) -> str:
    """Write `events` (ts, event_id) to a folder as they would arrive with delays: `batches` files, the earliest arrival
    first, each row up to `jitter_hours` after its time by a hash of its id; `end` comes as a last file."""
    spark = events.sparkSession
    lag = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000 * jitter_hours * 3600
    arrival = F.unix_timestamp(F.col("ts").cast("timestamp")) + lag
    rows = events.withColumn("_arrival", arrival).filter("_arrival IS NOT NULL")
    low, high = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    if low is not None:
        # the table is read and shaped once, by many tasks, and dealt to its batches; only a batch's file is written by one
        after = [(F.col("_arrival") >= low + (high - low) * k / batches).cast("int") for k in range(1, batches)]
        dealt = rows.withColumn("_batch", sum(after, F.lit(0))).drop("_arrival")
        dealt.write.partitionBy("_batch").parquet(f"{folder}-dealt")
        dealt = spark.read.schema(dealt.schema).parquet(f"{folder}-dealt")
        for i in range(batches):
            dealt.filter(F.col("_batch") == i).drop("_batch").repartition(1).write.mode("append").parquet(folder)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(folder)
    if low is None and end is None:
        spark.createDataFrame([], events.schema).write.mode("append").parquet(folder)
    return folder
