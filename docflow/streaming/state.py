"""Streams with state: windowed counts, lockouts, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failures that lock, and minutes of a lock (fixed values).
FAILURES, MINUTES = 10, 15
#: Hours after which a session without activity has expired (a fixed value).
EXPIRY_HOURS = 24
#: transformWithState keeps its state in this store only.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(events: DataFrame, at: str, by: list[str], every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, every), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def lockouts(tries: DataFrame, user: str = "user_id", at: str = "ts", success: str = "success", failures: int = FAILURES, minutes: int = MINUTES) -> DataFrame:
    """user, locked_at, locked_until: every ``failures``-th failure since the last success.  Batch; state is per user."""
    w = Window.partitionBy(user).orderBy(at, "event_id")
    runs = tries.withColumn("run", F.sum(F.col(success).cast("int")).over(w))
    n = F.row_number().over(Window.partitionBy(user, "run").orderBy(at, "event_id"))
    counted = runs.where(~F.col(success)).withColumn("n", n)
    return counted.where(F.col("n") % failures == 0).select(user, F.col(at).alias("locked_at"), (F.col(at) + F.expr(f"interval {minutes} minutes")).alias("locked_until"))


def _needs_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


#: Buckets that users are dealt to: the state of a bucket's users is read and written together, as packed rows.
BUCKETS = 1024
_TRY = np.dtype([("nobody", "?"), ("user", "<i8"), ("at", "<i8"), ("event_id", "<i8"), ("flag", "?")])
_COUNT = np.dtype([("nobody", "?"), ("user", "<i8"), ("n", "<i8")])


def _packed(state, kind: np.dtype) -> np.ndarray:
    """The rows that a list state holds in packed pieces."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(bytes(r[0]), kind) for r in state.get())])


def count_failures(tries: np.ndarray, before: np.ndarray, failures: int) -> tuple[np.ndarray, np.ndarray]:
    """Of tries (by user, in order of time and event_id) and the users' counts before them: which tries lock, and the
    counts of these users after them (none of 0)."""
    first = np.ones(len(tries), bool)
    first[1:] = (tries["user"][1:] != tries["user"][:-1]) | (tries["nobody"][1:] != tries["nobody"][:-1])
    fail = ~tries["flag"]
    total = np.cumsum(fail)
    held = np.zeros(len(tries), np.int64)  # at a user's first try: failures before it
    _, mine, theirs = np.intersect1d(tries[first][["nobody", "user"]], before[["nobody", "user"]], return_indices=True)
    held[np.flatnonzero(first)[mine]] = before["n"][theirs]
    starts = first | ~fail
    base = np.where(fail, total - 1 - held, total)  # what a run's counts start from
    n = total - base[np.maximum.accumulate(np.where(starts, np.arange(len(tries)), 0))]
    last = np.append(first[1:], True)[: len(tries)]
    after = np.zeros(int(last.sum()), _COUNT)
    after["nobody"], after["user"], after["n"] = tries["nobody"][last], tries["user"][last], n[last]
    return fail & (n % failures == 0), after[after["n"] > 0]


class _Lockouts(StatefulProcessor):
    """Tries of a bucket of users are held until the watermark has passed them, and then counted in order of time and
    event_id.  Held are only the tries within the watermark's delay, and a number for each user with failures."""

    def __init__(self, failures: int, minutes: int):
        self.failures, self.minutes = failures, minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "tries binary")
        self.counts = handle.getListState("counts", "users binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = []
        for part in rows:
            new = np.zeros(len(part), _TRY)
            for c in _TRY.names:
                new[c] = part[c].to_numpy()
            found.append(new)
        if found and len(new := np.concatenate(found)):
            self.held.appendValue((new.tobytes(),))
            self.handle.registerTimer(int(new["at"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _packed(self.held, _TRY)
        over = held["at"] < passed
        ready, rest = np.sort(held[over], order=["nobody", "user", "at", "event_id"]), held[~over]
        if not len(ready):
            return
        if len(rest):
            self.held.put([(rest.tobytes(),)])
            self.handle.registerTimer(int(rest["at"].min()) // 1000 + 1)
        else:
            self.held.clear()
        before = _packed(self.counts, _COUNT)
        locks, after = count_failures(ready, before, self.failures)
        stay = before[~np.isin(before[["nobody", "user"]], ready[["nobody", "user"]])]
        if len(stay) + len(after):
            self.counts.put([(np.concatenate([stay, after]).tobytes(),)])
        elif len(before):
            self.counts.clear()  # a success leaves no state
        if locks.any():
            found = ready[locks]
            yield pd.DataFrame({"nobody": found["nobody"], "user": found["user"], "locked_at": found["at"], "locked_until": found["at"] + self.minutes * 60_000_000})

    def close(self) -> None:
        pass


def lockout_stream(tries: DataFrame, failures: int = FAILURES, minutes: int = MINUTES, late: str = "2 hours", buckets: int = BUCKETS) -> DataFrame:
    """The same rule over a stream of (user_id, event_id, ts, success): user_id, locked_at, locked_until.

    Tries may arrive in any order, as late as ``late``: they are counted in order of time once the watermark has passed
    them, so the result is that of the batch however the stream is cut; later ones are left out.  State is the tries
    within ``late`` and a number for each user with failures, packed by ``buckets`` of users; more users want more buckets.
    Tries without a time, or neither failed nor successful, are left out.
    """
    _needs_state_store(tries.sparkSession)
    user = F.col("user_id").cast("long")
    timed = tries.where(F.col("ts").isNotNull() & F.col("success").isNotNull()).select(
        F.pmod(F.xxhash64(user), F.lit(buckets)).alias("bucket"),
        F.col("ts").cast("timestamp").alias("time"),
        user.isNull().alias("nobody"),
        F.coalesce(user, F.lit(0)).alias("user"),
        _micros("ts").alias("at"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(-(1 << 63))).alias("event_id"),
        F.col("success").alias("flag"),
    )
    out = timed.withWatermark("time", late).groupBy("bucket").transformWithStateInPandas(_Lockouts(failures, minutes), "nobody boolean, user long, locked_at long, locked_until long", "append", "eventTime")
    return out.select(F.when(~F.col("nobody"), F.col("user")).alias("user_id"), *(F.timestamp_micros(c).alias(c) for c in ("locked_at", "locked_until")))


def expiries(activity: DataFrame, hours: int = EXPIRY_HOURS) -> DataFrame:
    """key, last_at, expired_at of sessions (user_id, event_id, ts) that saw nothing for so many hours.  Batch; a session
    comes back with its next activity, and the last one of each is taken to be over."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    span = F.expr(f"interval {hours} hours")
    return activity.withColumn("next", following).where(F.col("next").isNull() | (F.col("next") > F.col("ts") + span)).select(F.col("user_id").alias("key"), F.col("ts").alias("last_at"), (F.col("ts") + span).alias("expired_at"))


def expiry_stream(activity: DataFrame, hours: int = EXPIRY_HOURS, late: str = "2 hours") -> DataFrame:
    """The same over a stream: an expiry comes out when the watermark passes it, and the session's state goes.

    Spark's session windows take in activity at just their end.  The watermark is a millisecond later than ``late``, so
    that no session is over that a row in time might still extend.  Activity without a time is left out.
    """
    timed = activity.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("time")).withWatermark("time", f"{late} 1 millisecond")
    out = timed.groupBy("key", F.session_window("time", f"{hours} hours")).agg(F.max("time").alias("last_at"))
    return out.select("key", "last_at", (F.col("last_at") + F.expr(f"interval {hours} hours")).alias("expired_at"))


def publish_complete(stream: DataFrame, path: str, checkpoint: str, every_batch: bool = False) -> None:
    """A stream's whole result after each batch, each in a folder of its own.  A folder counts once Spark has marked it as
    written, so a batch that dies leaves the result before it in place, and is written anew when the stream is started
    again.  Folders older than the one before are dropped, unless every_batch is to stay."""

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n:09d}")
        files, root = FileSystem.from_uri(path)
        for old, _ in [] if every_batch else _published(files, root)[:-2]:
            files.delete_dir(old)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def _published(files: FileSystem, root: str) -> list[tuple[str, int]]:
    """Folders of whole results and their batches, in order."""
    found = files.get_file_info(FileSelector(root, allow_not_found=True))
    numbers = [(f.path, int(f.base_name.split("=")[1])) for f in found if f.base_name.startswith("batch=")]
    return sorted((x for x in numbers if files.get_file_info(f"{x[0]}/_SUCCESS").type == FileType.File), key=lambda x: x[1])


def newest_result(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``publish_complete`` has published last; nothing before its first batch."""
    found = _published(*FileSystem.from_uri(path))
    return spark.read.schema(schema).parquet(f"{path}/batch={found[-1][1]:09d}") if found else spark.createDataFrame([], schema)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append a stream's rows to a table, exactly once by its checkpoint."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
