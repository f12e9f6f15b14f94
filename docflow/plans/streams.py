"""Queries of progress lines and streams; streams run over what is there and must equal the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder
from ..streaming import progress, state
from .tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(events: DataFrame) -> DataFrame:
    """Events as the lines a worker prints: structured, bar, log, error and other lines."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("PROGRESS|row|"), u, F.lit("/200|item|"), e))
        .when(F.col("event_type") == "signup", F.concat(F.lit("PROGRESS|init|"), u, F.lit("|start")))
        .when(F.col("event_type") == "view", F.concat((F.col("user_id") % 101).cast("string"), F.lit("%|###  | "), u, F.lit("/300 [it/s]")))
        .when(F.col("event_type") == "error", F.concat(F.lit("Error: failed at "), e))
        .otherwise(F.concat(F.lit("bought "), e))
    )
    return events.select("event_id", line.alias("value"))


_PARSED = """SELECT event_id, CASE event_type WHEN 'click' THEN 'progress' WHEN 'signup' THEN 'init' WHEN 'view' THEN 'progress' ELSE 'error' END AS type,
 CASE event_type WHEN 'click' THEN user_id WHEN 'signup' THEN 0 WHEN 'view' THEN user_id END::INT AS current, CASE event_type WHEN 'click' THEN 200 WHEN 'signup' THEN user_id WHEN 'view' THEN 300 END::INT AS total,
 CASE event_type WHEN 'click' THEN round_even(100.0 * user_id / 200, 0) WHEN 'signup' THEN 0 WHEN 'view' THEN user_id % 101 END::INT AS percent,
 CASE event_type WHEN 'click' THEN 'item|' || event_id WHEN 'signup' THEN 'start' WHEN 'error' THEN 'Error: failed at ' || event_id END AS message FROM events WHERE event_type <> 'purchase'"""


@query(_PARSED)
def progress_parse(spark, d):
    return progress.events(_lines(read(spark, d, "events"))).select("event_id", "type", "current", "total", "percent", "message")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, so that a single file and a folder of files both serve as the stream's source
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """A stream's result as a table in the shared folder, written batch by batch."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        state.to_parquet(stream, f"{out}/rows", f"{out}/checkpoint")
        return spark.read.schema(stream.schema).parquet(f"{out}/rows")
    state.publish_complete(stream, f"{out}/rows", f"{out}/checkpoint")
    return state.newest_result(spark, f"{out}/rows", stream.schema)


#: How many batches the unordered stream comes in, and of how many files each.
SLICES, FILES = 6, 4


def _arriving(spark: SparkSession, d: str, hours: int) -> DataFrame:
    """Events as a stream in which they arrive up to an hour late and out of order, closed by an event so much later that
    the watermark passes all others."""
    events = read(spark, d, "events").select("user_id", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3_600_000_000))
    events = events.withColumn("arrival", arrival)
    edges = [None, *events.approxQuantile("arrival", [i / SLICES for i in range(1, SLICES)], 0.01), None]
    folder = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    for low, high in zip(edges, edges[1:]):  # a batch's files are written after those of the batch before
        rows = events.where((F.lit(True) if low is None else F.col("arrival") >= low) & (F.lit(True) if high is None else F.col("arrival") < high))
        rows.drop("arrival").repartition(FILES).write.mode("append").parquet(folder)
    close = events.agg((F.max("ts") + F.expr(f"interval {hours + 24} hours")).alias("ts"))
    close.select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("signup").alias("event_type")).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", FILES).parquet(folder)


@query(_PARSED)
def stream_progress(spark, d):
    return _run(progress.events(_lines(_event_stream(spark, d))).select("event_id", "type", "current", "total", "percent", "message"))


@query("SELECT event_id, stream, type, message FROM (" + _PARSED + ") JOIN (SELECT event_id, CASE event_type WHEN 'error' THEN 'stderr' ELSE 'stdout' END AS stream FROM events) USING (event_id)")
def stream_merge(spark, d):
    """Two live streams, a worker's output and its errors, read as one."""
    out, err = (_lines(_event_stream(spark, d).where(c)) for c in ("event_type <> 'error'", "event_type = 'error'"))
    return _run(progress.events(progress.merged(out, err)).select("event_id", "stream", "type", "message"))


@query("""WITH p AS (SELECT user_id AS process, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END AS exit_code, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 30 * user_id END AS waited FROM events GROUP BY user_id),
 l AS (SELECT user_id AS process, count(*) FILTER (event_type <> 'purchase') AS lines, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id),
 t AS (SELECT *, exit_code IS NULL AS late FROM p WHERE waited IS NOT NULL AND (exit_code IS NOT NULL OR waited > 1800))
 SELECT process, CASE WHEN late OR exit_code <> 0 THEN 'error' ELSE 'complete' END AS type, CASE WHEN late THEN 'timeout' WHEN exit_code <> 0 THEN 'exit code ' || exit_code END AS message, coalesce(lines, 0)::BIGINT AS lines, coalesce(n, 0)::BIGINT AS count FROM t LEFT JOIN l USING (process)""")
def process_results(spark, d):
    """Users as processes: their streamed lines, their purchases as output, exit codes and waiting times by id."""
    events = read(spark, d, "events")
    lines = _run(progress.events(_lines(_event_stream(spark, d)).join(events.select("event_id", "user_id"), "event_id")).select(F.col("user_id").alias("process")))
    u = F.col("process")
    processes = events.select(F.col("user_id").alias("process")).distinct().select("process", F.when(u % 5 != 0, u % 3).alias("exit_code"), F.when(u % 7 != 0, 30 * u).alias("waited"))
    return progress.final_events(processes, lines, events.where("event_type = 'purchase'").select(F.col("user_id").alias("process")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, d):
    events = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(state.windowed_counts(events, "ts", ["event_type"]), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


_LOCK = """WITH r AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
 n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r WHERE event_type <> 'signup')
 SELECT user_id, ts AS locked_at, ts + INTERVAL 15 MINUTE AS locked_until FROM n WHERE n % 10 = 0"""


@query(_LOCK)
def lockout_windows(spark, d):
    """Every event but a signup counts as a failed try."""
    tries = read(spark, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "signup").alias("success"))
    return state.lockouts(tries)


@query(_LOCK)
def stream_lockouts(spark, d):
    """The same from events that arrive late and out of order."""
    tries = _arriving(spark, d, 2).withColumn("success", F.col("event_type") == "signup")
    out = _run(state.lockout_stream(tries))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("locked_at", "locked_until")))


_EXPIRED = """WITH n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
 SELECT user_id AS key, ts AS last_at, ts + INTERVAL 24 HOUR AS expired_at FROM n WHERE next IS NULL OR next > ts + INTERVAL 24 HOUR"""


@query(_EXPIRED)
def expired_after_silence(spark, d):
    return state.expiries(read(spark, d, "events"))


@query(_EXPIRED)
def stream_expiry(spark, d):
    """Sessions that expire in a stream of late and unordered activity, by timers; nothing is kept of them."""
    out = _run(state.expiry_stream(_arriving(spark, d, 2 + state.EXPIRY_HOURS)))
    return out.select("key", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_at", "expired_at")))
