"""Streaming queries: the events table is replayed through a file source and must give the batch result."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import ordered
from scoreloom.plans.registry import query
from scoreloom.session import table
from scoreloom.sources.files import scratch
from scoreloom.streaming import processors, sinks, states

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
STORE, IDLE = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"


def events_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


class Replay:
    """Rows with a time ts, put into a folder in so many parts, each later than those before; with tick, a last part moves the watermark on.

    A query takes each part in a run of its own, which begins where the last one ended: neither names nor time
    stamps of files decide what comes first. The tick is a row whose columns are null but for its time, so far after the last one, and those of tick_row.
    """

    def __init__(self, rows: DataFrame, parts: int = 3, tick: timedelta | None = None, tick_row: dict | None = None):
        self.rows, self.path, self.spark = rows, scratch(rows.sparkSession), rows.sparkSession
        self.tick, self.tick_row, self.n = tick, tick_row or {}, parts

    def parts(self):
        ends = self.rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        if ends["lo"] is None:
            yield self.rows
            return
        step = (ends["hi"] - ends["lo"]) / self.n
        for k in range(self.n):
            before = (F.col("ts") < ends["lo"] + (k + 1) * step) if k < self.n - 1 else F.lit(True)
            yield self.rows.where((F.col("ts") >= ends["lo"] + k * step) & before)
        if self.tick:
            known = {"ts": ends["hi"] + self.tick} | self.tick_row
            yield self.spark.range(1).select(*[F.lit(known.get(c)).cast(t).alias(c) for c, t in self.rows.dtypes])

    def run(self, step: Callable[[DataFrame], DataFrame], mode: str, put: Callable[[DataFrame, int], None], idle: bool = True) -> None:
        """step over the stream, each batch given to put; idle: batches without rows may follow a part, which would never end where the clock counts."""
        state = scratch(self.spark)
        for part in self.parts():
            part.write.mode("append").parquet(self.path)
            with settings(self.spark, **{STORE: processors.PROVIDER, IDLE: str(idle).lower()}):
                stream = step(self.spark.readStream.schema(self.rows.schema).parquet(self.path))
                stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Settings for queries started inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def drained(replay: Replay, step: Callable[[DataFrame], DataFrame], mode: str, schema: str, idle: bool = True) -> DataFrame:
    """All rows that the stream puts out until its input is used up, with the number of the batch they came in."""
    out = scratch(replay.spark)
    replay.run(step, mode, sinks.by_batch(out), idle)
    return sinks.batches(replay.spark, out, schema)


@query("r06_first_only", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def r06(spark: SparkSession, d: str) -> DataFrame:
    out = drained(Replay(events_of(spark, d)), lambda s: states.first_only(s, ["user_id", "event_type"]), "append", EVENT)
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("r07_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def r07(spark: SparkSession, d: str) -> DataFrame:
    counts = lambda s: states.window_counts(s, "1 hour", "1 day").select(F.col("window.start").alias("start"), "event_type", "n", "total")
    out = drained(Replay(events_of(spark, d)), counts, "update", "start timestamp, event_type string, n long, total double")
    last = ordered.latest(out, ["start", "event_type"], "batch")
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("r02_heartbeats", "SELECT user_id, count(*) AS beats, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1")
def r02(spark: SparkSession, d: str) -> DataFrame:
    """The state per worker; it lives a day of the clock."""
    out = drained(Replay(events_of(spark, d)), lambda s: processors.heartbeats(s, 86_400_000), "update", processors.BEAT, idle=False)
    last = ordered.latest(out, ["user_id"], "batch", "beats")
    return last.select("user_id", "beats", "last_us")


@query("r10_result_log", "SELECT event_id, event_type FROM events WHERE value > 50")
def r10(spark: SparkSession, d: str) -> DataFrame:
    """A log of JSON lines, a folder a batch."""
    out = scratch(spark)
    Replay(events_of(spark, d)).run(lambda s: s.where("value > 50"), "append", sinks.by_batch(out, "json"))
    return sinks.batches(spark, out, EVENT, "json").select("event_id", "event_type")


@query("r03_silences", "WITH l AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) SELECT user_id, epoch_us(ts) + 86400000000 AS silent_us FROM l WHERE n - ts > INTERVAL 1 DAY OR n IS NULL AND ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def r03_stream(spark: SparkSession, d: str) -> DataFrame:
    """Workers silent for a day; the last silence of each is told by a timer."""
    return drained(Replay(events_of(spark, d)), lambda s: states.silences(s, 86_400_000, "1 hour"), "append", states.SILENCE).select("user_id", "silent_us")


@query(
    "r03_restarts",
    """WITH w AS (SELECT c_custkey AS user_id, epoch_us(TIMESTAMP '2024-01-01') + c_custkey % 7 * 86400000000 AS start FROM customer WHERE c_custkey % 4 <> 3),
    e AS (SELECT user_id, epoch_us(ts) AS us, event_type = 'error' AS error, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
    s AS (SELECT user_id, 0 AS seg, NULL AS beat FROM w UNION ALL SELECT user_id, seg, us FROM e WHERE NOT error), n AS (SELECT *, lead(beat) OVER (PARTITION BY user_id ORDER BY seg) AS next FROM s),
    x AS (SELECT user_id, seg, min(us) AS error FROM e WHERE error GROUP BY 1, 2),
    a AS (SELECT user_id, next, error, greatest(coalesce(beat + 86400000000, start + 43200000000), start + 43200000000) AS due FROM n JOIN w USING (user_id) LEFT JOIN x USING (user_id, seg)),
    t AS (SELECT user_id, next, CASE WHEN error <= due THEN error WHEN next IS NULL OR due < next THEN due END AS decided_us, CASE WHEN error <= due THEN 'cuda_error' ELSE 'heartbeat' END AS reason FROM a)
    SELECT user_id, decided_us, reason, CASE WHEN next <= decided_us + 3600000000 THEN 'skipped' ELSE 'restart' END AS action FROM t WHERE decided_us IS NOT NULL""",
)
def r03_restarts(spark: SparkSession, d: str) -> DataFrame:
    """Restarts of expected workers: the beats are events, errors shut a worker down; limits are longer, as the events are sparse."""
    start = F.lit(1_704_067_200_000_000) + F.col("c_custkey") % 7 * 86_400_000_000
    expected = table(spark, d, "customer").where("c_custkey % 4 <> 3").select(F.col("c_custkey").alias("user_id"), start.alias("start_us"))
    monitor = lambda s: processors.worker_monitor(s, expected, "event_type = 'error'", 86_400_000_000, 43_200_000_000, 3_600_000_000, "1 hour")
    return drained(Replay(events_of(spark, d), tick=timedelta(days=40)), monitor, "append", processors.RESTART).drop("batch")


@query(
    "r05_retries",
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS attempt FROM s)
    SELECT user_id, event_id, epoch_us(ts) + 30000000 AS due_us, attempt FROM r WHERE attempt <= 2""",
)
def r05_stream(spark: SparkSession, d: str) -> DataFrame:
    retries = lambda s: states.retries(s.where("event_type = 'error'"), counter_ms=86_400_000)
    return drained(Replay(events_of(spark, d)), retries, "append", states.RETRY).select("user_id", "event_id", "due_us", "attempt")


@query(
    "r05_patterns",
    """WITH e AS (SELECT event_id, user_id % 5 AS code, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type = 'error' AND value > 20 WINDOW w AS (PARTITION BY user_id % 5 ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY code ORDER BY ts, event_id) AS session FROM e) SELECT code, event_id, row_number() OVER (PARTITION BY code, session ORDER BY ts, event_id) AS n_errors FROM s""",
)
def r05_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Memory errors by code, counted while none is a day older than the next."""
    rows = events_of(spark, d).where("event_type = 'error' AND value > 20").select(F.expr("user_id % 5").alias("code"), "event_id", "ts")
    return drained(Replay(rows, tick=timedelta(days=40)), processors.error_patterns, "append", processors.PATTERN).drop("batch")


@query("r07_trailing", """SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER w AS n_trailing, count(*) FILTER (event_type = 'error') OVER w >= 2 AS alert FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)""")
def r07_trailing(spark: SparkSession, d: str) -> DataFrame:
    """At every event, its worker's errors of the five minutes up to it, as w01 has them."""
    counts = lambda s: processors.trailing_counts(s, "event_type = 'error'", alert=2)
    return drained(Replay(events_of(spark, d), tick=timedelta(days=1)), counts, "append", processors.COUNTED).where("user_id IS NOT NULL").select("event_id", "user_id", "n_trailing", "alert")


@query(
    "r09_locks",
    """WITH RECURSIVE g(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT e.user_id, min(e.ts) FROM g JOIN events e ON e.user_id = g.user_id AND e.ts >= g.ts + INTERVAL 1 DAY GROUP BY e.user_id)
    SELECT user_id, epoch_us(ts) AS us FROM g""",
)
def r09_stream(spark: SparkSession, d: str) -> DataFrame:
    return drained(Replay(events_of(spark, d)), lambda s: states.locks(s, 86_400_000), "append", states.GRANT).select("user_id", "us")


@query(
    "r01_consumed",
    """WITH t AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'worker:' || user_id WHEN value > 50 THEN 'gpu' ELSE 'cpu' END AS queue, event_id, ts, CAST(event_id % 3 AS INT) AS priority FROM events WHERE event_type = 'purchase'),
    n AS (SELECT queue, event_id, ts, row_number() OVER (PARTITION BY queue ORDER BY priority, ts, event_id) AS place, row_number() OVER (PARTITION BY queue ORDER BY ts, event_id) AS turn FROM t)
    SELECT a.queue, a.event_id AS ask_id, b.event_id AS task_id, epoch_us(a.ts) + 60 * 86400000000 AS answered_us FROM n a JOIN n b ON a.queue = b.queue AND a.turn = b.place
    UNION ALL SELECT queue, 1000000 + event_id, NULL, epoch_us(ts) + 120 * 86400000000 + 1000000 FROM t WHERE event_id % 10 = 0""",
)
def r01_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every task is put in twice and taken once, by priority, then arrival, by asks that come later; asks of an empty queue give up after a second."""
    tasks = events_of(spark, d).where("event_type = 'purchase'")
    queue = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("worker:"), F.col("user_id").cast("string"))).when(F.col("value") > 50, "gpu").otherwise("cpu")
    rows = tasks.select(queue.alias("queue"), "event_id", "ts", F.lit(False).alias("ask"), (F.col("event_id") % 3).cast("int").alias("priority"))
    asks = rows.withColumns({"ts": F.expr("ts + INTERVAL 60 DAYS"), "ask": F.lit(True)})
    vain = rows.where("event_id % 10 = 0").withColumns({"ts": F.expr("ts + INTERVAL 120 DAYS"), "ask": F.lit(True), "event_id": F.col("event_id") + 1_000_000})
    all_rows = rows.unionByName(rows).unionByName(asks).unionByName(vain)
    out = drained(Replay(all_rows, parts=4, tick=timedelta(days=1)), lambda s: processors.consumed(s, 1_000_000), "append", processors.TAKEN)
    return out.where("queue IS NOT NULL").drop("batch")


@query(
    "r04_overdue",
    """SELECT user_id AS worker, event_id AS task_id, epoch_us(ts) AS submitted_us, CASE WHEN user_id % 7 = 0 THEN 'stale_assignment' ELSE 'queue_wait_timeout' END AS reason FROM events s WHERE event_type = 'view'
    AND (user_id % 7 = 0 OR NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.user_id = s.user_id AND a.ts >= s.ts AND a.ts <= s.ts + INTERVAL 1 DAY))""",
)
def r04_stream(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that wait for more than a day go back into the queue, at most 200 of a worker at once; those of a wrong worker at once."""

    def step(s: DataFrame) -> DataFrame:
        submitted = s.where("event_type = 'view' OR event_type IS NULL").select(F.col("user_id").alias("worker"), F.col("event_id").alias("task_id"), F.col("ts").alias("submitted"))
        assigned = s.where("event_type = 'purchase' OR event_type IS NULL").select(F.col("user_id").alias("by"), F.col("ts").alias("assigned"))
        return processors.overdue(submitted, assigned, "1 DAY", "coalesce(worker % 7 = 0, false)")

    out = scratch(spark)
    requeue = sinks.Requeue(out, processors.WAITED, "worker", ["submitted", "task_id"])
    Replay(events_of(spark, d), tick=timedelta(days=40), tick_row={"user_id": -1}).run(step, "append", requeue)  # a null key would not reach the join and its watermarks
    requeue.drain(spark)
    rows = sinks.batches(spark, f"{out}/requeued", processors.WAITED)
    return rows.select("worker", "task_id", F.unix_micros("submitted").alias("submitted_us"), "reason")
