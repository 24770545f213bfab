"""Stateful processors of keyed streams, for transformWithState in event time with the RocksDB state store.

Each keeps arrivals in a list state until the watermark has passed them and then takes them in the order of (microseconds, event_id),
so that neither the order of files nor that of rows in a batch matters. Keys share buckets by their hash, as each access to a state and each timer
costs about as much for a bucket as for a key. One timer a bucket wakes it when something is due.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, GroupedData, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys; each is read and written at once, so that larger inputs may want more.
BUCKETS = 512


class InOrder(StatefulProcessor):
    """Takes each key's rows in time order. Subclasses name the key and their arrivals' schema (us and event_id first) and say what to do at each and by when."""

    key = "user_id long"
    arrival = "us long, event_id long"
    value = "n long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"{self.key}, {self.arrival}")
        self.memory = handle.getListState("memory", f"{self.key}, {self.value}")
        self.timer = handle.getValueState("timer", "at long")

    def take(self, key: tuple, known: Any, rows: list[tuple], now: int) -> tuple[Any, list[Row], int | None]:
        """From what is known of a key (None at first), its rows before now in order, and now in microseconds: what is known then, what comes out, and when to
        wake again. It may also be called when nothing of the key is due."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        names = [c.split()[0] for c in f"{self.key}, {self.arrival}".split(", ")]
        new, pick = [], None
        for r in rows:
            pick = pick or itemgetter(*[r.__fields__.index(n) for n in names])
            new.append(pick(r))
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[1] for r in new))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = defaultdict(list), []
        for r in map(tuple, self.waiting.get()):
            if r[1] < now:
                ready[r[0]].append(r[1:])
            else:
                rest.append(r)
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        known = {m[0]: tuple(m[1:]) for m in self.memory.get()}
        kept, found, wake = [], [], [r[1] for r in rest]
        for k in known | ready:
            value, out, due = self.take((k,), known.get(k), sorted(ready.get(k, ())), now)
            found += out
            if value is not None:
                kept.append((k, *value))
            if due is not None:
                wake.append(due)
        if known:
            self.memory.clear()
        if kept:
            self.memory.appendList(kept)
        if wake:
            self._wake(min(wake))
        return iter(found)

    def _wake(self, us: int) -> None:
        """Sets the bucket's timer to the millisecond after us, unless it is set to an earlier one."""
        at = us // 1000 + 1
        if self.timer.exists():
            if (known := self.timer.get()[0]) <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def _by_bucket(rows: DataFrame, processor: InOrder, buckets: int | None) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.hash(processor.key.split()[0]), F.lit(buckets or BUCKETS))).groupBy("bucket")


def run(rows: DataFrame, late: str | None, processor: InOrder, schema: str, initial: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """rows (key, ts, us and the processor's columns) through the processor; initial has one row a key. Rows without late have a watermark."""
    keyed = _by_bucket(rows.withWatermark("ts", late) if late else rows, processor, buckets)
    return keyed.transformWithState(processor, schema, "append", "eventTime", _by_bucket(initial, processor, buckets) if initial is not None else None)


COUNTED = "user_id long, event_id long, n_trailing long, alert boolean"


class TrailingCounts(InOrder):
    """Each row with the marked rows of its key in the span up to it, its far end excluded, and whether they are `alert` or more."""

    arrival, value = "us long, event_id long, marked boolean", "times array<long>"

    def __init__(self, span_us: int, alert: int):
        self.span, self.alert = span_us, alert

    def take(self, key, known, rows, now):
        times = list(known[0]) if known else []
        out, i, done = [], 0, 0
        while i < len(rows):
            us, same = rows[i][0], i
            while i < len(rows) and rows[i][0] == us:  # rows of one moment count each other
                if rows[i][2]:
                    times.append(us)
                i += 1
            while done < len(times) and times[done] <= us - self.span:
                done += 1
            n = len(times) - done
            out += [Row(user_id=key[0], event_id=r[1], n_trailing=n, alert=n >= self.alert) for r in rows[same:i]]
        times = [t for t in times[done:] if t > now - self.span]
        return ((times,) if times else None), out, (times[-1] + self.span if times else None)


def trailing_counts(events: DataFrame, marked: str, span_us: int = 300_000_000, alert: int = 50, late: str = "10 minutes") -> DataFrame:
    """COUNTED for every row of events (user_id, event_id, ts, ...), once the watermark has passed it."""
    rows = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), F.expr(marked).alias("marked"))
    return run(rows, late, TrailingCounts(span_us, alert), COUNTED)


RESTART = "user_id long, decided_us long, reason string, action string"


class WorkerMonitor(InOrder):
    """Decides when a worker must restart: at an error that shuts it down, or once its last beat is ttl_us old, which counts from the end
    of a grace of grace_us after its start at the earliest. Until the next beat nothing more is decided. A decision is carried out after settle_us,
    or skipped if the worker beats again before. Only workers of the initial state are judged.
    """

    arrival, value = "us long, event_id long, error boolean", "start long, last long, told boolean, decided long, reason string"

    def __init__(self, ttl_us: int, grace_us: int, settle_us: int):
        self.ttl, self.grace, self.settle = ttl_us, grace_us, settle_us

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.memory.appendValue((initialState.user_id, initialState.start_us, None, False, None, None))
        self._wake(initialState.start_us + self.grace)

    def take(self, key, known, rows, now):
        if known is None:  # not expected
            return None, [], None
        start, last, told, decided, reason = known
        out: list[Row] = []

        def due() -> int:
            return start + self.grace if last is None else max(last + self.ttl, start + self.grace)

        def put(action: str) -> None:
            nonlocal decided, reason
            out.append(Row(user_id=key[0], decided_us=decided, reason=reason, action=action))
            decided = reason = None

        def pass_time(us: int) -> None:
            nonlocal told, decided, reason
            if not told and due() < us:
                told, decided, reason = True, due(), "heartbeat"
            if decided is not None and decided + self.settle < us:
                put("restart")

        for us, _, error in rows:
            pass_time(us)
            if error:
                if not told:
                    told, decided, reason = True, us, "cuda_error"
                continue
            if decided is not None:
                put("skipped")
            last, told = us, False
        pass_time(now)
        wake = decided + self.settle if decided is not None else None if told else due()
        return (start, last, told, decided, reason), out, wake


def worker_monitor(events: DataFrame, expected: DataFrame, error: str, ttl_us: int = 120_000_000, grace_us: int = 90_000_000, settle_us: int = 0, late: str = "10 minutes") -> DataFrame:
    """RESTART of the workers in expected (user_id, start_us) by their beats and errors (events: user_id, event_id, ts, ...)."""
    rows = events.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"), F.expr(error).alias("error"))
    return run(rows, late, WorkerMonitor(ttl_us, grace_us, settle_us), RESTART, expected.select("user_id", "start_us"))


TAKEN = "queue string, ask_id long, task_id long, answered_us long"


class BlockingQueue(InOrder):
    """Answers asks from a queue: each gets the waiting task first in priority, then arrival; without one it waits for the next
    task, at most timeout_us, and is then answered with none. Asks wait in the order they came in."""

    key = "queue string"
    arrival, value = "us long, event_id long, ask boolean, priority int", "tasks array<struct<priority:int,us:long,id:long>>, asks array<struct<us:long,id:long>>"

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def take(self, key, known, rows, now):
        import heapq

        tasks = [tuple(t) for t in known[0]] if known else []
        asks = deque(tuple(a) for a in known[1]) if known else deque()
        heapq.heapify(tasks)
        out: list[Row] = []

        def answer(ask: tuple[int, int], task: int | None, us: int) -> None:
            out.append(Row(queue=key[0], ask_id=ask[1], task_id=task, answered_us=us))

        def pass_time(us: int) -> None:
            while asks and asks[0][0] + self.timeout < us:
                first = asks.popleft()
                answer(first, None, first[0] + self.timeout)

        for us, event, ask, priority in rows:
            pass_time(us)
            if ask and tasks:
                answer((us, event), heapq.heappop(tasks)[2], us)
            elif ask:
                asks.append((us, event))
            elif asks:
                answer(asks.popleft(), event, us)
            else:
                heapq.heappush(tasks, (priority, us, event))
        pass_time(now)
        return ((tasks, list(asks)) if tasks or asks else None), out, (asks[0][0] + self.timeout if asks else None)


def consumed(rows: DataFrame, timeout_us: int, late: str = "10 minutes") -> DataFrame:
    """TAKEN of rows (queue, event_id, ts, ask, priority): tasks put into queues and the asks of workers; a task put in again is one task."""
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["queue", "ask", "event_id"])
    rows = once.select("queue", "event_id", "ts", F.unix_micros("ts").alias("us"), "ask", "priority")
    return run(rows, None, BlockingQueue(timeout_us), TAKEN)


BEAT = "user_id long, beats long, last_us long"


class Heartbeats(StatefulProcessor):
    """Beats so far and the last one of a worker; what is known of it lives ttl_ms of the clock after its last batch."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "beats long, last long", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        beats, last = self.known.get() if self.known.exists() else (0, 0)
        for r in rows:
            beats, last = beats + 1, max(last, r.us)
        self.known.update((beats, last))
        yield Row(user_id=key[0], beats=beats, last_us=last)

    def close(self) -> None:
        pass


def heartbeats(events: DataFrame, ttl_ms: int = 120_000) -> DataFrame:
    """BEAT whenever a worker beats. There is no watermark, so no beat is late, whatever order files come in."""
    rows = events.select("user_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithState(Heartbeats(ttl_ms), BEAT, "update", "processingTime")


WAITED = "worker long, task_id long, submitted timestamp, reason string"


class Overdue(InOrder):
    """Submissions that no assignment of their worker follows within limit_us, both ends included. An assignment answers all that wait, so that each is
    looked at twice, however many a worker has. A null worker has no assignments."""

    key, arrival, value = "worker long", "us long, event_id long, assigned boolean", "waits array<struct<us:long,id:long>>"

    def __init__(self, limit_us: int):
        self.limit = limit_us

    def take(self, key, known, rows, now):
        waits = deque(tuple(w) for w in known[0]) if known else deque()
        out: list[Row] = []

        def pass_time(us: int) -> None:
            while waits and waits[0][0] + self.limit < us:
                first = waits.popleft()
                out.append(Row(worker=key[0], task_id=first[1], submitted_us=first[0]))

        for us, task, assigned in sorted(rows, key=lambda r: (r[0], r[2])):  # an assignment comes after the submissions of its moment
            pass_time(us)
            if assigned:
                waits.clear()
            else:
                waits.append((us, task))
        pass_time(now)
        return ((list(waits),) if waits else None), out, (waits[0][0] + self.limit if waits else None)


def overdue(submitted: DataFrame, assigned: DataFrame, limit: str, stale: str, late: str = "1 hour") -> DataFrame:
    """WAITED: submissions (worker, task_id, submitted) that no assignment (by, assigned) of their worker follows within limit, once the
    watermark of both streams has passed it, and at once those for which `stale` holds.

    The state are the submissions that still wait; a join of the streams would make all pairs of a worker's submissions and assignments.
    """
    limit_us = submitted.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {limit})").first()[0]
    waits = submitted.where(f"NOT ({stale}) AND submitted IS NOT NULL").select("worker", F.col("task_id").alias("event_id"), F.col("submitted").alias("ts"), F.lit(False).alias("assigned"))
    done = assigned.where("by IS NOT NULL AND assigned IS NOT NULL").select(F.col("by").alias("worker"), F.lit(0).cast("long").alias("event_id"), F.col("assigned").alias("ts"), F.lit(True).alias("assigned"))
    rows = waits.unionByName(done).withColumn("us", F.unix_micros("ts"))
    late_ones = run(rows, late, Overdue(limit_us), "worker long, task_id long, submitted_us long")
    late_ones = late_ones.select("worker", "task_id", F.timestamp_micros("submitted_us").alias("submitted"), F.lit("queue_wait_timeout").alias("reason"))
    wrong = submitted.where(stale).select("worker", "task_id", "submitted", F.lit("stale_assignment").alias("reason"))
    return late_ones.unionByName(wrong)


PATTERN = "code long, event_id long, n_errors long"


class ErrorPatterns(InOrder):
    """Each error with the number of its code's errors so far; the count is forgotten once its last error is ttl_us old."""

    key, value = "code long", "n long, last long"

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def take(self, key, known, rows, now):
        n, last = known or (0, 0)
        out = []
        for us, event in rows:
            n = n + 1 if n and us - last <= self.ttl else 1
            last = us
            out.append(Row(code=key[0], event_id=event, n_errors=n))
        if n and last + self.ttl < now:
            return None, out, None
        return (n, last), out, last + self.ttl


def error_patterns(errors: DataFrame, ttl_us: int = 86_400_000_000, late: str = "10 minutes") -> DataFrame:
    """PATTERN of errors (code, event_id, ts)."""
    rows = errors.where("code IS NOT NULL OR event_id IS NULL").select("code", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return run(rows, late, ErrorPatterns(ttl_us), PATTERN)
