"""Structured Streaming: dedup, windows and heartbeat state over events (ts TIMESTAMP, user_id, event_type, value)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_only(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """At most one row of each key, told apart as long as the watermark keeps its state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


#: Groups of keys by their hash: state and timers cost about as much for a bucket as for a key, so that larger inputs may want more.
BUCKETS = 512


def _by_time(frames: Iterator[pd.DataFrame]) -> dict:
    """The (microseconds, event_id) of each key's rows in one batch, in order."""
    rows = defaultdict(list)
    for f in frames:
        for key, us, event in zip(f["user_id"].astype(object).tolist(), f["us"].tolist(), f["event_id"].tolist(), strict=True):
            rows[None if pd.isna(key) else int(key)].append((int(us), int(event)))
    return {k: sorted(v) for k, v in rows.items()}


def _stateful(events: DataFrame, late: str, schema: str, known: str, take: Callable, expire: Callable, buckets: int | None = None) -> DataFrame:
    """Rows of schema from take(what is known of a key or None, its rows of a batch in order): what is known then, what comes out, and the millisecond of its
    timer. Once the watermark passes that in a batch without rows of the key, expire(what is known) comes out and the key is forgotten.

    A bucket's state are its keys, their timers and a column of each value of known.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    state_schema = ", ".join(f"{n} array<{t}>" for n, t in (c.split() for c in f"key long, due long, {known}".split(", ")))

    def step(_bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = {k: (due, tuple(v)) for k, due, *v in zip(*state.get, strict=True)} if state.exists else {}
        rows = {} if state.hasTimedOut else _by_time(frames)
        now, out = state.getCurrentWatermarkMs(), []
        for k in [k for k, (due, _) in keys.items() if due < now and k not in rows]:
            out += [(k, *x) for x in expire(keys.pop(k)[1])]
        for k, mine in rows.items():
            value, found, due = take(keys[k][1] if k in keys else None, mine)
            keys[k] = (max(due, now + 1), value)
            out += [(k, *x) for x in found]
        if keys:
            state.update(tuple(list(c) for c in zip(*((k, due, *value) for k, (due, value) in keys.items()), strict=True)))
            state.setTimeoutTimestamp(max(now + 1, min(due for due, _ in keys.values())))
        else:
            state.remove()
        yield pd.DataFrame(out, columns=columns).astype("Int64")

    rows = events.withWatermark("ts", late).select("user_id", "event_id", F.unix_micros("ts").alias("us"), "ts", F.pmod(F.hash("user_id"), F.lit(buckets or BUCKETS)).alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


SILENCE = "user_id long, silent_us long"


def silences(events: DataFrame, ttl_ms: int, late: str) -> DataFrame:
    """Per worker each moment at which its last beat was ttl_ms old: seen at the next beat, or by a timer once the watermark passes it."""

    def take(known: tuple | None, rows: list[tuple[int, int]]) -> tuple:
        last, found = known[0] if known else None, []
        for us, _ in rows:
            if last is not None and us - last > ttl_ms * 1000:
                found.append((last + ttl_ms * 1000,))
            last = us
        return (last,), found, last // 1000 + ttl_ms

    def expire(known: tuple) -> list[tuple]:
        return [(known[0] + ttl_ms * 1000,)]  # a worker that comes back begins anew

    return _stateful(events, late, SILENCE, "last long", take, expire)


RETRY = "user_id long, event_id long, due_us long, attempt long"


def retries(errors: DataFrame, delay_ms: int = 30_000, most: int = 2, counter_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Failed tasks that are tried again after delay_ms, each key most times; a timer drops its counter once it is counter_ms old."""

    def take(known: tuple | None, rows: list[tuple[int, int]]) -> tuple:
        attempts, last = known or (0, None)
        out = []
        for us, event in rows:
            attempts = 0 if last is not None and us - last > counter_ms * 1000 else attempts
            last = us
            if attempts < most:
                attempts += 1
                out.append((event, us + delay_ms * 1000, attempts))
        return (attempts, last), out, last // 1000 + counter_ms + 1

    return _stateful(errors, late, RETRY, "attempts long, last long", take, lambda known: [])


GRANT = "user_id long, us long"


def locks(events: DataFrame, life_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """The requests that get a key's lock: the first, and later ones once the lock is life_ms old; a timer drops old locks."""

    def take(known: tuple | None, rows: list[tuple[int, int]]) -> tuple:
        until, out = known[0] if known else None, []
        for us, _ in rows:
            if until is None or us >= until:
                until = us + life_ms * 1000
                out.append((us,))
        return (until,), out, until // 1000 + 1

    return _stateful(events, late, GRANT, "until long", take, lambda known: [])
