"""Stateful processors against plain versions, sinks that run a batch twice, and parts whose files have odd time stamps."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row

from scoreloom.plans import streams
from scoreloom.sources.files import scratch
from scoreloom.streaming import processors, sinks, states

START = datetime(2024, 1, 1)
ROW = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, rows):
    """(event_id, second, user_id, event_type) as a table."""
    return spark.createDataFrame([(i, START + timedelta(seconds=s), u, kind, 0.0) for i, s, u, kind in rows], ROW)


def some(n, seed=1, users=3, span=2000):
    r = random.Random(seed)
    return [(i, r.randrange(span), r.randrange(users), r.choice(["error", "view", "view"])) for i in range(n)]


def test_trailing_counts_with_files_in_any_order(spark, monkeypatch):
    """Time stamps of files are turned round before each run."""
    rows = some(150)
    replay = streams.Replay(events(spark, rows), tick=timedelta(days=1))
    plain = replay.run

    def parts():
        for k, part in enumerate(streams.Replay.parts(replay)):
            for f in Path(replay.path).rglob("*.parquet") if k else []:
                os.utime(f, (2_000_000_000 - k * 1000,) * 2)
            yield part

    monkeypatch.setattr(replay, "parts", parts)
    out = scratch(spark)
    plain(lambda s: processors.trailing_counts(s, "event_type = 'error'", alert=3), "append", sinks.by_batch(out))
    got = {r["event_id"]: (r["n_trailing"], r["alert"]) for r in sinks.batches(spark, out, processors.COUNTED).where("user_id IS NOT NULL").collect()}
    assert len(got) == 150
    for i, s, u, _ in rows:
        n = sum(v == u and kind == "error" and s - 300 < t <= s for _, t, v, kind in rows)
        assert got[i] == (n, n >= 3)


def plain_queue(rows, timeout):
    """(ask, task, second) of (second, id, ask, priority) in order."""
    tasks, asks, out = [], [], set()
    for s, i, ask, priority in [*sorted(rows), (10**9, None, None, None)]:
        while asks and asks[0][0] + timeout < s:
            t, a = asks.pop(0)
            out.add((a, None, t + timeout))
        if i is None:
            break
        if ask and tasks:
            best = min(tasks)
            tasks.remove(best)
            out.add((i, best[2], s))
        elif ask:
            asks.append((s, i))
        elif asks:
            out.add((asks.pop(0)[1], i, s))
        else:
            tasks.append((priority, s, i))
    return out


def test_a_blocking_queue_answers_by_priority_and_gives_up_in_time(spark):
    r = random.Random(7)
    rows = [(r.randrange(600), i, r.random() < 0.5, r.randrange(3), f"q{r.randrange(2)}") for i in range(120)]
    table = spark.createDataFrame([(q, i, START + timedelta(seconds=s), ask, p) for s, i, ask, p, q in rows] * 2, "queue string, event_id long, ts timestamp, ask boolean, priority int")
    replay = streams.Replay(table, tick=timedelta(days=1))
    out = streams.drained(replay, lambda s: processors.consumed(s, 20_000_000, "1 hour"), "append", processors.TAKEN).where("queue IS NOT NULL").collect()
    by = defaultdict(set)
    zero = table.selectExpr("min(unix_seconds(ts)) AS s").first()["s"] - min(x[0] for x in rows)
    for x in out:
        by[x["queue"]].add((x["ask_id"], x["task_id"], x["answered_us"] // 1_000_000 - zero))
    for q in ("q0", "q1"):
        assert by[q] == plain_queue([x[:4] for x in rows if x[4] == q], 20)
    assert any(x["task_id"] is None for x in out) and max(Counter(x["task_id"] for x in out if x["task_id"] is not None).values()) == 1


def test_no_beat_is_lost_when_parts_come_last_first(spark):
    rows = some(90, 3)
    late, early = events(spark, [x for x in rows if x[1] >= 1000]), events(spark, [x for x in rows if x[1] < 1000])
    replay = streams.Replay(late)
    replay.parts = lambda: iter([late, early])
    out = streams.drained(replay, lambda s: processors.heartbeats(s, 86_400_000), "update", processors.BEAT, idle=False).collect()
    last = {r["user_id"]: r["beats"] for r in sorted(out, key=lambda r: r["batch"])}
    assert last == dict(Counter(u for _, _, u, _ in rows))


def test_a_batch_that_fails_and_runs_again_is_written_once(spark):
    replay = streams.Replay(events(spark, some(60, 5)), parts=1)
    next(iter(replay.parts())).write.parquet(replay.path)
    out, state, failed = scratch(spark), scratch(spark), []

    def put(batch, number):
        sinks.by_batch(out, "json")(batch, number)
        if not failed:
            failed.append(number)
            raise ValueError("the sink fails after it has written")

    def run():
        stream = spark.readStream.schema(replay.rows.schema).parquet(replay.path)
        stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    run()
    rows = sinks.batches(spark, out, ROW, "json").collect()
    assert failed == [0] and sorted(r["event_id"] for r in rows) == list(range(60))


def test_a_scan_requeues_so_many_of_a_worker_and_keeps_the_rest(spark):
    schema = "worker long, task_id long, submitted timestamp, reason string"
    rows = lambda ids: spark.createDataFrame([(i % 2, i, START + timedelta(seconds=i), "x") for i in ids], schema)
    out = scratch(spark)
    sink = sinks.Requeue(out, schema, "worker", ["submitted", "task_id"], most=3)
    sink(rows(range(10)), 0)
    sink(rows(range(10, 14)), 1)
    sink(rows(range(10, 14)), 1)  # again
    sink.drain(spark)
    got = sinks.batches(spark, f"{out}/requeued", schema).collect()
    assert sorted(r["task_id"] for r in got) == list(range(14))
    assert max(Counter((r["batch"], r["worker"]) for r in got).values()) == 3
    for worker in (0, 1):
        mine = [r["task_id"] for r in sorted(got, key=lambda r: (r["batch"], r["task_id"])) if r["worker"] == worker]
        assert mine == sorted(mine)


def test_overdue_submissions_take_one_look_at_each():
    """One worker, 100,000 submissions within the limit of 100,000 assignments: pairs of them would be 10^10. Ends of the limit count, as does an assignment of the same moment."""
    step = processors.Overdue(100)
    assert step.take((1,), None, [(0, 1, False), (100, 0, True), (200, 2, False), (301, 0, True), (400, 0, True), (400, 3, False)], 450)[1] == [Row(worker=1, task_id=2, submitted_us=200)]
    many = sorted([(i, i, False) for i in range(100_000)] + [(i, 0, True) for i in range(100_000)])
    known, out, due = processors.Overdue(10**9).take((1,), None, [*many, (100_000, 7, False)], 200_000)
    assert not out and known == ([(100_000, 7)],) and due == 100_000 + 10**9
    assert processors.Overdue(10**9).take((1,), known, [], 10**10) == (None, [Row(worker=1, task_id=7, submitted_us=100_000)], None)


def test_a_worker_that_beats_again_is_not_restarted(spark):
    rows = [(1, 100, 1, "view"), (2, 200, 1, "error"), (3, 220, 1, "view"), (4, 300, 1, "error"), (5, 310, 1, "error"), (6, 500, 2, "error"), (7, 50, 9, "view")]
    zero = events(spark, [(0, 0, 0, "x")]).selectExpr("unix_micros(ts) AS us").first()["us"]
    expected = spark.createDataFrame([(1, zero), (2, zero), (3, zero)], "user_id long, start_us long")
    step = lambda s: processors.worker_monitor(s, expected, "event_type = 'error'", 120_000_000, 90_000_000, 30_000_000)
    out = streams.drained(streams.Replay(events(spark, rows), tick=timedelta(days=1)), step, "append", processors.RESTART).collect()
    got = sorted((r["user_id"], (r["decided_us"] - zero) // 1_000_000, r["reason"], r["action"]) for r in out)
    assert got == [(1, 90, "heartbeat", "skipped"), (1, 200, "cuda_error", "skipped"), (1, 300, "cuda_error", "restart"), (2, 90, "heartbeat", "restart"), (3, 90, "heartbeat", "restart")]


def test_keys_of_one_bucket_are_kept_apart(spark, monkeypatch):
    """Silences, locks and retries of many keys in few buckets, over parts in which some have no rows, against plain versions."""
    monkeypatch.setattr(states, "BUCKETS", 3)
    rows = some(200, 11, users=40, span=9000)
    table = events(spark, rows)
    by = defaultdict(list)
    for i, s, u, _ in sorted(rows, key=lambda x: (x[1], x[0])):
        by[u].append((s, i))
    zero = table.selectExpr("min(unix_seconds(ts)) AS s").first()["s"] - min(x[1] for x in rows)

    def ran(step, schema):
        return streams.drained(streams.Replay(table), step, "append", schema).collect()

    end = max(x[1] for x in rows)
    silent = {(u, s + 600) for u, mine in by.items() for (s, _), (n, _) in zip(mine, [*mine[1:], (None, None)], strict=True) if (n is None and s + 600 <= end - 60) or (n is not None and n - s > 600)}
    got = ran(lambda s: states.silences(s, 600_000, "1 minute"), states.SILENCE)
    assert sorted((r["user_id"], r["silent_us"] // 1_000_000 - zero) for r in got) == sorted(silent)
    granted = set()
    for u, mine in by.items():
        until = None
        for s, _ in mine:
            if until is None or s >= until:
                granted.add((u, s))
                until = s + 600
    got = ran(lambda s: states.locks(s, 600_000), states.GRANT)
    assert sorted((r["user_id"], r["us"] // 1_000_000 - zero) for r in got) == sorted(granted)


def test_processors_keep_keys_of_one_bucket_apart(spark, monkeypatch):
    monkeypatch.setattr(processors, "BUCKETS", 2)
    rows = some(150, 13, users=30)
    out = streams.drained(streams.Replay(events(spark, rows), tick=timedelta(days=1)), lambda s: processors.trailing_counts(s, "event_type = 'error'", alert=2), "append", processors.COUNTED)
    got = sorted((r["event_id"], r["n_trailing"]) for r in out.where("user_id IS NOT NULL").collect())
    assert got == sorted((i, sum(v == u and kind == "error" and s - 300 < t <= s for _, t, v, kind in rows)) for i, s, u, _ in rows)
