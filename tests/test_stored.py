"""Log tails, declared cases, stored tables, nested documents, intervals and percentiles against plain versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import stats
from scoreloom.operators import documents, joins, ordered
from scoreloom.plans import sources
from scoreloom.sources import cases, files, tables, tail


def tailed(reader, start, end):
    return [x for part in reader.partitions(start, end) for x in reader.read(part)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_a_tail_gives_each_whole_line_once(tmp_path, size):
    """Appends, a half line that is ended later, a file that comes later, one begun anew and one that is longer than before but another."""
    reader = tail.TailReader(str(tmp_path), size)
    at, got = reader.initialOffset(), []

    def batch():
        nonlocal at
        end = reader.latestOffset()
        lines = tailed(reader, at, end)
        at = json.loads(json.dumps(end))
        got.append(sorted((p.rsplit("/", 1)[1], line) for p, _, line in lines))

    a, b = tmp_path / "a.log", tmp_path / "sub" / "b.log"
    a.write_bytes("eins é\n\nzwei\nhal".encode())
    batch()
    a.write_bytes(a.read_bytes() + b"b\ndrei\n")
    b.parent.mkdir()
    b.write_bytes(b"x\n" * 5)
    (tmp_path / "_hidden").write_bytes(b"no\n")
    batch()
    batch()
    a.write_bytes(b"neu\n")
    b.write_bytes(b"y\n" * 9)
    batch()
    assert got == [
        [("a.log", ""), ("a.log", "eins é"), ("a.log", "zwei")], [("a.log", "drei"), ("a.log", "halb")] + [("b.log", "x")] * 5, [], [("a.log", "neu")] + [("b.log", "y")] * 9,
    ]


def test_small_files_share_a_task(tmp_path):
    """Tasks follow bytes, not files, and files that have not changed give none; the last whole line may end far before a file's end."""
    for k in range(500):
        (tmp_path / f"{k}.log").write_bytes(b"x\n" * (k % 3) + b"half" * (5000 if k == 7 else 1))
    reader = tail.TailReader(str(tmp_path), 1 << 20)
    end = reader.latestOffset()
    assert len(reader.partitions(reader.initialOffset(), end)) == 1
    assert len(tailed(reader, reader.initialOffset(), end)) == sum(k % 3 for k in range(500))
    assert reader.partitions(end, end) == []


def test_a_tail_of_nothing(tmp_path):
    reader = tail.TailReader(str(tmp_path / "none"), 10)
    assert reader.latestOffset() == {"files": {}} and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_tasks_of_a_worker_log_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(sources, "ROWS_A_TASK", 1000)
    rows = spark.range(5500).selectExpr("id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity", "true AS done")
    out = sources.worker_seconds(rows)
    assert out.count() == 5500 and out.rdd.getNumPartitions() == 6


def test_declared_cases(spark):
    def of(x):
        return [(r["idx"], r["name"], r["inputs"], r["outputs"], r["rtol"]) for r in spark.createDataFrame([(x,)], "d string").lateralJoin(cases.Cases(F.col("d").outer())).collect()]

    assert of('[1, {"input": [2], "output": 3, "rtol": 0.1}, {"name": "n", "inputs": null}, null]') == [
        (0, "case_0", "1", None, None), (1, "case_1", "[2]", "3", 0.1), (2, "n", None, None, None), (3, "case_3", None, None, None)]
    assert of('{"grid": {"m": [1, 2], "n": 5}, "repeat": 2}') == [(i, f"case_{i}", json.dumps({"m": i // 2 + 1, "n": 5}, separators=(",", ":")), None, None) for i in range(4)]
    assert of('{"name": "one", "inputs": 1}') == [(0, "one", "1", None, None)]
    for nothing in (None, "", "no json", "[]", "null", "import os"):
        assert of(nothing) == []
    cases.register(spark)
    assert spark.sql("SELECT count(*) AS n FROM VALUES ('[1,2]'), ('[]') t(d), LATERAL declared_cases(d)").first()["n"] == 2


def test_readers_of_a_stored_table_see_one_version(spark, tmp_path):
    stored = tables.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 8)
    assert stored.read().count() == 0
    rows = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v string")
    assert stored.upsert(rows(range(100), "old")) == 1
    before, folders = stored.read(), stored.folders()
    assert stored.upsert(rows([3, 200], "new")) == 2
    assert {r["v"] for r in before.collect()} == {"old"}  # its files still stand
    after = {r["k"]: r["v"] for r in stored.read().collect()}
    assert after == dict.fromkeys(range(100), "old") | {3: "new", 200: "new"}
    changed = [b for b, f in stored.folders().items() if folders.get(b) != f]
    assert 1 <= len(changed) <= 2
    assert {r["v"] for r in stored.read(1).collect()} == {"old"}
    assert stored.upsert(rows([], "x")) == 3 and stored.read().count() == 101


def test_a_second_writer_of_a_version_fails_and_changes_nothing(spark, tmp_path, monkeypatch):
    stored = tables.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 4)
    rows = lambda v: spark.createDataFrame([(1, v)], "k long, v string")
    stored.upsert(rows("a"))
    late = tables.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], 4)
    monkeypatch.setattr(late, "version", lambda: 1)
    stored.upsert(rows("b"))
    with pytest.raises(ValueError, match="written by another"):
        late.upsert(rows("c"))
    assert [r["v"] for r in stored.read().collect()] == ["b"]


def plain_leaves(value, path="$", names=(), depth=0):
    inner = list(value.items()) if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []
    if not inner:
        return [(path, names, depth, json.dumps(value) if isinstance(value, (dict, list)) else value)]
    return [x for k, v in inner for x in (plain_leaves(v, f"{path}.{k}", (*names, k), depth + 1) if isinstance(k, str) else plain_leaves(v, f"{path}[{k}]", names, depth + 1))]


def test_leaves_of_nested_documents(spark):
    r = random.Random(4)

    def some(depth):
        kind = r.random()
        if depth and kind < 0.35:
            return {k: some(depth - 1) for k in r.sample(["a", "b", "code", "d e"], r.randrange(4))}
        if depth and kind < 0.7:
            return [some(depth - 1) for _ in range(r.randrange(4))]
        return r.choice([1, "x[{", True, None, "é", -7])

    values = [some(9) for _ in range(80)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, "no json"), (1001, None)], "id long, document string")
    got = documents.leaves(rows, ["id"], "document")
    shown = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    want = sorted((i, p, d, shown(x)) for i, v in enumerate(values) for p, _, d, x in plain_leaves(v))
    assert sorted(map(repr, ((x["id"], x["path"], x["depth"], x["value"]) for x in got.collect()))) == sorted(map(repr, want))
    kept = documents.without(got, ("code",)).count()
    assert kept == sum("code" not in names for v in values for _, names, _, _ in plain_leaves(v))
    assert documents.leaves(rows.limit(0), ["id"], "document").count() == 0


@pytest.mark.parametrize("unit", [None, 1, 50])
def test_intervals_of_any_length(spark, unit):
    """One interval holds everything; pairs come once."""
    r = random.Random(6)
    of = lambda n: [(r.choice("kj"), s, s + r.choice([0, 1, 5, 40, 900])) for s in (r.randrange(-5000, 5000) for _ in range(n))]
    left, right = [*of(150), ("k", -(1 << 40), 1 << 40), ("k", 5, 4)], [*of(150), ("j", 0, 1 << 41)]
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i long, k string, a1 long, a2 long")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "j long, k string, b1 long, b2 long")
    got = sorted((x["i"], x["j"]) for x in joins.interval_join(a, b, ["k"], ("a1", "a2"), ("b1", "b2"), unit).collect())
    assert got == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] and x[1] <= x[2])


def test_pieces_are_few_and_disjoint(spark):
    r = random.Random(8)
    spans = [(s, s + n) for s, n in ((r.randrange(-10_000, 10_000), r.randrange(3000)) for _ in range(100))] + [(0, 0), (-1, 0), (-(1 << 45), 1 << 45)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", joins.pieces(F.col("a"), F.col("b")).alias("p")).collect()
    for x in rows:
        runs = sorted((p["at"] << p["level"], (p["at"] + 1) << p["level"]) for p in x["p"])
        assert runs[0][0] == x["a"] and runs[-1][1] == x["b"] + 1 and all(p[1] == q[0] for p, q in zip(runs, runs[1:], strict=False))
        assert len(runs) <= 2 * (x["b"] - x["a"] + 2).bit_length()


@pytest.mark.parametrize("sketch", [8, 4000])
def test_percentiles_when_sketches_miss(spark, monkeypatch, sketch):
    """With a poor sketch values lie outside of their bounds; these groups are done by ranges."""
    monkeypatch.setattr(ordered, "SKETCH", sketch)
    monkeypatch.setattr(ordered, "MARGIN", 0 if sketch == 8 else 2)
    r = random.Random(12)
    groups = {"a": [r.gauss(0, 1) for _ in range(3000)], "b": [5.0] * 400 + [6.0], "c": [1.0], "d": [float(r.randrange(4)) for _ in range(777)], None: [2.0, 1.0]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("e", None), ("a", None)], "g string, v double")
    wanted = {"p95": lambda n: stats.nearest_index(n, 0.95), "p10": lambda n: stats.truncated_index(n, 0.1)}
    got = {x["g"]: x for x in ordered.summaries(rows, ["g"], "v", [F.count("v").alias("n")], wanted, "p50").collect()}
    assert set(got) == {*groups, "e"} and got["e"]["n"] == 0 and got["e"]["p50"] is None
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert (got[g]["n"], got[g]["p95"], got[g]["p10"]) == (n, s[round((n - 1) * 0.95)], s[min(n - 1, int(n * 0.1))])
        assert got[g]["p50"] == pytest.approx((s[(n - 1) // 2] + s[n // 2]) / 2)


def test_a_log_without_a_worker_gives_its_name(spark, tmp_path):
    (tmp_path / "api.log").write_text("about t1 and t2\nWorker w7 took t2\n")
    (tmp_path / "worker_gpu_0.log").write_text("Worker  t9\nWorker w1 took t1\n")
    wanted = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "task_id string")
    found = {(r["task_id"], r["path"].rsplit("/", 1)[1]): r["worker"] for r in files.log_matches(spark, str(tmp_path), wanted).collect()}
    assert found == {("t1", "api.log"): "api", ("t2", "api.log"): "w7", ("t1", "worker_gpu_0.log"): "w1"}
    assert {tuple(r) for r in files.log_search(spark, str(tmp_path), wanted).collect()} == {("t1", "api"), ("t2", "w7")}
