"""Secret scans: base patterns, and weak candidates linked across the parts of a credential.

A credential has parts: an access identifier, a secret and an endpoint. Each part alone is too weak to
report when it matches no base pattern: a long mixed string, a user or client id, a host or URL. An
interval join within scopes (blocks of text between empty lines) links parts whose intervals lie within
REACH code points of each other; a weak secret is reported only if an identifier or an endpoint co-occurs
with it there, and a weak identifier only if a secret does.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import cut

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS, ACCESS_CHARS = 8, 16
KINDS = ("assign", "access", "hex", "weak_secret", "weak_identifier")

#: Weak parts. A secret mixes cases and digits; an identifier is named as one; an endpoint is a URL or a host with a port.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}")
WEAK_IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|client_?id|account|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"(?:https?|ftp|postgres|mysql|redis|amqp|mongodb)://[^\s\"'<>]+")
PORT = re.compile(r":[0-9]{2,5}\b")
HOST_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
SCOPE = re.compile(r"\n[ \t]*\n")
REACH = 200

PART = "array<struct<kind:string,role:string,scope:long,start:long,end:long>>"
FOUND = f"n_assign long, n_access long, n_hex long, base_sha256 string, base string, parts {PART}"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's rank, end) of the base matches, by start and then kind as listed."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def endpoints(text: str) -> list[tuple[int, int]]:
    """(start, end) of URLs and of hosts with a port, in order. A host is read from its port backwards, so that each character is read once."""
    urls = [m.span() for m in URL.finditer(text)] if "://" in text else []
    starts = [s for s, _ in urls]
    out, at = list(urls), 0
    for m in PORT.finditer(text):
        start = m.start()
        while start > at and text[start - 1] in HOST_SIGNS:
            start -= 1
        host = text[start : m.start()]
        start += host.rfind("..") + 2 if ".." in host else 0
        while start < m.start() and (text[start] == "." or (text[start] != "-") == (start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_"))):
            start += 1  # a host begins at the edge of a word
        host = text[start : m.start()]
        k = bisect_right(starts, start) - 1
        if "." in host and not host.endswith(".") and (k < 0 or urls[k][1] <= start):
            out.append((start, m.end()))
            at = m.end()
    return sorted(out)


class _Spans:
    """Spans merged where they overlap or touch; what a span meets is found by search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end - 1) - 1
        return k >= 0 and self.ends[k] > start

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and end <= self.ends[k]


def parts(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """The credential's parts in text with their scopes, if parts of two roles are there; else none."""
    out = [{"kind": KINDS[k], "role": "identifier" if k == 1 else "secret", "start": s, "end": e} for s, k, e in base]
    ends = endpoints(text) if ":" in text else []
    names = [m.span() for m in WEAK_IDENTIFIER.finditer(text)]
    if not (ends or names or any(x["role"] == "identifier" for x in out)):
        return []
    taken, hosts = _Spans([(s, e) for s, _, e in base]), _Spans(ends)
    out += [{"kind": "endpoint", "role": "endpoint", "start": s, "end": e} for s, e in ends]
    out += [{"kind": "weak_identifier", "role": "identifier", "start": s, "end": e} for s, e in names if not taken.meets(s, e)]
    secrets = [m.span() for m in WEAK_SECRET.finditer(text)]
    out += [{"kind": "weak_secret", "role": "secret", "start": s, "end": e} for s, e in secrets if not taken.meets(s, e) and not hosts.holds(s, e)]
    if len({x["role"] for x in out}) < 2 or not any(x["kind"].startswith("weak_") for x in out):
        return []
    out.sort(key=lambda x: (x["start"], x["end"], x["kind"]))
    cuts = [m.start() for m in SCOPE.finditer(text)]
    scope = 0
    for x in out:
        while scope < len(cuts) and cuts[scope] < x["start"]:
            scope += 1
        x["scope"] = scope
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("role", pa.string()), ("scope", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "parts")}
        for text in batch.column("text"):
            t = text.as_py() or ""
            spans = base_spans(t)
            base = joined(spans)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                rows[name].append(sum(x[1] == k for x in spans))
            rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            rows["base"].append(base)
            rows["parts"].append(parts(t, spans))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), kinds]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)]], names=["doc_id", *rows]
        )


def link(rows: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """The weak rows of (keys, kind, role, start, end) which have a complementary part within reach.

    The interval join is a sweep: within the keys, ordered by start, each row sees the furthest end among
    the parts of each role before it and the nearest start among those after it, so that its work grows
    with the rows and not with their pairs.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def near(role: str) -> Column:
        of = F.col("role") == role
        last = F.max(F.when(of, F.col("end"))).over(before)
        first = F.min(F.when(of, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(first - F.col("end") <= reach, F.lit(False))

    wanted = F.when(F.col("kind") == "weak_secret", near("identifier") | near("endpoint")).when(F.col("kind") == "weak_identifier", near("secret"))
    return rows.withColumn("__linked", wanted).where("__linked").drop("__linked")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Positions are code points, ends exclusive. A null text counts as empty. Texts are scanned whole, in
    Arrow batches; each keeps its own row, repeated and null doc_ids too. No rows give no rows; other
    columns play no part.
    """
    found = cut(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {dict(docs.dtypes)['doc_id']}, {FOUND}").withColumn("__row", F.monotonically_increasing_id()))
    cells = found.where(F.size("parts") > 0).select("__row", F.explode("parts").alias("p")).select("__row", "p.*")
    linked = link(cells, ["__row", "scope"], reach)
    more = linked.groupBy("__row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), F.split(x, ":")[0].alias("kind"), F.split(x, ":")[2].cast("long").alias("end")),
    )
    spans = F.array_sort(F.transform(F.concat(base, F.col("more")), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.join(more, "__row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_linked"),
    )
