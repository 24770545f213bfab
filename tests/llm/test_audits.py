"""The quality classifier and the two audits against plain versions: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("scoreloom.llm")

from scoreloom.llm import divergence, interactions, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, part string, same long, words string, failed int, n long, docs long, term string, shard int, x double, quality string, toxic string, score string"
LABEL = "doc_id long, quality int, toxic int, text string, x double"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names clash with what the operators use inside."""
    return spark.createDataFrame([(*r, "p", 1, "w", 2, 3, 4, "t", 5, 0.5, "q", "t", "s") for r in rows], DOC)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "text", 0.5) for r in rows], LABEL)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    some = lambda n, k=60: " ".join(f"{r.choice('abcdefgXYZ')}{'é' * r.randrange(2)}{'o' * r.randrange(k // 20)}{r.choice(['', '.', '#', '1'])}" for _ in range(n))
    rows = [(i, some(r.choice([3, 50, 99, 100, 101, 200])), r.choice(["en", "de", None, ""]), r.choice(["a", "b", None, "c"])) for i in range(120)]
    same = rows[7][1]
    rows += [(200, None, "en", "a"), (201, "", "en", "b"), (202, "  \n\t ", None, None), (None, same, "en", "a"), (203, same, "en", "a"), (203, same, "de", "b"), (5, same, "fr", "only"), (204, "HELLO WORLD", "xx", "y"), (205, "x\x00y\x1f\x7fz İ K ÀÉ", "en", "c")]
    rows += [(300 + i, "the same words again " * 40, "en", "hot") for i in range(60)]
    rows += [(400, some(60_000), "en", "long")]
    return rows


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 100, 3)] + [(3, 1, 1), (3, 0, 0), (203, 1, None), (None, 1, 1), (9999, 1, 1), (300, None, 1), (301, 1, 0)]


# filter interactions


def plain_interactions(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    parts = defaultdict(list)
    for d, text, lang, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first.get(t, d)}
        parts[lang or ""].append(({k for k, v in failed.items() if v}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [(g, x) for s, g, x in rows if f in s and not s & before]
                out[part, "".join(order), k + 1] = [
                    sum(not s & (before | {f}) for s, _, _ in rows), len(gone), sum(f in s and bool(s & before) for s, _, _ in rows), sum(s == {f} for s, _, _ in rows),
                    sum(g for g, _ in gone), sum(x for _, x in gone),
                ]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_interactions_equal_a_plain_version(spark, odd):
    got = interactions.audit(docs_of(spark, odd), labels_of(spark, LABELS))
    assert got.columns == ["part", "filter_order", "step", *interactions.COUNTS, "shapley"]
    rows = got.collect()
    found = {tuple(r[:3]): tuple(r[3:]) for r in rows}
    assert len(rows) == len(found) == 600 * 5
    assert found == plain_interactions(odd, LABELS)


def test_interactions_without_rows(spark, odd):
    assert interactions.audit(docs_of(spark, []), labels_of(spark, LABELS)).count() == 0
    rows = interactions.audit(docs_of(spark, odd[:1]), labels_of(spark, [])).collect()
    assert len(rows) == 600 and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_a_lattice_has_eighty_edges_and_six_hundred_steps():
    steps = interactions.steps()
    assert len(steps) == 600 and len({s[2:] for s in steps}) == 80


# source divergence


def plain_divergence(docs):
    term = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        found = term.findall((text or "").encode().lower())
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    kept = {lang: sorted(t for t, n in c.items() if n >= 3) for lang, c in seen.items()}
    share = lambda c, v, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in v) + len(v))
    part = lambda p, q: (p - q) * (p - q) // q
    shares = {g: {t: share(c, kept[g[0]], t) for t in kept[g[0]]} for g, c in counts.items()}
    whole = {lang: sum((c for g, c in counts.items() if g[0] == lang), Counter()) for lang in seen}
    base = {lang: {t: share(whole[lang], kept[lang], t) for t in kept[lang]} for lang in seen}
    out = set()
    for (lang, source), mine in shares.items():
        pairs = [(-sum(part(p, shares[h][t]) for t, p in mine.items()), h[1].encode()) for h in shares if h[0] == lang and h[1] != source]
        terms = [(-part(p, base[lang][t]), t) for t, p in mine.items() if counts[lang, source][t] and p > base[lang][t]]
        for name, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
            out |= {(lang, source, name, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)}
    return out


@pytest.mark.parametrize("shard_rows", [250_000, 7])
def test_divergence_equals_a_plain_version(spark, odd, shard_rows, monkeypatch):
    monkeypatch.setattr(divergence, "MIN_SHARDS", 4)
    got = divergence.audit(docs_of(spark, odd), shard_rows, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    want = plain_divergence(odd)
    assert len(rows) == len(want) and set(rows) == want
    assert {r[2] for r in rows} == {"pair", "term"}


def test_a_long_text_is_one_document_in_pieces():
    import pyarrow as pa

    text = "Alpha BETA ünï\n" * 700_000 + "z" * 5_000_000
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "source": ["s"], "text": [text]})
    assert len(divergence._pieces(batch)) == 3
    rows = [r for b in divergence._count(iter([batch])) for r in b.to_pylist()]
    assert {(r["term"], r["n"], r["docs"]) for r in rows} == {("alpha", 700_000, 1), ("beta", 700_000, 1), ("ünï", 700_000, 1), ("z" * 5_000_000, 1, 1)}


def test_divergence_of_few_rows(spark):
    assert divergence.audit(docs_of(spark, [])).count() == 0
    assert {tuple(r) for r in divergence.audit(docs_of(spark, [(1, "a b", "en", "x"), (2, None, "en", None)])).collect()} == {("en", "x", "pair", "", 0, 1), ("en", "", "pair", "x", 0, 1)}


# quality


def test_statistics_tell_junk_apart_and_take_odd_texts():
    size = len(quality.NAMES)
    for text in (None, "", " \n ", "a", "x" * 700_000, "word " * 300_000, "\x00퟿"):
        x = quality.statistics(text)
        assert len(x) == size and all(map(math.isfinite, x))
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n ")
    at = quality.NAMES.index
    junk, plain = quality.statistics("THE!! SAME!! WORDS!! ### " * 50), quality.statistics("the quick brown fox jumps over a lazy dog, and sleeps. " * 50)
    assert all(junk[at(c)] > plain[at(c)] for c in ("capitals", "signs", "exclamations", "wordless"))


def test_pieces_are_the_text():
    r = random.Random(3)
    for text in ("", "ab " * 200_000, "x" * 1_200_000, "".join(r.choice("ab \n") for _ in range(600_000)), "a" * 262_144 + " b"):
        parts = list(quality.pieces(text))
        assert "".join(parts) == text and all(parts)
        if "x" not in text:
            assert sum(len(p.split()) for p in parts) == len(text.split())


def test_discriminant_is_the_difference_of_log_densities():
    r = np.random.default_rng(1)
    size = len(quality.NAMES)
    x = {0: r.normal(0, 2, (300, size)), 1: r.normal(1, 0.5, (700, size))}
    model = quality.discriminant({c: len(v) for c, v in x.items()}, {c: v.sum(0) for c, v in x.items()}, {c: v.T @ v for c, v in x.items()})
    both = np.concatenate([x[0], x[1]])
    z = {c: (v - both.mean(0)) / (both.std(0) + 1e-3) for c, v in x.items()}
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in z.values()) / len(both)
    probe = r.normal(0.5, 1, (50, size))
    logs = {}
    for c, v in z.items():
        k = quality.POOLED * size
        own = (len(v) * np.cov(v.T, bias=True) + k * pooled) / (len(v) + k)
        own = (1 - quality.SPHERE) * own + quality.SPHERE * (np.trace(own) / size + 1e-6) * np.eye(size)
        d = (probe - both.mean(0)) / (both.std(0) + 1e-3) - v.mean(0)
        logs[c] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d) - 0.5 * np.linalg.slogdet(own)[1] + math.log(len(v) / len(both))
    assert np.allclose(quality.density_difference(model, probe), np.clip(logs[1] - logs[0], -quality.LIMIT, quality.LIMIT))


def test_quality_of_held_out_documents(spark):
    out = {r["doc_id"]: r for r in queries.op11_quality(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out.values())
    told = [(labels[d], r["predicted"]) for d, r in out.items() if r["held_out"] and d in labels]
    assert len(told) > 50 and sum(a == b for a, b in told) >= 0.97 * len(told)


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    rows = [(i, ("a plain sentence of words, again. " if i % 3 else "### $$$ !!! ") * (5 + i % 7), "en", "s") for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    one, two = ({r["doc_id"]: r["score"] for r in quality.classify(docs_of(spark, rows), labels_of(spark, x)).collect()} for x in (labels, turned))
    assert one == pytest.approx(two, abs=1e-9)
    assert all((one[i] >= 0.3) == (i % 3 > 0) for i in one)


def test_quality_of_odd_rows(spark, odd):
    docs = docs_of(spark, odd)
    rows = quality.classify(docs, labels_of(spark, LABELS)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, *_ in odd)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (200, 201, 202)}) == 1
    for labels in ([], [(1, 1, 0), (2, 1, 0), (4, 1, 0)]):
        assert len({r["score"] for r in quality.classify(docs, labels_of(spark, labels)).collect()}) == 1
    assert quality.classify(docs_of(spark, []), labels_of(spark, LABELS)).count() == 0
    null = [r for r in rows if r["doc_id"] is None]
    assert len(null) == 1 and null[0]["held_out"] is False
