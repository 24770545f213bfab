"""The pipeline's stages in order, against the operators' brute-force tests and each other."""

from __future__ import annotations

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import __spark_entry__  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_operators import bag, docs_of, grams, line_classes_by_force, plain_score, prob_jaccard, public_tokenizers, toxicity, words  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_lose_only_what_they_should(spark, tmp_path):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[4] <= sizes[3] and sizes[5] == sizes[4] > 0
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert whole == sorted(tuple(r) for r in docs.collect())


def pipeline_by_force(docs, lexicon, items, lines_of):
    """(doc_id, n_tokens, ids' digest, decoded digest) of what the five stages leave of (doc_id, text) rows, each stage in plain Python."""
    import tiktoken
    from array import array

    docs = [(i, t) for i, t in docs if plain_score(lexicon, t) < 0.3]
    gone = {(w[0], w[1]) for w in lines_of(docs)[0] if not w[4]}
    docs = [(i, t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in docs]
    known = [(i, t) for i, t in docs if i is not None and t is not None]
    root, bags = {i: i for i, _ in known}, [bag(t) for _, t in known]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in range(a + 1, len(known)):
            if known[a][1] == known[b][1] or bags[a].keys() & bags[b].keys() and prob_jaccard(bags[a], bags[b]) >= 0.8 - 1e-9:
                x, y = find(known[a][0]), find(known[b][0])
                root[max(x, y)] = min(x, y)
    docs = [(i, t) for i, t in docs if i is None or t is None or find(i) == i]
    docs = [(i, t) for i, t in docs if not any(len(grams(t) & grams(x)) >= 0.8 * len(grams(x)) - 1e-9 for x in items)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = ranks_of(path)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids, raw = ref.encode_ordinary(t or ""), (t or "").encode()
        out.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()))
    return sorted(out, key=str)


def ranks_of(path):
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in (x.split() for x in f if x.strip())}


def test_pipeline_against_brute_force(spark, tmp_path):
    """Odd rows, copies, near copies, repeated and near lines, benchmark passages and insults: run() gives what plain Python leaves."""
    r = random.Random(18)
    lines_ = ["this is a line that many documents share", "this is a line that many documents shere", "short"]
    base = [words(r, r.randint(20, 90), 3000) for _ in range(25)]
    items = [words(r, r.randint(6, 20), 3000) for _ in range(5)]
    texts = [None, "", " \n", *base]
    for k in range(45):
        w = base[k % 12].split()
        w[r.randrange(len(w))] = f"v{k}" if k % 3 else w[0]
        t = " ".join(w)
        t = f"{t}\n{r.choice(lines_)}" if k % 2 else t
        t = f"{t} {items[k % 5]}" if k % 9 == 0 else t
        texts.append(f"{t}\nyou stupid idiot, you moron" if k % 10 == 3 else t)
    docs = docs_of(spark, texts, [*range(1, len(texts)), None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    lines_of = lambda rows: line_classes_by_force(docs_of(spark, [t for _, t in rows], [i for i, _ in rows]))
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    want = pipeline_by_force(rows, lexicon, items, lines_of)
    out = sorted((tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert out == want and 10 < len(want) < len(rows) - 20
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs.where(F.col("doc_id") < 3), str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
