"""Nearest labelled examples: the index against all cosines, held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedloom.llm import toxicity as tox
from fedloom.llm.queries import op12

SF = "/root/testdata/sf0.01"


def vectors(r, n, terms, values):
    """Unit vectors that share few weights, so that many cosines are equal."""
    out = []
    for _ in range(n):
        at = np.array(sorted(r.sample(range(terms), r.randint(1, min(4, terms)))))
        weight = np.array([r.choice(values) for _ in at], float)
        out.append((at, weight / np.sqrt(weight @ weight)))
    return out


@pytest.mark.parametrize("n, terms, block, k", [(300, 12, 16, 16), (300, 5, 64, 7), (90, 40, 1, 3), (10, 6, 64, 16), (0, 3, 8, 4)])
def test_index_gives_the_nearest_of_all(n, terms, block, k):
    r = random.Random(n + terms)
    held = vectors(r, n, terms, (1, 1, 2, 3.5))
    index = tox.BlockMaxIndex(held, terms, block)
    dense = np.zeros((n, terms))
    for row, (at, weight) in zip(dense, held, strict=True):
        row[at] = weight
    for at, weight in vectors(r, 200, terms, (1, 1, 2, 3.5)):
        cosines = np.round(dense[:, at] @ weight, 9)
        expected = [i for i in sorted(range(n), key=lambda i: (-cosines[i], i)) if cosines[i] > 0][:k]
        found, values = index.search((at, weight), k)
        assert found.tolist() == expected
        assert np.allclose(values, cosines[expected])


def test_most_blocks_are_skipped(monkeypatch):
    r = random.Random(1)
    index = tox.BlockMaxIndex(sorted(vectors(r, 4000, 60, (1, 2, 5)), key=lambda v: v[0].tolist()), 60)
    read = []
    scores = index._scores
    monkeypatch.setattr(index, "_scores", lambda *a: read.append(a[-1]) or scores(*a))
    for query in vectors(r, 50, 60, (1, 2, 5)):
        index.search(query, 16)
    assert len(read) < 50 * index.n_blocks / 2


def test_calibration_never_falls_and_keeps_counts():
    r = np.random.default_rng(2)
    votes = np.round(r.random(500), 2)
    labels = (r.random(500) < votes ** 2).astype(float)
    edges, value = tox.isotonic(votes, labels, 0.1)
    assert (np.diff(value) >= 0).all() and (0 <= value).all() and (value <= 1).all() and len(edges) == len(value) - 1
    fitted = value[np.searchsorted(edges, votes)]
    assert abs(fitted.sum() - labels.sum()) < len(value)
    best = min(((x >= 0.5) != labels).mean() for x in (votes, votes ** 2))
    assert ((fitted >= 0.5) != labels).mean() <= best + 0.02


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op12(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if i in got and got[i].held_out]
    clean = [s for s, y in held if not y]
    assert sum(s < 0.5 for s in clean) >= 0.98 * len(clean)
    assert sum((s >= 0.5) == y for s, y in held) >= 0.95 * len(held)


@pytest.fixture
def taught(spark):
    """A foul word in 40 of 200 texts; ids 900 on are queries without a label."""
    r = random.Random(5)
    bag = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(bag) for _ in range(40)) + (" Grobian! grobiane" if i % 5 == 0 else "")) for i in range(200)]
    labels = [(i, int(i % 5 == 0)) for i in range(200)]
    rows += [(900, "GROBIANES " + rows[1][1]), (901, rows[2][1]), (902, None), (903, ""), (904, "\n 12 !"), (905, "grobian " * 50_000), (905, "grobian"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "held_out", "score", "terms", "counts", "label", "number")})
    return docs, spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, toxic int, text string"), rows


def test_odd_rows(spark, taught):
    docs, labels, rows = taught
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1
    score = {r.doc_id: r.score for r in got}
    assert score[900] > 0.5 and score[905] > 0.5 and score[None] > 0.5 and max(score[i] for i in (901, 902, 903, 904)) < 0.5
    assert score[902] == score[903] == score[904] == score[901]
    indexed = {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    for r in got:
        assert set(r.evidence) <= indexed and len(r.evidence) == len(r.cosines) and list(r.cosines) == sorted(r.cosines, reverse=True)
    # labels that contradict each other, are NULL, or belong to NULL or held-out ids teach nothing
    odd = labels.union(spark.createDataFrame([(None, 1, ""), (901, None, ""), (902, 1, ""), (902, 0, ""), (5000, 1, "")], "doc_id long, toxic int, text string"))
    assert {r.doc_id: r.score for r in tox.toxicity(docs, odd).collect()} == score
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in tox.toxicity(docs, flipped).collect()} == score


def test_empty_tables(taught):
    docs, labels, rows = taught
    assert tox.toxicity(docs.limit(0), labels).collect() == []
    got = tox.toxicity(docs, labels.limit(0)).collect()
    assert len(got) == len(rows) and all(r.score == 0 and r.predicted == 0 and r.evidence == [] for r in got)
    other = tox.toxicity(docs.withColumnRenamed("doc_id", "key x").withColumnRenamed("text", "t.t"), labels.withColumnRenamed("doc_id", "key x"), id_col="key x", text_col="t.t")
    assert other.columns[0] == "key x" and other.count() == len(rows)
