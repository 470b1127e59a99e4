"""Periodic runs against all stretches, and on odd rows."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from fedloom.llm.queries import op11
from fedloom.llm.runs import SquareCatcher, periodic_runs, runs_of

SF = "/root/testdata/sf0.001"


def every_run(w, least, exponent):
    found, n = [], len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            smaller = any(all(w[i + k] == w[i + k + q] for k in range(length - q)) for q in range(1, p) if j > i and p % q == 0)
            if j > i and length >= max(least, exponent * p) and not smaller:
                found.append((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(r, most):
    """A few letters with loops, loops in loops, and loops broken off."""
    words, letters = [], r.choice([1, 2, 2, 3, 4])
    while len(words) < most:
        if r.random() < 0.5 and words:
            p = r.randint(1, min(len(words), r.choice([3, 8, 30, 60])))
            words += (words[-p:] * 6)[:r.randint(1, 5 * p)]
        else:
            words += [bytes([97 + r.randrange(letters)]) for _ in range(r.randint(1, 6))]
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (1, 3), (9, 5)])
def test_runs_are_all_runs(least, exponent):
    r = random.Random(least)
    for _ in range(400):
        words = repetitive(r, r.choice([0, 5, 12, 40, 120, 300]))
        assert runs_of(words, least, exponent) == every_run(words, least, exponent)


def test_appending_word_by_word_finds_the_same():
    r = random.Random(4)
    for _ in range(50):
        ids = [w[0] for w in repetitive(r, 90)]
        catcher = SquareCatcher(2, 2)
        for x in ids:
            catcher.extend([x])
        assert catcher.finish() == every_run(ids, 2, 2)


@pytest.mark.parametrize("words", [
    [b"a"] * 200_000, [b"a"] * 60_000 + [b"b"] + [b"a"] * 60_000, [b"a", b"b", b"a"] * 60_000, ([b"a"] * 300 + [b"b"]) * 500, [b"%d" % (i % 977) for i in range(150_000)],
])
def test_long_loops_take_seconds(words):
    start = time.perf_counter()
    runs = runs_of(words)
    assert time.perf_counter() - start < 20
    assert max(length for _, length, _ in runs) >= 60_000


def expected(doc_id, text, seed):
    words = (text or "").encode().split()
    n = len(words)
    if seed is not None and seed % 10 == 0 and n:
        g = seed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words, 6, 4)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    return (
        doc_id, len(runs), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def told(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_the_query_equals_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 6000]
    got = [r for r in op11(spark, SF).collect() if r.doc_id in {d.doc_id for d in docs}]
    assert told(got) == told(expected(d.doc_id, d.text, zlib.crc32(str(d.doc_id).encode())) for d in docs)
    assert sum(r.n_runs > 0 for r in got) > len(docs) // 20


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a " * 9, "x y " * 4, "x y " * 4 + "x", "é é\té\x0bé é é", "u\u00a0u " * 6, "a a a a a", "b b b b b b c c c c c c"]
    rows = [*enumerate(texts), (3, texts[3]), (None, "q q q q q q q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "seed", "n_runs", "start", "length", "period")})
    assert told(periodic_runs(df).collect()) == told(expected(i, t, None) for i, t in rows)
    keyed = periodic_runs(df.withColumnRenamed("text", "Text b").withColumnRenamed("doc_id", "id.x"), id_col="id.x", text_col="Text b")
    assert keyed.columns[0] == "id.x" and told(keyed.collect()) == told(expected(i, t, None) for i, t in rows)
    assert periodic_runs(df.limit(0)).collect() == []
