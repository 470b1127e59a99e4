"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the starts of words (inflected languages), kept where labelled examples show that they go with
the label.  Their document frequencies come from all documents.  An example or a query without any of these terms has
one term of its own, so that such texts are neighbours of each other.  The index holds, for each term, its postings
by example number, cut into blocks of examples, and each block's greatest weight.  A query bounds every block by these, reads blocks from the
highest bound down and stops when no bound reaches its k-th best cosine: the neighbours are exactly the k nearest.
Their votes, weighted by distance, are turned into probabilities by an isotonic fit on labelled rows that are not in
the index; the nearest neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import name_of, schema_of

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word starts that are terms of their own.
STARTS = (4, 5, 6)
#: Labelled rows that are read, chosen by the smallest hashes of their ids: of five, four are indexed and the fifth calibrates.
EXAMPLES = 9_000
#: Terms kept at most, and what each needs: examples that hold it, and evidence (likelihood ratio, 16 is about one in 15,000 by chance).
TERMS, TERM_EXAMPLES, TERM_EVIDENCE = 512, 5, 16.0
NEIGHBOURS, EVIDENCE = 16, 3
#: Distance added to each neighbour's, so that one exact copy does not outvote all others.
SOFT = 0.05
BLOCK = 64
_CACHED = 200_000
Vector = tuple[np.ndarray, np.ndarray]


def terms_of(word: str) -> list[str]:
    """The terms a word stands for: itself, and its starts marked with a star."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


class TermCounts:
    """Counts of known terms in whole texts."""

    def __init__(self, terms: list[str]) -> None:
        self.place = {t: i for i, t in enumerate(terms)}
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        """Places of the terms found, ascending, and how often each was found."""
        place, words, found = self.place, self.words, {}
        if len(words) > _CACHED:
            words.clear()
        for word, n in Counter(_WORD.findall(text.lower())).items():
            hits = words.get(word)
            if hits is None:
                hits = words[word] = tuple(place[t] for t in terms_of(word) if t in place)
            for i in hits:
                found[i] = found.get(i, 0) + n
        at = sorted(found)
        return at, [found[i] for i in at]


class BlockMaxIndex:
    """Unit vectors by term, in blocks of example numbers with the greatest weight of each term in each block."""

    def __init__(self, vectors: list[Vector], n_terms: int, block: int = BLOCK) -> None:
        self.n, self.block = len(vectors), block
        n_blocks = -(-self.n // block)
        owner = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors]).astype(np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        order = np.lexsort((owner, term))
        self.owner, self.weight, term = owner[order], weight[order], term[order]
        # where each term's postings of each block begin
        cell = term * n_blocks + self.owner // block if n_blocks else term
        self.begin = np.searchsorted(cell, np.arange(n_terms * n_blocks + 1)).astype(np.int64)
        self.most = np.zeros((n_terms, n_blocks))
        np.maximum.at(self.most.reshape(-1), cell, self.weight)
        self.n_blocks = n_blocks

    def _scores(self, terms: np.ndarray, weights: np.ndarray, block: int) -> np.ndarray:
        """Exact cosines of one block's examples, rounded so that equal ones compare equal."""
        low = block * self.block
        out = np.zeros(min(self.block, self.n - low))
        for t, w in zip((terms * self.n_blocks + block).tolist(), weights.tolist(), strict=True):
            a, b = self.begin[t], self.begin[t + 1]
            if a < b:
                out[self.owner[a:b] - low] += w * self.weight[a:b]
        return np.round(out, 9)

    def search(self, query: Vector, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the ``k`` nearest examples with a positive cosine; ties go to the smaller number."""
        terms, weights = query
        bound = weights @ self.most[terms] + 1e-8
        order = np.lexsort((np.arange(self.n_blocks), -bound))
        at, best = np.zeros(0, np.int64), np.zeros(0)
        for block in order.tolist():
            full = len(best) == k
            if bound[block] <= 1e-8 or (full and bound[block] < best[-1]):
                break
            if full and bound[block] < best[-1] + 2e-8 and block * self.block > at[-1]:
                continue  # could only tie, and loses ties
            scores = self._scores(terms, weights, block)
            near = np.flatnonzero(scores > 0)
            if full:
                near = near[scores[near] >= best[-1]]
            if len(near):
                at, best = np.concatenate((at, near + block * self.block)), np.concatenate((best, scores[near]))
                keep = np.lexsort((at, -best))[:k]
                at, best = at[keep], best[keep]
        return at, best


def vote(cosines: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """Share of label 1 among neighbours, each weighing one over its distance, and ``prior`` as much as if all stood at distance one.

    So neighbours that share little with the text leave the vote near the prior.
    """
    weight = 1 / (np.maximum(0.0, 1 - cosines) + SOFT)
    return float((weight @ labels + NEIGHBOURS * prior) / (weight.sum() + NEIGHBOURS))


def isotonic(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best non-decreasing probability by vote: pooled neighbours that would fall, each with one row's worth of ``prior``."""
    at, which = np.unique(votes, return_inverse=True)
    pools: list[list[float]] = []  # rows, ones, greatest vote
    for n, ones, x in zip(np.bincount(which, minlength=len(at)), np.bincount(which, labels, len(at)), at, strict=True):
        pools.append([float(n), float(ones), float(x)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            n_, ones_, x_ = pools.pop()
            pools[-1] = [pools[-1][0] + n_, pools[-1][1] + ones_, x_]
    edges = np.array([p[2] for p in pools[:-1]])
    value = np.maximum.accumulate([(p[1] + prior) / (p[0] + 1) for p in pools]) if pools else np.zeros(0)
    return edges, np.asarray(value)


@dataclass
class Neighbours:
    """The fitted scorer: bounded by ``EXAMPLES`` rows of at most ``TERMS`` terms, whatever the corpus."""

    index: BlockMaxIndex
    labels: np.ndarray
    ids: list
    idf: np.ndarray
    prior: float
    edges: np.ndarray
    chance: np.ndarray

    def vector(self, terms: list[int], counts: list[int]) -> Vector:
        if not terms:
            return np.array([len(self.idf)]), np.ones(1)
        at = np.array(terms, np.int64)
        weight = (1 + np.log(np.array(counts, float))) * self.idf[at]
        return at, weight / np.sqrt(weight @ weight)

    def raw(self, terms: list[int], counts: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        at, cosines = self.index.search(self.vector(terms, counts), NEIGHBOURS)
        return vote(cosines, self.labels[at], self.prior), at, cosines

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list, list[float]]:
        """Calibrated score, ids and cosines of the evidence.  A thousandth of it is the vote itself, which keeps its order."""
        share, at, cosines = self.raw(terms, counts)
        chance = self.chance[np.searchsorted(self.edges, share)] if len(self.chance) else share
        return 0.999 * float(chance) + 0.001 * share, [self.ids[i] for i in at[:EVIDENCE]], cosines[:EVIDENCE].tolist()


def _counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``docs`` with its ``text`` replaced by ``terms`` and ``counts``; one narrow pass."""
    carry = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TermCounts(terms)
        for batch in batches:
            found = [count(t) for t in batch.column("text").to_pylist()]
            both = [pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *both], [*carry, "terms", "counts"])

    return docs.mapInArrow(run, schema_of(docs, *carry) + ", terms array<int>, counts array<int>")


def _telling_terms(examples: DataFrame) -> list[str]:
    """The terms that go with the label, by likelihood ratio over distinct example texts."""
    distinct = examples.groupBy(F.sha2("text", 256).alias("same")).agg(F.min_by(F.struct("text", "label"), "number").alias("one")).select("one.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                rows[label] += 1
                held[label].update({t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)})
        names = list(held[0].keys() | held[1].keys())
        for a in range(0, len(names), 10_000):
            part = names[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([h[t] for t in part], pa.int64()) for h in held)], ["term", "without", "with"])
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([rows[0]]), pa.array([rows[1]])], ["term", "without", "with"])

    counts = materialize(distinct.mapInArrow(run, "term string, without long, with long").groupBy("term").agg(F.sum("without").alias("without"), F.sum("with").alias("with")))
    total = counts.where("term = ''").first()
    if total is None or not total["with"] or not total["without"]:
        return []
    n0, n1 = total["without"], total["with"]
    own = F.col("with") + F.col("without")

    def part(seen, whole: int, share):  # seen * ln(seen / expected)
        return F.when(seen > 0, seen * F.log(seen / (share * whole / (n0 + n1)))).otherwise(0.0)

    rest = F.lit(n0 + n1) - own
    evidence = 2 * (part(F.col("with"), n1, own) + part(F.col("without"), n0, own) + part(n1 - F.col("with"), n1, rest) + part(n0 - F.col("without"), n0, rest))
    kept = counts.where((F.col("term") != "") & (own >= TERM_EXAMPLES)).select("term", F.round(evidence, 6).alias("evidence")).where(F.col("evidence") >= TERM_EVIDENCE)
    return [r["term"] for r in kept.orderBy(F.desc("evidence"), "term").limit(TERMS).collect()]


def _in_test(name: str, folds: int):
    """Whether an id is held out; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(name_of(name).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> tuple[list[str], list, DataFrame]:
    """Terms, and the example rows, from at most ``EXAMPLES`` labelled ids outside the held-out fold.

    An id with two different labels is left out; of an id's several texts the one with the smallest digest counts.
    """
    label, key = name_of(label_col), name_of(id_col)
    known = labels.where(key.isNotNull() & ~_in_test(id_col, folds)).groupBy(key.alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    known = known.where("label = other AND label IN (0, 1)").select("id", "label", F.xxhash64("id").alias("hash")).orderBy("hash", "id").limit(EXAMPLES)
    chosen = [(i, r["id"], r["label"]) for i, r in enumerate(known.collect())]
    spark, kind = docs.sparkSession, schema_of(labels.select(key.alias("id")), "id")
    numbers = spark.createDataFrame(chosen, f"number int, {kind}, label int")
    texts = docs.select(key.alias("id"), F.coalesce(name_of(text_col), F.lit("")).alias("text")).join(F.broadcast(numbers), "id")
    examples = materialize(texts.groupBy("number", "label", "id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")))
    return _telling_terms(examples.where("number % 5 < 4")), chosen, examples


def neighbours(examples: DataFrame, terms: list[str], idf: np.ndarray) -> Neighbours:
    """The index over four in five examples, calibrated on the others."""
    rows = sorted(_counted(examples.select("number", "id", "label", "text"), terms).collect(), key=lambda r: r["number"])
    held, rest = [r for r in rows if r["number"] % 5 < 4], [r for r in rows if r["number"] % 5 == 4]
    labels = np.array([r["label"] for r in held], float)
    prior = float(labels.mean()) if len(labels) else 0.0
    fitted = Neighbours(BlockMaxIndex([], len(idf) + 1), labels, [r["id"] for r in held], idf, prior, np.zeros(0), np.zeros(0))
    fitted.index = BlockMaxIndex([fitted.vector(r["terms"], r["counts"]) for r in held], len(idf) + 1)
    votes = np.array([fitted.raw(r["terms"], r["counts"])[0] for r in rest])
    fitted.edges, fitted.chance = isotonic(votes, np.array([r["label"] for r in rest], float), prior)
    return fitted


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.5), and the evidence: ids and cosines of the nearest examples.

    One row for each row of ``docs``, from its whole text and nothing else; equal texts have equal scores.  NULL and
    empty texts are texts without a term.  Labels of ids in the held-out fold, NULL or contradicting labels teach
    nothing; without any usable label all scores are 0.  An empty table gives an empty result; other columns are not
    read.  What reaches the driver and every task is bounded by ``EXAMPLES`` and ``TERMS``.
    """
    terms, chosen, examples = fit(docs, labels, id_col, text_col, label_col, folds)
    given = docs.select(name_of(id_col).alias("id"), _in_test(id_col, folds).alias("held_out"), F.coalesce(name_of(text_col), F.lit("")).alias("text"))
    counted = materialize(_counted(given, terms))
    total = counted.count()
    frequency = {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    idf = 1 + np.log((1 + total) / (1 + np.array([frequency.get(i, 0) for i in range(len(terms))], float)))
    fitted = neighbours(examples, terms, idf)
    id_kind = schema_of(examples, "id").split(" ", 1)[1] if chosen else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            out = []
            for found, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                key = (*found, -1, *counts)
                if key not in known:
                    if len(known) > _CACHED:
                        known.clear()
                    known[key] = fitted.score(found, counts)
                out.append(known[key])
            scores, ids, cosines = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([[str(i) for i in x] for x in ids], pa.list_(pa.string())), pa.array(cosines, pa.list_(pa.float64()))],
                ["id", "held_out", "score", "evidence", "cosines"],
            )

    kinds = schema_of(counted, "id") + ", held_out boolean, score double, evidence array<string>, cosines array<double>"
    scored = counted.mapInArrow(run, kinds)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("evidence").cast(f"array<{id_kind}>").alias("evidence"), "cosines",
    )
