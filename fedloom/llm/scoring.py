"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams of every length are mixed; the weights depend on how often the context was
seen and are learned by expectation-maximisation on counts held out from training: one fold of the training documents
is scored with the counts of the others.

Documents are worked on in blocks.  A block sends each of its distinct n-grams once, with its count, to the shard of
the n-gram's hash; shards add up and answer each block with the totals in the order of its n-grams.  So frequent
n-grams cost no more than one entry for each block, and nothing of the model passes through the driver but the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import mixed, name_of, pack, schema_of, shard_edges, steady, text_bytes, unpack, words_of

#: Text of a block, unless one document is longer.
BLOCK_BYTES = 8 << 20
#: Least weight of the uniform estimate, so that no text has probability 0.
FLOOR = 1e-4
ROUNDS = 60
_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)
#: The low bits of a key tell the n-gram's length; 0 marks the contexts before a document's first word.
_TAG = np.uint64(3)
HELD_OUT, TUNING, TRAINING = 0, 1, 2


def _tagged(keys: np.ndarray, tag: int) -> np.ndarray:
    return (keys & ~_TAG) | np.uint64(tag)


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """First token of each document (one more at the end); keys by n-gram length; keys of their contexts from length 2 on."""
    hashes, first = words_of(texts, lower=True)
    n = len(texts)
    begin = first + np.arange(n + 1)
    token = np.full(int(begin[-1]), _END, np.uint64)
    inner = np.ones(len(token), bool)
    inner[begin[1:] - 1] = False
    token[inner] = hashes
    keys, contexts = [_tagged(mixed(token.copy()), 1)], []
    for length in range(2, order + 1):
        context = np.empty_like(token)
        context[1:] = keys[-1][:-1]
        context[begin[:-1]] = starts(order)[length - 2]
        contexts.append(context)
        keys.append(_tagged(mixed(context * np.uint64(0xD1342543DE82EF95) + token), length))
    return begin, keys, contexts


def starts(order: int) -> np.ndarray:
    """Keys of the contexts of a document's first word, by context length."""
    return _tagged(mixed(_START + np.arange(1, order, dtype=np.uint64)), 0)


def _distinct(keys: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the start contexts, and the count of each but those."""
    joined = np.sort(np.concatenate([*keys, starts(order)]))
    head = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1])))
    return joined[head], np.diff(np.concatenate((head, [len(joined)])))


def _placed(keys: list[np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, with the start contexts, and the place among them of each key and, last, of the start contexts.

    The order of the one sort also tells the places: looking each n-gram up again would take four times as long.
    """
    parts = [*keys, starts(order)]
    joined = np.concatenate(parts)
    by = np.argsort(joined)
    joined = joined[by]
    head = np.concatenate(([True], joined[1:] != joined[:-1]))
    place = np.empty(len(joined), np.int32)
    place[by] = np.cumsum(head, dtype=np.int32) - np.int32(1)
    return joined[head], np.split(place, np.cumsum([len(p) for p in parts])[:-1])


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Block number and rows.  Rows of a kind fill one block after the other, in the order in which they are read."""
    held: dict[int, list] = {}
    for batch in batches:
        part, kind, text = (batch.column(c).to_pylist() for c in ("__part", "__kind", "__text"))
        begun: dict[int, int] = {}  # where the run of rows of one kind and block began that may still grow
        for i, (p, k, t) in enumerate(zip(part, kind, text, strict=True)):
            own = held.setdefault(k, [0, 0, [], p])
            if own[1] and own[1] + len(t) > limit:
                yield (own[3] * 3 + k << 20) + own[0], own[2]
                own[0], own[1], own[2] = own[0] + 1, 0, []
                begun.pop(k, None)
            own[1] += len(t)
            if begun.get(k, -1) >= 0 and kind[i - 1] == k:
                own[2][-1] = batch.slice(begun[k], i + 1 - begun[k])
            else:
                begun[k] = i
                own[2].append(batch.slice(i, 1))
    for k, own in held.items():
        if own[2]:
            yield (own[3] * 3 + k << 20) + own[0], own[2]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    left = F.crc32(F.coalesce(name_of(id_col).cast("string"), F.lit("")).cast("binary")) % 10
    return steady(docs).select(
        name_of(id_col).alias(id_col), text_bytes(text_col).alias("__text"), F.spark_partition_id().alias("__part"),
        F.when(left == 0, HELD_OUT).when(left == 1, TUNING).otherwise(TRAINING).alias("__kind"),
    )


def _totals(rows: DataFrame, order: int, shards: int, limit: int) -> DataFrame:
    """Answers of the shards: (block, shard, all, tuning, vocabulary, tokens); block -1 has the last two, the others the first.

    ``all`` and ``tuning`` are the counts, in all training documents and in the tuning fold, of the block's distinct
    keys in the shard, in order; ``tuning`` is told to blocks of that fold only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _blocks(batches, limit):
            texts = [t for p in parts for t in p.column("__text").to_pylist()]
            kind = block >> 20
            keys, counts = _distinct(ngrams(texts, order)[1], order)
            start = np.isin(keys, starts(order))
            counts = np.where(start, len(texts), counts).astype(np.uint64) * np.uint64(kind % 3 != HELD_OUT)
            edge = shard_edges(keys, shards)
            out = []
            for s in range(shards):
                own = slice(edge[s], edge[s + 1])
                if edge[s] < edge[s + 1]:
                    out.append((s, block, pack(np.diff(keys[own], prepend=np.uint64(0))), pack(counts[own])))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "block", "keys", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for batch in batches:
            for shard, block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "keys", "counts")), strict=True):
                asked.setdefault(shard, []).append((block, np.cumsum(unpack(keys), dtype=np.uint64), unpack(counts)))
        for shard, blobs in asked.items():
            joined = np.concatenate([k for _, k, _ in blobs])
            known = np.unique(joined)
            total, tuning = np.zeros(len(known), np.uint64), np.zeros(len(known), np.uint64)
            del joined
            for i, (block, keys, counts) in enumerate(blobs):
                at = np.searchsorted(known, keys)
                total[at] += counts
                if (block >> 20) % 3 == TUNING:
                    tuning[at] += counts
                blobs[i] = (block, at.astype(np.int32 if len(known) < 1 << 31 else np.int64))
            for block, at in blobs:  # only the tuning fold is ever scored without its own counts
                yield _answer(block, shard, pack(total[at]), pack(tuning[at]) if (block >> 20) % 3 == TUNING else b"", 0, 0, 0)
            words = total[(known & _TAG) == 1]
            yield _answer(-1, shard, b"", b"", int(np.count_nonzero(words)), int(words.sum()), int(tuning[(known & _TAG) == 1].sum()))

    sent = rows.mapInArrow(count, "shard int, block long, keys binary, counts binary")
    return sent.repartitionById(shards, F.col("shard")).mapInArrow(add, "block long, shard int, all binary, tuning binary, vocabulary long, tokens long, tuning_tokens long")


def _answer(*values) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["block", "shard", "all", "tuning", "vocabulary", "tokens", "tuning_tokens"])


def _counts(texts: list[bytes], answers: pa.Table, order: int, shards: int, without_tuning: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """First tokens; the counts of each token's n-grams by length and then of their contexts."""
    begin, keys, _ = ngrams(texts, order)
    distinct, places = _placed(keys, order)
    edge = shard_edges(distinct, shards)
    by_shard = {s: (a, t) for s, a, t in zip(*(answers.column(c).to_pylist() for c in ("shard", "all", "tuning")), strict=True)}
    values = np.empty(len(distinct), np.uint64)
    for s in range(shards):
        if edge[s] < edge[s + 1]:
            found = unpack(by_shard[s][0]) if s in by_shard else ()
            if len(found) != edge[s + 1] - edge[s]:
                raise ValueError("the documents were not the same when they were read again")
            values[edge[s]:edge[s + 1]] = found - unpack(by_shard[s][1]) if without_tuning else found
    values = values.astype(np.float64)
    grams = [values[p] for p in places[:-1]]
    contexts = []
    for gram, start in zip(grams[:-1], values[places[-1]], strict=True):
        context = np.empty(len(gram))  # of a token: what its left neighbour's n-gram one shorter counts
        context[1:] = gram[:-1]
        context[begin[:-1]] = start
        contexts.append(context)
    return begin, [*grams, *contexts]


def estimates(counts: list[np.ndarray], order: int, tokens: float, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates by length, the uniform one first, for each token; and each token's bucket.

    A bucket is the longest context seen in training and the power of two below its count.  Unseen contexts estimate 0.
    """
    grams, contexts = counts[:order], counts[order:]
    n = len(grams[0])
    by = [np.full(n, 1 / (vocabulary + 1)), grams[0] / max(tokens, 1)]
    bucket = np.zeros(n, np.int64)
    for length, (gram, context) in enumerate(zip(grams[1:], contexts, strict=True), 2):
        seen = context > 0
        by.append(np.divide(gram, context, out=np.zeros(n), where=seen))
        bucket[seen] = 64 * (length - 1) + np.log2(context[seen]).astype(np.int64)
    return np.stack(by), bucket


def learn_weights(cells: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights that maximise the held-out likelihood; ``cells``: a count and the estimates in each row."""
    n, p = cells[:, 0], cells[:, 1:]
    weights = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = p * weights
        mass = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0)
        weights = mass / mass.sum()
    weights = np.where(np.arange(len(weights)) == 0, np.maximum(weights, FLOOR), weights)
    return weights / weights.sum()


def _tuned(rows: DataFrame, answers: DataFrame, order: int, shards: int, tokens: int, vocabulary: int) -> dict[int, np.ndarray]:
    """Weights by bucket from the tuning fold, whose own counts are taken out of the model's.

    Tokens are added up in cells of nearly equal estimates (an eighth of a power of two), whose number does not depend
    on the size of the corpus; every token of the fold takes part.  The cells of a bucket meet in one task, which learns
    its weights; the driver gets these alone.
    """

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("__text").to_pylist()
        p, bucket = estimates(_counts(texts, right, order, shards, True)[1], order, tokens, vocabulary)
        logs = np.log2(p, out=np.full(p.shape, -np.inf), where=p > 0)
        level = np.where(p > 0, np.round(8 * np.maximum(logs, -100)), 1).astype(np.int64) + 900
        code = bucket
        for one in level[1:]:
            code = code * 1024 + one
        cell, at = np.unique(code, return_inverse=True)
        sums = [np.bincount(at, minlength=len(cell)), *(np.bincount(at, np.where(x > 0, x, 0), len(cell)) for x in p)]
        return pa.table([pa.array(cell // 1024 ** order), pa.array(cell), *(pa.array(s.astype(np.float64)) for s in sums)], ["bucket", "cell", "n", *(f"p{i}" for i in range(order + 1))])

    columns = ["n", *(f"p{i}" for i in range(order + 1))]
    pairs = rows.groupBy("block").cogroup(answers.groupBy("block"))
    cells = pairs.applyInArrow(add, "bucket long, cell long, " + ", ".join(f"{c} double" for c in columns))
    summed = cells.groupBy("bucket", "cell").agg(*(F.sum(c).alias(c) for c in columns))

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        n, *sums = (table.column(c).to_numpy() for c in columns)
        weight = learn_weights(np.stack([n, *(x / n for x in sums)], axis=1))
        return pa.table([table.column("bucket").slice(0, 1), pa.array([weight.tolist()], pa.list_(pa.float64()))], ["bucket", "weights"])

    return {b: np.array(w) for b, w in summed.groupBy("bucket").applyInArrow(learn, "bucket long, weights array<double>").collect()}


def score(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    Rows whose id has a CRC-32 divisible by 10 are held out, a NULL id counting as an empty one; the model learns from
    all others.  ``docs`` has to give the same partitions each time it
    is read, as a stored table does.  A NULL or empty text is its end token alone.  Repeated rows count as often as
    they come.  No rows give none.
    """
    if not 2 <= order <= 3:
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(docs, id_col, text_col)
    answers = materialize(_totals(rows, order, shards, block_bytes))
    vocabulary, tokens, tuning = (x or 0 for x in answers.agg(F.sum("vocabulary"), F.sum("tokens"), F.sum("tuning_tokens")).first())
    answers = answers.where("block >= 0").select("block", "shard", "all", "tuning")

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _blocks(batches, block_bytes):
            for part in pa.Table.from_batches(parts).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), *(part.column(c) for c in (id_col, "__text", "__kind"))], ["block", id_col, "__text", "__kind"])

    tagged = rows.mapInArrow(tag, f"block long, {schema_of(rows, id_col)}, __text binary, __kind int")
    tuning_only = answers.where(F.shiftright("block", 20) % 3 == TUNING)
    only = rows.where(F.col("__kind") == TUNING).mapInArrow(tag, f"block long, {schema_of(rows, id_col)}, __text binary, __kind int")
    weights = _tuned(only, tuning_only, order, shards, tokens - tuning, vocabulary)
    buckets = np.array(sorted(weights), np.int64)
    table = np.array([weights[b] for b in buckets.tolist()]).reshape(-1, order + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        begin, total = _counts(left.column("__text").to_pylist(), right, order, shards, False)
        p, bucket = estimates(total, order, tokens, vocabulary)
        if len(buckets):  # a bucket without held-out tokens has the weights of the nearest below it
            mix = table[np.maximum(np.searchsorted(buckets, bucket, "right") - 1, 0)].T
        else:
            mix = np.full((order + 1, 1), 1 / (order + 1))
        # an unseen context estimates nothing, so its weight goes to the others
        seen = np.stack([np.ones(len(bucket), bool), np.full(len(bucket), tokens > 0), *(c > 0 for c in total[order:])])
        mass = (p * mix).sum(axis=0) / (mix * seen).sum(axis=0)
        c = total[0]
        base = np.log10((c + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        doc = np.repeat(np.arange(len(left)), np.diff(begin))
        sums = [np.bincount(doc, x, len(left)) for x in (c > 0, base, np.log10(mass))]
        return pa.table(
            [left.column(id_col), pa.array(left.column("__kind").to_numpy() == HELD_OUT), pa.array(np.diff(begin)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(left), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])],
            [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    pairs = tagged.groupBy("block").cogroup(answers.groupBy("block"))
    return pairs.applyInArrow(run, f"{schema_of(rows, id_col)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
