"""Best-fit packing with certified bounds.

Documents are tokenized and cut into pieces; every partition packs its pieces by best-fit decreasing, and dual
feasible functions give a lower bound on the bins any packing of that partition needs.  A partition that meets its
bound is certified and closed.  The others give up their bins that have gaps; those pieces are dealt out anew among
fewer partitions, which run best-fit decreasing again, as long as that saves bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .common import beside, name_of, schema_of

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces packed together; one task holds so many lengths.
PART = 50_000
#: Longer texts go to the other implementation of the same merges, whose time and stack stay bounded on any input.
LONG_TEXT = 1 << 18


def _byte_of() -> dict[str, int]:
    """Byte of each printable stand-in of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoders(vocabulary: str) -> tuple[tiktoken.Encoding, Tokenizer, frozenset[str]]:
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
    stand = _byte_of()
    ranks = {bytes(stand[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return fast, Tokenizer.from_file(path), frozenset(special)


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids as ``Tokenizer.from_file(...).encode(text, add_special_tokens=False)`` gives them, little-endian unsigned 32 bit.

    The merges are applied by a faster implementation of the same vocabulary; tests hold the two against each other.
    """
    fast, exact, special = _encoders(vocabulary)
    if len(text) > LONG_TEXT:
        return np.array(exact.encode(text, add_special_tokens=False).ids, "<u4")
    ids = fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)
    return np.array(ids, "<u4")


def cut(ids: np.ndarray, capacity: int = CAPACITY, end: int = END) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of each piece of a document: whole if it fits, else full pieces after a first one that may be shorter."""
    ids = np.append(ids, np.array([end], "<u4")).astype("<u4")
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row of ``docs``; NULL and empty texts have one piece, the end id."""
    given = docs.select(name_of(id_col).alias(id_col), F.coalesce(name_of(text_col).cast("string"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, found = [], [], []
            for r, text in enumerate(batch.column("__text").to_pylist()):
                own = cut(token_ids(text, vocabulary), capacity, end)
                rows += [r] * len(own)
                numbers += range(len(own))
                found += own
            start, length, crc = (pa.array([f[i] for f in found], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), start, length, crc], [id_col, "piece", "start", "length", "ids_crc32"])

    return given.mapInArrow(run, schema_of(given, id_col) + ", piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    having, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = having >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                having &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if room > size:
            rooms[room - size].append(b)
            having |= 1 << room - size
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, most: int = 20) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions.

    One counts items above ``capacity - t`` as whole bins and ignores those below ``t``, for every ``t``; the other
    rounds ``(k + 1) * length / capacity`` down, for ``k`` up to ``most``.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    below, mass = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * size)))
    t = np.arange(capacity // 2 + 1)
    whole = below[-1] - below[capacity - t + 1]
    middle = mass[capacity - t + 1] - mass[t]
    best = int((whole - (-middle // capacity)).max())
    for k in range(1, most + 1):
        share = (k + 1) * size
        value = np.where(share % capacity == 0, size * k, share // capacity * capacity)
        best = max(best, -int(-(count * value).sum() // (capacity * k)))
    return best


def _pack(pool: DataFrame, capacity: int, parts: int, turn: int) -> DataFrame:
    """``pool`` (key, length, ...) packed in ``parts`` partitions: bin, offset, fill, and the partition's bins and bound."""
    dealt = pool.select("key", "length").withColumn("part", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy() for c in ("key", "length", "part")) for b in batches]
        if not held:
            return
        keys, lengths, part = (np.concatenate(x) for x in zip(*held, strict=True))
        for p in np.unique(part):
            own = part == p
            bins, offsets, fill = best_fit(lengths[own], capacity)
            n = len(bins)
            bound = lower_bound(lengths[own], capacity)
            columns = [keys[own], lengths[own], (turn << 55) + (int(p) << 31) + bins, offsets, fill[bins], np.full(n, len(fill)), np.full(n, bound)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "length", "sequence_id", "offset", "fill", "bins", "bound"])

    return dealt.mapInArrow(run, "key long, length long, sequence_id long, offset long, fill long, bins long, bound long")


def _bins(packed: DataFrame) -> int:
    return packed.agg(F.count_distinct("sequence_id")).first()[0]


def pack(items: DataFrame, capacity: int = CAPACITY, part: int = PART, turns: int = 8) -> DataFrame:
    """(key, sequence_id, offset) for items (key long, unique; length long, 1 to capacity).

    Full items are sequences of their own, under negative numbers.  Bins without a gap and bins of certified
    partitions are closed; the rest is dealt out anew while that saves bins, ``turns`` times at most - each turn only
    betters a packing that is whole already.
    """
    full = items.where(F.col("length") == capacity).select("key", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = items.where(F.col("length") < capacity)
    left = pool.count()
    if not left:
        return full
    done, turn = [full], 1
    packed = materialize(_pack(pool, capacity, -(-left // part), turn))
    while True:
        open_ = (F.col("bins") > F.col("bound")) & (F.col("fill") < capacity)
        done.append(packed.where(~open_).select("key", "sequence_id", "offset"))
        rest = packed.where(open_)
        left, before = rest.count(), _bins(rest)
        if not left:
            break
        turn += 1
        again = materialize(_pack(rest, capacity, -(-left // part), turn))
        if turn > turns or _bins(again) >= before:
            done.append(rest.select("key", "sequence_id", "offset"))
            break
        packed = again
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    An id named like a result gets ``_`` behind its name.  Repeated rows are packed each for itself; NULL ids are kept; an empty table gives no pieces.
    """
    given = docs.select(name_of(id_col).alias("__id"), name_of(text_col).alias("__text"))
    found = materialize(pieces(given, capacity, end, vocabulary, "__id", "__text").withColumn("key", F.monotonically_increasing_id()))
    packed = found.join(pack(found.select("key", "length"), capacity, part), "key").drop("key")
    return packed.withColumnRenamed("__id", beside([id_col], packed.columns)[0])
