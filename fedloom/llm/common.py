"""Shared by the operators: text as bytes, safe column names, and words of a buffer as numpy arrays.

Words are runs of bytes other than ASCII white space (space, ``\\t`` to ``\\r``), as ``bytes.split`` gives them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash arithmetic is modulo 2**64; the multiplier is odd, so it has an inverse.
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes of text hashed together, unless a single document is longer.
POOL_BYTES = 2 << 20


def name_of(column: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(f"`{column.replace('`', '``')}`")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, NULL as empty."""
    return F.coalesce(name_of(column).cast("binary"), F.lit(b""))


def fresh_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until the frame has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def beside(columns: Iterable[str], results: Iterable[str]) -> list[str]:
    """Names for carried columns beside those of a result: one that is taken, in any letter case, gets ``_`` at its end."""
    taken, names = {r.lower() for r in results}, []
    for name in columns:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def steady(docs: DataFrame) -> DataFrame:
    """``docs``, whose stored files from now on fall into the same partitions each time the session reads them.

    Spark cuts files by the number of cores there are when it reads them, so a lost executor would give rows other
    numbers at the second reading.  The number of the first reading stays, unless the session names one of its own.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(cores))
    return docs


def schema_of(df: DataFrame, *columns: str) -> str:
    """DDL of some columns, for the result of ``mapInArrow``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def pooled(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = POOL_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes, one row at least, beside those texts."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start = size = 0
        for i, value in enumerate(texts):
            if size and size + len(value) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(value)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)):
        powers = np.empty(n, np.uint64)
        powers[0], done = 1, 1
        while done < n:
            step = np.uint64(pow(m, done, 1 << 64))
            more = min(done, n - done)
            powers[done:done + more] = powers[:more] * step
            done += more
        out.append(powers)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n-1 of the multiplier and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A fixed random 64-bit value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))
#: The same with A-Z counted as a-z.
LOWER_VALUES = BYTE_VALUES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[j] * multiplier**j``; a difference of two, scaled back, hashes what lies between."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), the same wherever a span stands."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the joined texts, and each document's first word (one more at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.concatenate(([0], np.searchsorted(start, ends)))
    values, hashes, i = LOWER_VALUES if lower else BYTE_VALUES, np.empty(len(start), np.uint64), 0
    while i < len(start):  # in slices, so that a very long document needs no more room
        j = max(i + 1, int(np.searchsorted(end, start[i] + POOL_BYTES, "right")))
        a, b = start[i], end[j - 1]
        hashes[i:j] = span_hashes(prefix_sums(values[data[a:b]]), start[i:j] - a, end[i:j] - a)
        i = j
    return hashes, first


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of equal weight, compressed: small numbers are mostly zero bytes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin; a shard is a range of hashes."""
    first = [(s << 64) // shards for s in range(1, shards)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(first, np.uint64)), [len(keys)]))
