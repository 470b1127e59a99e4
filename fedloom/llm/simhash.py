"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts.  A tile holds the fingerprints whose eight bytes
have the same bit counts.  Two fingerprints within ``radius`` bits have byte counts that differ by ``radius`` in sum
at most, so tile pairs further apart are skipped without loss.  Neighbouring tiles meet without a join of tiles:
each fingerprint also goes to the tiles half the radius away, and any two counts within the radius share one of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import name_of, schema_of, text_bytes
from .components import components

SEED = 42
#: Fingerprints compared with each other at once; a fuller tile is cut into parts that meet pairwise.
TILE = 2048
_BITS = np.uint8(1) << np.arange(8, dtype=np.uint8)


def fingerprint(raw: bytes, width: int) -> int:
    """64-bit SimHash, as a signed number, of the ``width``-word shingles of one text given as UTF-8."""
    words = raw.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``fp`` (long), a row for each row of ``docs``; NULL text is empty and has fingerprint 0."""
    given = docs.select(*[name_of(c).alias(c) for c in carry], text_bytes(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, width) for x in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(found, pa.int64())], [*carry, "fp"])

    return given.mapInArrow(run, schema_of(given, *carry) + ", fp long")


def _count(fp: Column, byte: int) -> Column:
    return F.bit_count(F.shiftright(fp, 8 * byte).bitwiseAND(F.lit(255).cast("long"))).cast("long")


def _near_tiles(radius: int) -> list[tuple[int, ...]]:
    """All shifts of eight counts by ``ceil(radius / 2)`` in sum."""
    shifts = {(0,) * 8}
    for _ in range((radius + 1) // 2):
        shifts |= {(*s[:i], s[i] + d, *s[i + 1:]) for s in shifts for i in range(8) for d in (-1, 1)}
    return sorted(shifts)


def _pairs(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius`` bits of rows with the same key; ``key`` is sorted."""
    first, second = [], []
    at, step = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= radius]  # of signed numbers it counts the absolute value
        first.append(near)
        second.append(near + step)
        step += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64),) * 2


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, smallest i reachable) that connect what the pairs connect."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp``: they connect exactly what pairs within ``radius`` bits connect.

    Each tile gives a star for each of its components instead of all pairs, so a dense group stays linear.
    """
    fp = F.col("fp")
    counts = [_count(fp, i) for i in range(8)]
    # nine values for each byte and a margin on both sides, five bits each
    own = sum((((c + 8) * (1 << 5 * i)) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    shifts = F.array(*[F.lit(sum(d << 5 * i for i, d in enumerate(s))).cast("long") for s in _near_tiles(radius)])
    placed = fps.select("fp", F.explode(F.transform(shifts, lambda s: own + s)).alias("tile"))
    sizes = placed.groupBy("tile").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    parted = placed.join(sizes, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = parted.select("fp", "tile", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        F.xxhash64("tile", F.least("part", "other"), F.greatest("part", "other")).alias("meeting"), "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def compare(meeting: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            node, root = _stars(*_pairs(meeting, fp, radius), len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[node]), pa.array(fp[root])], ["a", "b"])

        for batch in batches:
            meeting, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("meeting", "fp"))
            held.append((meeting, fp))
            size += len(fp)
            if size < 1 << 16:
                continue
            meeting, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            whole = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on
            yield compare(meeting[:whole], fp[:whole])
            held, size = [(meeting[whole:], fp[whole:])], len(fp) - whole
        if held:
            yield compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = met.repartition("meeting").sortWithinPartitions("meeting", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``fp``, ``component_id``, the smallest id among the rows its fingerprint reaches in steps of ``radius`` bits, and ``component_fp``, the component's smallest fingerprint.

    A row for each row of ``docs``; rows with equal texts share everything.  NULL and wordless texts have fingerprint
    0, which is linked like any other.  NULL ids count only where a component has no other id; an empty table gives
    an empty result.
    """
    marked = materialize(fingerprints(docs, width, text_col, (id_col, *carry)))
    least = marked.groupBy("fp").agg(F.min(name_of(id_col)).alias("__least"))
    found = components(links(least.select("fp"), radius))
    rooted = least.join(found, F.col("fp") == F.col("node"), "left").select("fp", "__least", F.coalesce("root", "fp").alias("__root"))
    named = rooted.groupBy("__root").agg(F.min("__least").alias("component_id"))
    groups = rooted.join(named, "__root").select("fp", "component_id", F.col("__root").alias("component_fp"))
    return marked.join(groups, "fp").select(*[name_of(c) for c in (id_col, *carry)], "fp", "component_id", "component_fp")
