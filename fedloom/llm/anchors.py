"""Sampled suffixes for repeated strings.

A window is ``span`` units, bytes or words, of one document.  Of the ``k``-unit pieces inside a window the one with the
least hash is its anchor.  The choice depends on the window's content alone, so equal windows have equal anchors at
equal places, and only anchors that stand in two places can belong to repeated windows.  About two in ``span - k + 2``
units are anchors; they are the suffixes that the index of ``suffixes.py`` and the automata of ``phrases.py`` work on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, MULTIPLIER, mixed, name_of, pack, pooled, powers, prefix_sums, schema_of, shard_edges, steady, text_bytes, unpack, words_of

#: Window starts worked on at once, and the low bits that tell their places.
_SLICE = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
#: Rows that become one batch of the index.
BATCH = 1 << 17
#: Text whose contexts are compared with each other before they are dealt out.
CONTEXT_BYTES = 8 << 20


def anchors(values: Callable[[int, int], np.ndarray], first: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of joined documents: document, place in it, least and greatest distance from a window's start, hash.

    ``values(a, b)`` hashes units a to b; document i has the units from ``first[i]`` to ``first[i + 1]``.  The windows of
    an anchor are contiguous; an anchor may come twice, with different windows.
    """
    total, width, out = int(first[-1]), span - k + 1, []
    for a in range(0, total - span + 1, _SLICE):
        unit = values(a, min(a + _SLICE + span - 1, total))
        sums = prefix_sums(unit)
        n = len(unit) - k + 1
        hashes = mixed((sums[k:] - sums[:-k]) * powers(n)[1])
        least, size = (hashes & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64)), 1  # the rightmost at a tie
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[:size - width], least[width - size:])
        place = (_LOW - (least & _LOW)).astype(np.int64)
        low, high = np.searchsorted(first, [a, a + len(place) - 1], "right") - 1
        edge = np.clip(first[low:high + 2], a, a + len(place))
        doc = np.repeat(np.arange(low, high + 1), np.diff(edge))
        starts = np.flatnonzero(np.arange(a, a + len(place)) + span <= first[doc + 1])
        if not len(starts):
            continue
        at = place[starts]
        cut = np.flatnonzero((at[1:] != at[:-1]) | (np.diff(starts) != 1))
        begin, end = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(starts) - 1]))
        at, doc = at[begin], doc[starts[begin]]
        # the least of many hashes is small, so they are spread again to be dealt out evenly
        out.append((doc, at + a - first[doc], at - starts[end], at - starts[begin], mixed(hashes[at])))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass(frozen=True)
class Bytes:
    """Windows of bytes."""

    span: int
    k: int

    def anchors(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        return anchors(lambda a, b: BYTE_VALUES[data[a:b]], first, self.span, self.k)

    def units(self, text: bytes) -> bytes:
        return text

    def piece(self, units: bytes, a: int, b: int) -> bytes:
        return units[a:b]


@dataclass(frozen=True)
class Words:
    """Windows of words, split at ASCII white space."""

    span: int
    k: int

    def anchors(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        hashes, first = words_of(texts)
        return anchors(lambda a, b: hashes[a:b], first, self.span, self.k)

    def units(self, text: bytes) -> list[bytes]:
        return text.split()

    def piece(self, units: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(units[a:b])


class Family:
    """A logarithmic family of sorted suffix lists.

    A batch is sorted and merge-scanned against each level; levels of about equal size merge, so there are few.  Each
    distinct hash is kept once, with the first place it was seen at, which is told when the second one turns up; the
    memory does not depend on how often a suffix repeats.
    """

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []  # hash, row, place, told

    def add(self, hashes: np.ndarray, row: np.ndarray, place: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of everything now known to repeat and not told before; ``sure`` suffixes repeat whatever else there is."""
        order = np.argsort(hashes, kind="stable")
        hashes, row, place, sure = hashes[order], row[order], place[order], sure[order]
        head = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        times = np.diff(np.concatenate((head, [len(hashes)])))
        distinct, again, new = hashes[head], (times > 1) | np.logical_or.reduceat(sure, head), np.ones(len(head), bool)
        told_row, told_place = [], []
        for h, r, p, told in self.levels:
            at = np.minimum(np.searchsorted(h, distinct), len(h) - 1)
            hit = h[at] == distinct
            again |= hit
            new &= ~hit
            first = at[hit][~told[at[hit]]]
            told_row.append(r[first])
            told_place.append(p[first])
            told[first] = True
        out = np.repeat(again, times)
        keep = head[new]
        level = [hashes[keep], row[keep], place[keep], again[new].copy()]
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = [np.concatenate(x) for x in zip(self.levels.pop(), level, strict=True)]
            order = np.argsort(level[0], kind="stable")
            level = [x[order] for x in level]
        if len(level[0]):
            self.levels.append(level)
        return np.concatenate([row[out], *told_row]), np.concatenate([place[out], *told_place])


def prepared(docs: DataFrame, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Row number, text as bytes and the carried columns."""
    return steady(docs).select(F.monotonically_increasing_id().alias("__row"), text_bytes(text_col).alias("__text"), *[name_of(c).alias(c) for c in carry])


def _dealt(hashes: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What of one batch's suffixes goes to which task: the number to deal by, the row, and the place with a mark.

    Of the suffixes that repeat within the batch one goes by its hash, marked as repeating; the others need no
    comparison any more and are dealt out evenly, so a suffix of very many places does not meet in one task.
    """
    order = np.argsort(hashes, kind="stable")
    same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1], [False]))
    mark = np.empty(len(hashes), np.int64)
    mark[order] = np.where(same[:-1], THROUGH, np.where(same[1:], SURE, PLAIN))
    even = mixed(row.astype(np.uint64) * np.uint64(MULTIPLIER) + place.astype(np.uint64))
    deal = np.where(mark == THROUGH, even, hashes)
    order = np.argsort(deal)
    return deal[order], row[order], (place << 2 | mark)[order]


PLAIN, SURE, THROUGH = 0, 1, 2
#: Bytes of text whose anchors one family holds, on average: 25 bytes each, for every 51 bytes (or five words) of text.
SHARD_BYTES = 1 << 29


def repeated_anchors(rows: DataFrame, units: Bytes | Words) -> DataFrame:
    """(__row, places): the anchors of each document that stand in two places of the corpus at least.

    A place is the anchor's position and its windows' least and greatest distance, in one number.  The anchors are
    dealt out by ranges of their hashes, packed, and each task feeds them to its family batch by batch.  There is a shard
    for each ``SHARD_BYTES`` of text at least, so what a task holds does not grow with the corpus.
    """
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for part, texts in pooled([batch], "__text"):
                doc, at, low, high, hashes = units.anchors(texts)
                parts.append((hashes, part.column("__row").to_numpy()[doc], at << 16 | low << 8 | high))
            if not parts:
                continue
            deal, row, place = _dealt(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            edge = shard_edges(deal, shards)
            for s in np.flatnonzero(np.diff(edge)).tolist():
                own = slice(edge[s], edge[s + 1])
                packed = [pack(np.diff(deal[own], prepend=np.uint64(0))), pack(row[own]), pack(place[own])]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["shard", "deal", "__row", "place"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        held, size = [], 0

        def told() -> pa.RecordBatch:
            deal, row, place = (np.concatenate(x) for x in zip(*held, strict=True))
            row, place = row.astype(np.int64), place.astype(np.int64)
            mark, place = place & 3, place >> 2
            through = mark == THROUGH
            found = [(row[through], place[through])]
            if not through.all():
                own = ~through
                found.append(family.add(deal[own], row[own], place[own], mark[own] == SURE))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["__row", "place"])

        for batch in batches:
            for deal, row, place in zip(*(batch.column(c).to_pylist() for c in ("deal", "__row", "place")), strict=True):
                held.append((np.cumsum(unpack(deal), dtype=np.uint64), unpack(row), unpack(place)))
                size += len(held[-1][0])
                if size >= BATCH:
                    yield told()
                    held, size = [], 0
        if size:
            yield told()

    assert units.span - units.k < 256
    sampled = rows.select("__row", "__text").mapInArrow(sample, "shard int, deal binary, __row binary, place binary")
    found = sampled.repartitionById(shards, F.col("shard")).mapInArrow(scan, "__row long, place long")
    return found.groupBy("__row").agg(F.collect_list("place").alias("places"))


def contexts(rows: DataFrame, places: DataFrame, units: Bytes | Words, carry: tuple[str, ...], order: str | None = None) -> DataFrame:
    """A row for each repeated anchor: digest of its piece, what stands left and right of it inside its windows.

    ``left`` has the greatest distance's units and ``right`` what the least distance leaves, so every window of the
    anchor, and nothing else, lies in left, piece and right.  Equal rows of a batch are compared at once: all but one
    are marked as settled and dealt out evenly instead of by anchor.  Without ``order`` any two settle each other and
    the one left is marked as repeating; with it the least in that column settles those above it.
    """
    extra = units.span - units.k
    joined = rows.join(places, "__row").select("__row", "__text", *[name_of(c) for c in carry], "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pooled([batch], "__text", CONTEXT_BYTES):
                number, keys, lefts, rights, kept = [], [], [], [], []
                for i, (text, own) in enumerate(zip(texts, part.column("places").to_pylist(), strict=True)):
                    held = units.units(text)
                    for place in own:
                        at, low, high = place >> 16, place >> 8 & 255, place & 255
                        number.append(i)
                        kept.append(place)
                        keys.append(hashlib.blake2b(units.piece(held, at, at + units.k), digest_size=16).digest())
                        lefts.append(units.piece(held, at - high, at))
                        rights.append(units.piece(held, at + units.k, at + units.k + extra - low))
                own = part.select(["__row", *carry]).take(pa.array(number, pa.int64()))
                row = own.column("__row").to_pylist()
                marks = _settled(keys, lefts, rights, kept, own.column(order).to_pylist() if order else None)
                keys = [b"%d,%d" % (r, p) if m == THROUGH else k for k, r, p, m in zip(keys, row, kept, marks, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), *own.columns, pa.array(kept, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(marks, pa.int32())],
                    ["key", "__row", *carry, "place", "left", "right", "mark"],
                )

    return joined.mapInArrow(cut, f"key binary, {schema_of(joined, '__row', *carry)}, place long, left binary, right binary, mark int")


def _settled(keys: list[bytes], lefts: list[bytes], rights: list[bytes], places: list[int], order: list[int | None] | None) -> list[int]:
    marks, seen = [PLAIN] * len(keys), {}
    for i, one in enumerate(zip(keys, lefts, rights, places, strict=True)):
        seen.setdefault((*one[:3], one[3] & 0xFFFF), []).append(i)
    for same in seen.values():
        if len(same) == 1:
            continue
        if order is None:
            for i in same:
                marks[i] = THROUGH
            marks[same[0]] = SURE
        else:
            value = [float("inf") if order[i] is None else order[i] for i in same]
            least = min(value)
            for i, v in zip(same, value, strict=True):
                if v > least:
                    marks[i] = THROUGH
    return marks


def grouped(batches: Iterator[pa.RecordBatch], most: int, together: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by ``key`` as tables of whole groups, of about ``together`` rows, beside True.

    A group of over ``most`` rows comes in parts instead, beside False: it is never held whole.
    """
    held: pa.Table | None = None
    spilling: bytes | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = table.column("key").to_pylist()
        if spilling is not None:
            same = next((i for i, x in enumerate(keys) if x != spilling), len(keys))
            if same:
                yield table.slice(0, same), False
            table, keys = table.slice(same), keys[same:]
            if not keys:
                continue
            spilling = None
        held = table if held is None else pa.concat_tables([held, table])
        last = len(held)
        keys = held.column("key").to_pylist() if len(held) > len(keys) else keys
        while last and keys[last - 1] == keys[-1]:
            last -= 1
        if last >= together or len(held) - last > most:
            if last:
                yield from _sized(held.slice(0, last), keys[:last], most)
            held = held.slice(last).combine_chunks()
            if len(held) > most:
                spilling = keys[-1]
                yield held, False
                held = None
    if held is not None and len(held):
        yield from _sized(held, held.column("key").to_pylist(), most)


def _sized(table: pa.Table, keys: list[bytes], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups; those of over ``most`` rows apart."""
    cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    begin = 0
    for a, b in zip(cut, cut[1:], strict=False):
        if b - a > most:
            if a > begin:
                yield table.slice(begin, a - begin), True
            yield table.slice(a, b - a), False
            begin = b
    if begin < len(keys):
        yield table.slice(begin), True


def runs(hit: list[bool]) -> Iterator[tuple[int, int]]:
    """[first, last) of each run of True."""
    begin = None
    for i, x in enumerate([*hit, False]):
        if x and begin is None:
            begin = i
        elif not x and begin is not None:
            yield begin, i
            begin = None


def removals(found: DataFrame) -> DataFrame:
    """(__row, spans): the ranges (first, last) to be removed from each document."""
    return found.groupBy("__row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges as disjoint maximal ones, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
