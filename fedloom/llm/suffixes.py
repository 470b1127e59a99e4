"""Substring dedup by a logarithmic family of suffix arrays.

The suffixes are the anchors of ``anchors.py``.  Batches of them are sorted and merge-scanned against the levels of a
family that merge geometrically; what repeats there is confirmed among the suffixes that share an anchor: sorted
by what follows and by what precedes, with longest common prefixes, they tell which windows are equal, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import SURE, THROUGH, Bytes, contexts, grouped, merged, prepared, removals, repeated_anchors
from .common import beside, schema_of

SPAN = 200
ANCHOR = 100
#: Suffixes with one anchor held in a task; more are told apart by digests of their windows, dealt over all tasks.
MOST = 20_000
TOGETHER = 1 << 16


def _ranked(group: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and string, and each row's longest common prefix with the one before, -1 at a new group."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i])), np.int64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    padded = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)[order]
    differ = padded[1:] != padded[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.concatenate(([-1], common))


def repeated_windows(group: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], extra: int) -> np.ndarray:
    """For each row and distance 0 to ``extra`` whether the window that starts so far before the anchor stands in another row too."""
    n = len(left)
    by_right, common_right = _ranked(group, right, extra)
    by_left, common_left = _ranked(group, [x[::-1] for x in left], extra)
    found = np.zeros((n, extra + 1), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(extra + 1):
        own = np.flatnonzero((low <= d) & (d <= high))
        if len(own) < 2:
            continue
        right_class[by_right] = np.cumsum(common_right < extra - d)
        left_class[by_left] = np.cumsum(common_left < d)
        key = right_class[own] * (n + 1) + left_class[own]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        found[own[order[1:][same]], d] = True
        found[own[order[:-1][same]], d] = True
    return found


def _spans(rows: np.ndarray, at: np.ndarray, found: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the bytes covered by each run of repeated windows."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return rows[i], at[i] - end + 1, at[i] - begin + span


def repeated_spans(rows: DataFrame, span: int = SPAN, k: int = ANCHOR, carry: tuple[str, ...] = ("doc_id",), most: int = MOST) -> DataFrame:
    """(__row, spans): ranges of bytes covered by ``span``-byte strings that start in two places of the corpus at least."""
    units, extra = Bytes(span, k), span - k
    near = contexts(rows, repeated_anchors(rows, units), units, carry)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in grouped(batches, most, TOGETHER):
            mark = table.column("mark").to_numpy()
            if (mark == THROUGH).any():
                row, place = (table.filter(pa.array(mark == THROUGH)).column(c).to_numpy() for c in ("__row", "place"))
                yield _told(row, (place >> 16) - (place & 255), (place >> 16) - (place >> 8 & 255) + span)
                table, mark = table.filter(pa.array(mark != THROUGH)), mark[mark != THROUGH]
            row, place = (table.column(c).to_numpy() for c in ("__row", "place"))
            keys, left, right = (table.column(c).to_pylist() for c in ("key", "left", "right"))
            at, low, high = place >> 16, place >> 8 & 255, place & 255
            if whole and len(keys):
                group = np.cumsum(np.fromiter((a != b for a, b in zip(keys, [None, *keys], strict=False)), np.int64, len(keys)))
                found = repeated_windows(group, low, high, left, right, extra)
                distance = np.arange(extra + 1)
                found |= (mark == SURE)[:, None] & (low[:, None] <= distance) & (distance <= high[:, None])
                yield _told(*_spans(row, at, found, span))
            elif len(keys):
                sure = mark == SURE
                yield _told(row[sure], (at - high)[sure], (at - low)[sure] + span)
                count = high - low + 1
                number = np.repeat(np.arange(len(row)), count)
                distance = np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count) + low[number]
                digests = [
                    hashlib.blake2b(keys[i] + bytes([d]) + left[i][len(left[i]) - d:] + right[i][:extra - d], digest_size=16).digest()
                    for i, d in zip(number.tolist(), distance.tolist(), strict=True)
                ]
                yield _told(row[number], at[number] - distance, at[number] - distance + span, digests)

    told = near.repartition("key").sortWithinPartitions("key").mapInArrow(confirm, "digest binary, __row long, first long, last long")
    times = F.count(F.lit(1)).over(Window.partitionBy("digest", F.when(F.col("digest").isNull(), F.col("__row"))))
    return removals(told.withColumn("times", times).where("digest IS NULL OR times > 1"))


def _told(row: np.ndarray, first: np.ndarray, last: np.ndarray, digests: list[bytes] | None = None) -> pa.RecordBatch:
    """Spans to be removed; those with a digest only if it turns up again."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(row), pa.binary()) if digests is None else pa.array(digests, pa.binary()), *map(pa.array, (row, first, last))], ["digest", "__row", "first", "last"])


def without_repeats(docs: DataFrame, span: int = SPAN, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), kept: bool = False, most: int = MOST) -> DataFrame:
    """Each row's id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, the remaining text ``kept``.

    A carried column named like one of these gets ``_`` behind its name.  A byte goes if a ``span``-byte string over it also starts elsewhere, in the same document or another; so all places
    of a repeat lose it.  ``kept`` leaves out what remains of a code point that was cut in two.  NULL and empty texts remove nothing; repeated rows repeat each other; no rows give none.
    """
    given = (id_col, *carry)
    keep = [f"__c{i}" for i in range(len(given))]
    rows = prepared(docs, text_col, given).toDF("__row", "__text", *keep)
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:4 + kept]
    found = repeated_spans(rows, span, k, keep, most)
    joined = rows.join(found, "__row", "left").select("__text", *[F.col(f"`{c}`") for c in keep], "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone, left, at = merged(spans), [], 0
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                rest = b"".join([*left, text[at:]])
                out.append((len(text), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "ignore")] * kept)))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())[:4 + kept])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *results])

    found = joined.mapInArrow(cut, schema_of(joined, *keep) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * kept)
    return found.toDF(*beside(given, results), *results)
