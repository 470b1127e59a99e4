"""Substring dedup by repeated-phrase automata.

Anchored phrases that stand in two places are candidates.  The passages round them are dealt out by phrase, so each
shard meets every passage that could share a window with another; it confirms the windows that stand in two documents,
compiles them to an Aho-Corasick automaton, and streams the passages of all documents through it to find every
occurrence.  In a shard a word is one character, and the anchored phrase is one character too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import THROUGH, Words, contexts, grouped, merged, prepared, removals, repeated_anchors, runs
from .common import beside

SPAN = 13
ANCHOR = 5
#: Passages with one phrase held in a task; more are told apart by digests of their windows, dealt over all tasks.
MOST = 20_000
#: Passages that make one shard: their windows have to fit an automaton in a task's memory.
TOGETHER = 1 << 14
_SURROGATES = range(0xD800, 0xE000)


def spelled(keys: list[bytes], left: list[bytes], right: list[bytes]) -> list[str]:
    """Each passage as a string of one character a word, its phrase one character as well; equal words, equal characters."""
    number: dict[tuple[bool, bytes], str] = {}

    def of(phrase: bool, word: bytes) -> str:
        if (own := number.get((phrase, word))) is None:
            code = len(number) + 1
            own = number[phrase, word] = chr(code if code < _SURROGATES.start else code + len(_SURROGATES))
        return own

    return [
        "".join([*(of(False, w) for w in a.split()), of(True, k), *(of(False, w) for w in b.split())])
        for k, a, b in zip(keys, left, right, strict=True)
    ]


def later_windows(passages: list[str], docs: list[int | None], width: int) -> list[list[tuple[int, int]]]:
    """For each passage the runs [first, last) of windows that also stand in a passage of a smaller document.

    A passage whose windows all have the same first document is one pattern of the automaton; of others each window
    is.  Equal passages are streamed once.  NULL documents come after all others and before none.
    """
    least: dict[str, float] = {}
    most: dict[str, float] = {}
    order = [float("inf") if d is None else d for d in docs]
    for passage, doc in zip(passages, order, strict=True):
        if least.setdefault(passage, doc) > doc:
            least[passage] = doc
        if most.setdefault(passage, doc) < doc:
            most[passage] = doc
    window_of: dict[str, float] = {}
    for passage, doc in least.items():
        for i in range(len(passage) - width + 1):
            window = passage[i:i + width]
            if window_of.setdefault(window, doc) > doc:
                window_of[window] = doc
    automaton = ahocorasick.Automaton()
    for passage, last in most.items():
        firsts = [window_of[passage[i:i + width]] for i in range(len(passage) - width + 1)]
        if firsts and min(firsts) == max(firsts):
            if firsts[0] < last:
                automaton.add_word(passage, (len(passage), firsts[0]))
        else:
            for i, first in enumerate(firsts):
                if first < last:
                    automaton.add_word(passage[i:i + width], (width, first))
    if not len(automaton):
        return [[] for _ in passages]
    automaton.make_automaton()
    places: dict[str, list[float]] = {}
    for passage, last in most.items():
        firsts = None
        for end, (size, first) in automaton.iter(passage):
            if firsts is None:
                firsts = places[passage] = [float("inf")] * (len(passage) - width + 1)
            begin = end + 1 - size
            firsts[begin:end + 2 - width] = [first] * (size - width + 1)
    found = []
    for passage, doc in zip(passages, order, strict=True):
        firsts = places.get(passage)
        if firsts is None:
            found.append([])
        elif max(firsts) < doc:
            found.append([(0, len(firsts))])
        elif min(firsts) >= doc:
            found.append([])
        else:
            found.append(list(runs([f < doc for f in firsts])))
    return found


def later_spans(rows: DataFrame, span: int = SPAN, k: int = ANCHOR, id_col: str = "doc_id", most: int = MOST, together: int = TOGETHER) -> DataFrame:
    """(__row, spans): ranges of words covered by ``span``-word windows that also start in a document with a smaller id."""
    units, extra = Words(span, k), span - k
    near = contexts(rows, repeated_anchors(rows, units), units, (id_col,), id_col)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, whole in grouped(batches, most, together):
            mark = table.column("mark").to_numpy()
            if (mark == THROUGH).any():
                settled = table.filter(pa.array(mark == THROUGH))
                place = settled.column("place").to_numpy()
                yield _told(settled.column("__row").to_numpy(), None, (place >> 16) - (place & 255), (place >> 16) - (place >> 8 & 255) + span)
                table = table.filter(pa.array(mark != THROUGH))
            if not len(table):
                continue
            keys, left, right, docs = (table.column(c).to_pylist() for c in ("key", "left", "right", id_col))
            row, place = (table.column(c).to_numpy() for c in ("__row", "place"))
            start, count = (place >> 16) - (place & 255), (place & 255) - (place >> 8 & 255) + 1
            if whole:
                found = later_windows(spelled(keys, left, right), docs, extra + 1)
                number = np.repeat(np.arange(len(row)), [len(f) for f in found])
                run = np.array([r for f in found for r in f], np.int64).reshape(-1, 2)
                yield _told(row[number], None, start[number] + run[:, 0], start[number] + run[:, 1] - 1 + span)
            else:
                digests = []
                for i, (key, n) in enumerate(zip(keys, count.tolist(), strict=True)):
                    before, after = left[i].split(), right[i].split()
                    for d in range(len(before), len(before) - n, -1):
                        window = b" ".join([key, *before[len(before) - d:], b"", *after[:extra - d]])
                        digests.append(hashlib.blake2b(bytes([d]) + window, digest_size=16).digest())
                number = np.repeat(np.arange(len(row)), count)
                first = start[number] + np.arange(len(number)) - np.repeat(np.cumsum(count) - count, count)
                yield _told(row[number], [docs[i] for i in number.tolist()], first, first + span, digests)

    told = near.repartition("key").sortWithinPartitions("key").mapInArrow(locate, "digest binary, __row long, doc long, first long, last long")
    least = F.min("doc").over(Window.partitionBy("digest", F.when(F.col("digest").isNull(), F.col("__row"))))
    return removals(told.withColumn("least", least).where("digest IS NULL OR least < doc OR (doc IS NULL AND least IS NOT NULL)"))


def _told(row: np.ndarray, docs: list[int | None] | None, first: np.ndarray, last: np.ndarray, digests: list[bytes] | None = None) -> pa.RecordBatch:
    """Spans to be removed; those with a digest only where a smaller document has it too."""
    own = [pa.nulls(len(row), t) if v is None else pa.array(v, t) for v, t in ((digests, pa.binary()), (docs, pa.int64()))]
    return pa.RecordBatch.from_arrays([own[0], pa.array(row), own[1], pa.array(first), pa.array(last)], ["digest", "__row", "doc", "first", "last"])


def without_later(docs: DataFrame, span: int = SPAN, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, together: int = TOGETHER) -> DataFrame:
    """Each row's id, ``n_words``, ``n_removed`` and ``kept_sha256`` of the words left, joined by a space.

    A word goes if a ``span``-word window over it also starts in a document with a smaller id (a whole number); the
    document of the smallest id keeps it.  Rows with equal ids are one document's; NULL ids come last and never make
    another row lose a word.  An id named like a result gets ``_`` behind its name.  NULL and empty texts have no words; no rows give none.
    """
    rows = prepared(docs, text_col, (id_col,)).toDF("__row", "__text", "__id").withColumn("__id", F.col("__id").cast("long"))
    joined = rows.join(later_spans(rows, span, k, "__id", most, together), "__row", "left").select("__text", "__id", "spans")
    results = ["n_words", "n_removed", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, left, at = text.split(), [], 0
                for a, b in merged(spans):
                    left += words[at:a]
                    at = b
                left += words[at:]
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *columns], ["__id", *results])

    found = joined.mapInArrow(cut, "__id long, n_words long, n_removed long, kept_sha256 string")
    return found.toDF(*beside([id_col], results), *results)
