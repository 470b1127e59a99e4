"""Benchmark decontamination by pigeonhole edit matching.

With a budget of ``e`` edits an item is cut into ``e + 1`` pieces, so one piece at least stands unchanged in any
passage within the budget.  An automaton of all pieces finds them exactly in every whole document, and Myers'
bit-parallel distance verifies the text round each hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import name_of, schema_of

#: Edits allowed, as a share of the item's characters.
ERROR_RATE = 0.05
#: Characters of items that a task holds at a time; each block passes over the documents that the task holds.
BLOCK_CHARS = 1 << 20


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed; NULL as empty."""
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors + 1`` pieces of nearly equal length that cover the item."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between ``pattern`` and any part of ``text``, and the first end of such a part."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(x | up)), up & x
        if score < best:
            best, end = score, j
    return best, end


def place(item: str, text: str, errors: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best passage of ``text``, if within ``errors`` edits."""
    distance, end = myers(item, text)
    if distance > errors:
        return None
    return distance, end - myers(item[::-1], text[:end][::-1])[1], end


class Matcher:
    """Items of one block; ``items`` are normalised and not empty."""

    def __init__(self, items: list[str], rate: float = ERROR_RATE):
        self.items = items
        self.errors = [budget(i, rate) for i in items]
        starts: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(items):
            for offset, piece in pieces(item, self.errors[k]):
                starts.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in starts.items():
            self.automaton.add_word(piece, (len(piece), where))
        if starts:
            self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """Item number -> (distance, start, end, passages) of the best passage of a normalised text, the first at a tie."""
        if not self.items or not text:
            return {}
        likely: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                likely.setdefault(k, set()).add(end + 1 - size - offset)
        found: dict[int, tuple[int, int, int, int]] = {}
        for k, begins in likely.items():
            item, errors = self.items[k], self.errors[k]
            spans: list[list[int]] = []
            for begin in sorted(begins):  # one verification for hits whose windows share a passage
                if spans and begin - spans[-1][1] <= errors:
                    spans[-1][1] = begin
                else:
                    spans.append([begin, begin])
            places = []
            for first, last in spans:
                low = max(0, first - errors)
                if got := place(item, text[low:last + len(item) + errors], errors):
                    places.append((got[0], got[1] + low, got[2] + low))
            if places:
                found[k] = (*min(places), len(set(places)))
        return found


def store_items(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> list[str]:
    """Files below the shared folder that hold (key, item): the normalised items that are not empty, about a block in each.

    Tasks normalise and write the items; the driver sees the number of characters and the names of the files.  The
    files have to be in a folder that Arrow can open from a task: a mounted one, or one on HDFS or an object store.
    """
    spark = benchmark.sparkSession
    given = benchmark.select(name_of(item_col).alias("key"), name_of(text_col).cast("string").alias("item")).where("item IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [normal(t) for t in batch.column("item").to_pylist()]
            rows = [r for r, item in enumerate(items) if item]
            keys = batch.column("key").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([items[r] for r in rows], pa.string())], ["key", "item"])

    chars = given.agg(F.sum(F.length("item"))).first()[0] or 0
    path = scratch_path(spark, "benchmark-items")
    schema = schema_of(given, "key", "item")
    given.mapInArrow(run, schema).repartition(1 + chars // block_chars).write.parquet(path)
    return sorted(spark.read.schema(schema).parquet(path).inputFiles())


class StoredItems:
    """Matchers of the items in ``files``, one block of about ``block_chars`` characters at a time."""

    def __init__(self, files: list[str], rate: float, block_chars: int):
        self.files, self.rate, self.block_chars = files, rate, block_chars
        self.all: list[tuple[list, Matcher]] | None = None

    def _blocks(self) -> Iterator[tuple[list, list[str]]]:
        keys, items, size = [], [], 0
        for name in self.files:
            files, path = FileSystem.from_uri(name.replace("s3a://", "s3://", 1) if name.startswith("s3a://") else name)
            with files.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=64):
                    for key, item in zip(batch.column("key").to_pylist(), batch.column("item").to_pylist(), strict=True):
                        keys.append(key)
                        items.append(item)
                        size += len(item)
                        if size >= self.block_chars:
                            yield keys, items
                            keys, items, size = [], [], 0
        if items:
            yield keys, items

    def matchers(self) -> Iterator[tuple[list, Matcher]]:
        """(keys, matcher) of each block; a single block is read once, several are read again at each call."""
        if self.all is not None:
            yield from self.all
            return
        n, last = 0, []
        for keys, items in self._blocks():
            last = [(keys, Matcher(items, self.rate))]
            n += 1
            yield last[0]
        if n <= 1:
            self.all = last


def leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", carry: tuple[str, ...] = (), block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, carry..., item, distance, start, end, n_places): a row for each row of ``docs`` and item it holds within the budget.

    ``start`` and ``end`` are places in the normalised text.  NULL and empty texts hold nothing; NULL and empty items
    are in no document; repeated documents or items each get their rows; no hit, no row.  The documents are read once,
    without a shuffle, however many items there are.
    """
    keep = (id_col, *carry)
    given = docs.select(*[name_of(c).alias(c) for c in keep], name_of(text_col).cast("string").alias("__text"))
    kind = benchmark.select(name_of(item_col)).schema[0].dataType
    schema = f"{schema_of(given, *keep)}, item_id {kind.simpleString()}, distance int, start long, end long, n_places int"
    files, key_type = store_items(benchmark, item_col, item_text_col, block_chars), _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = StoredItems(files, rate, block_chars)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for keys, matcher in stored.matchers():
                rows, hits = [], []
                for r, text in enumerate(texts):
                    for k, hit in sorted(matcher.matches(normal(text)).items()):
                        rows.append(r)
                        hits.append((k, *hit))
                own = batch.select(list(keep)).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([keys[h[0]] for h in hits]).cast(key_type), *(pa.array([h[i] for h in hits], t) for i, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int32())))],
                    [*keep, "item_id", "distance", "start", "end", "n_places"],
                )

    return given.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark within the budget, unchanged, in one reading and without a shuffle."""
    files = store_items(benchmark, item_text_col, item_text_col, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = StoredItems(files, rate, block_chars)
        for batch in batches:
            texts, left = batch.column(text_col).to_pylist(), range(batch.num_rows)
            for _, matcher in stored.matchers():
                left = [r for r in left if not matcher.matches(normal(texts[r]))]
            yield batch.take(pa.array(left, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
