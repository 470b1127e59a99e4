"""Periodic runs of words by online dyadic square catching.

A run of smallest period p opens with a square, two equal halves of p words.  Whatever the place of that square, its
second half holds a whole aligned block of ``size`` words, where ``size`` is the power of two with
``2 * size <= p < 4 * size`` (one word for p < 4).  So each block, once its last word has been appended, gets a
catcher: every earlier place of the block at such a distance p is a candidate.  A backward suffix comparison finds
where its run would begin and with that the word that would complete the first square; when that word arrives, the
words since the block are compared.  A square that holds opens a run, and the run lives on as long as each appended
word equals the one p words before.

A block inside an open run of a short period q stands at every multiple of q in an earlier stretch of that kind.  Of
those places only the one counts whose stretch begins p words before the run: a run of three periods or more is caught
there at the latest in its third period, because its stretches of period q are all shorter than p + q.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, name_of, schema_of, text_bytes

_WIDTH = array("I").itemsize


class SquareCatcher:
    """All runs of at least ``max(least, exponent * period)`` words in a sequence of numbers that grows at its end.

    ``runs`` holds (start, length, period) of each run that has ended; ``finish`` ends those still open.  ``exponent``
    is 2 at least; from 3 on, long stretches of a short period cost no more than other words.
    """

    def __init__(self, least: int = 6, exponent: int = 4) -> None:
        self.least, self.exponent = least, max(2, exponent)
        self.periods = 2 if self.exponent > 2 else 1  # how many of them after the first may hold the block that catches
        self.words: list[int] = []
        self.packed = bytearray()
        self.open: dict[int, int] = {}  # period -> start of the run that includes the last word
        self.due: dict[int, list[tuple[int, int, int]]] = {}  # word -> (period, start, first word not compared yet)
        self.runs: list[tuple[int, int, int]] = []

    def extend(self, ids: Iterable[int]) -> None:
        """Append words one after the other."""
        words, begin = self.words, len(self.words)
        words.extend(ids)
        self.packed += array("I", words[begin:]).tobytes()
        live, due, candidate, catch = self.open, self.due, self._candidate, self._catch
        for n in range(begin, len(words)):
            x = words[n]
            if live:
                for p in [p for p in live if words[n - p] != x]:
                    self._close(p, n)
            if n in due:
                for p, start, unseen in due.pop(n):
                    self._square(p, start, unseen, n)
            if n > 2:  # the catcher of a single word
                if words[n - 1] == x:
                    candidate(n, 1, 1, n)
                if words[n - 2] == x:
                    candidate(n, 1, 2, n)
                if words[n - 3] == x:
                    candidate(n, 1, 3, n)
            else:
                for p in range(1, n + 1):
                    if words[n - p] == x:
                        candidate(n, 1, p, n)
            size, done = 2, n + 1
            while not done % size and done >= 3 * size:
                catch(done - size, size, n)
                size *= 2

    def finish(self) -> list[tuple[int, int, int]]:
        """End the open runs; all runs by start, then period."""
        for p in list(self.open):
            self._close(p, len(self.words))
        self.due.clear()
        self.runs.sort(key=lambda run: (run[0], run[2]))
        return self.runs

    def _same(self, i: int, j: int, count: int) -> bool:
        a, b, c = i * _WIDTH, j * _WIDTH, count * _WIDTH
        return self.packed[a:a + c] == self.packed[b:b + c]

    def _back(self, i: int, p: int, most: int) -> int:
        """How many words before ``i`` equal those p words earlier, ``most`` at most."""
        words, most, t = self.words, min(most, i - p), 0
        while t < most and words[i - 1 - t] == words[i - 1 - p - t]:
            t += 1
            if t == 16:
                break
        else:
            return t
        step = 16
        while step:  # whole stretches, each twice as long as the one before, then ever shorter ones
            if t + step <= most and self._same(i - t - step, i - p - t - step, step):
                t += step
                step *= 2
            else:
                step //= 2
                while step and t + step > most:
                    step //= 2
        return t

    def _catch(self, i: int, size: int, n: int) -> None:
        """Candidates of the block of ``size`` words from ``i``, whose last word is ``n``."""
        low, high, short, begin = max(0, i - 4 * size + 1), i - 2 * size, 0, 0
        for q, start in self.open.items():
            if 2 * q <= size and start <= i:
                high = min(high, start - 1)  # places inside a run that holds the block give multiples of its period
                short, begin = q, start
        if short and self.exponent > 2:
            words, lead = self.words, i - begin
            for twin in range(max(0, low - lead), high - lead + 1):
                if words[twin] == words[begin] and (not twin or words[twin - 1] != words[twin - 1 + short]) and self._same(twin + lead, i, size):
                    self._candidate(i, size, begin - twin, n)
            return
        block, packed, end = self.packed[i * _WIDTH:(n + 1) * _WIDTH], self.packed, (high + size) * _WIDTH
        at = packed.find(block, low * _WIDTH, end)
        while at >= 0:
            if not at % _WIDTH:
                self._candidate(i, size, i - at // _WIDTH, n)
            at = packed.find(block, at - at % _WIDTH + _WIDTH, end)

    def _candidate(self, i: int, size: int, p: int, n: int) -> None:
        if p in self.open:
            return
        most = self.periods * p - size
        back = self._back(i, p, most + 1)
        if back > most:
            return  # an earlier block has caught it
        start, last = i - p - back, i - back + p - 1
        if last <= n:
            self._square(p, start, n + 1, n)
        else:
            self.due.setdefault(last, []).append((p, start, n + 1))

    def _square(self, p: int, start: int, unseen: int, n: int) -> None:
        """The square of period p that begins at ``start`` and ends with word ``n`` opens or merges into a run."""
        if p in self.open or not self._same(unseen, unseen - p, n + 1 - unseen):
            return
        if any(p % q == 0 and first <= start for q, first in self.open.items()):
            return  # its halves are repetitions themselves
        self.open[p] = start

    def _close(self, p: int, end: int) -> None:
        start = self.open.pop(p)
        if end - start >= max(self.least, self.exponent * p):
            self.runs.append((start, end - start, p))


def runs_of(words: list[bytes], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of words, by start, then period."""
    first: dict[bytes, int] = {}
    catcher = SquareCatcher(least, exponent)
    catcher.extend(map(first.setdefault, words, range(len(words))))
    return catcher.finish()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period:start + length] = b"\1" * (length - period)
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if runs else b" ".join(words)


def looped(words: list[bytes], seed: int) -> list[bytes]:
    """The words with a loop at their end where ``seed`` is a multiple of ten: test damage, fixed by the seed alone."""
    n = len(words)
    if seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text", seed: Column | None = None) -> DataFrame:
    """Runs of words in each whole text: their number, the longest one, a digest of all, and one of the words without the repeats.

    One row for each row of ``docs`` (repeated rows each get theirs), in one narrow pass: ``n_runs``; ``start``,
    ``length``, ``period`` and ``exponent_milli`` of the longest run (ties: smallest start, then period), NULL without
    a run; ``runs_sha256`` and ``collapsed_sha256``, never NULL.  NULL and wordless texts have no words and no runs;
    an empty table gives an empty result; other columns of ``docs`` are not read.  Memory follows the longest single
    text.  ``seed``, unsigned numbers, damages texts by ``looped`` first.
    """
    key = fresh_name(docs.select(), "id")
    given = docs.select(name_of(id_col).alias(key), text_bytes(text_col).alias("text"), (F.lit(1) if seed is None else seed).cast("long").alias("seed"))
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def one(raw: bytes, seed: int) -> tuple:
        words = looped(raw.split(), seed)
        runs = runs_of(words, least, exponent)
        told = "".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return len(runs), *longest, hashlib.sha256(told).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(one(raw, s) for raw, s in zip(batch.column("text").to_pylist(), batch.column("seed").to_pylist(), strict=True)), strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(key)] + [pa.array(f, k) for f, k in zip(found, kinds, strict=True)], [key, *columns])

    kinds = ", ".join([schema_of(given, key), *(f"{c} long" for c in columns[:5]), *(f"{c} string" for c in columns[5:])])
    return given.mapInArrow(run, kinds).withColumnRenamed(key, id_col)
