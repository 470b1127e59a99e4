"""URL filters over a sorted digest array.

Entries are hashed with 64-bit xxHash and sorted; the keys, offsets and full strings lie in one file that Spark ships
to every executor and that the tasks map into memory.  A probe is a vectorised binary search, and a hit counts only
if the stored string is the probed one, so a collision of hashes never blocks a page.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import beside, name_of, schema_of

#: (verdict, rule): the host before the first slash, the path from it on.
CONTRACT_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A host with one of these between its dots and hyphens is blocked where no rule fits.
BLOCKED_WORDS = (
    "adult", "ads", "bet", "bets", "betting", "bingo", "casino", "dating", "escort", "gambling", "jackpot", "malware", "payday",
    "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
)
_HOST = re.compile("[/?#]")
_PATH = re.compile("[?#]")
_WORD = re.compile("[.-]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host in lower case (A-Z) and path; both empty for NULL or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = _HOST.search(rest)
    host = rest[:at.start()] if at else rest
    return host.translate(_LOWER), _PATH.split(rest[len(host):], maxsplit=1)[0]


def keys_of(values: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(v.encode()) for v in values), np.uint64, len(values))


def write_array(entries: Iterable[str], path: str) -> None:
    """Sorted digests of the distinct entries, the offsets of their strings, and the strings, in one file."""
    found = sorted(set(entries), key=lambda e: (xxhash.xxh64_intdigest(e.encode()), e))
    strings = [e.encode() for e in found]
    offsets = np.cumsum([0, *map(len, strings)], dtype=np.uint64)
    with open(path, "wb") as out:
        out.write(np.uint64(len(found)).tobytes() + keys_of(found).tobytes() + offsets.tobytes() + b"".join(strings))


class DigestArray:
    """A file of ``write_array``, mapped into memory."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, np.uint64, 1)[0])
        self.keys = np.memmap(path, np.uint64, "r", 8, (n,)) if n else np.zeros(0, np.uint64)
        self.offsets = np.memmap(path, np.uint64, "r", 8 + 8 * n, (n + 1,))
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, np.uint8, "r", 16 + 16 * n, (size,)) if size else np.zeros(0, np.uint8)

    def find(self, values: list[str]) -> np.ndarray:
        """Whether each value is an entry."""
        wanted = keys_of(values)
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        found = np.zeros(len(values), bool)
        for i in np.flatnonzero(low < high):
            found[i] = any(self._string(j) == values[i].encode() for j in range(low[i], high[i]))
        return found

    def _string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]):int(self.offsets[i + 1])].tobytes()


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def ship_array(spark: SparkSession, entries: Iterable[str]) -> str:
    """Write the array beside the driver and let Spark copy it to every executor, new ones included; gives its name."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
    write_array(entries, path)
    spark.sparkContext.addFile(path)
    return name


def url_filter(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = CONTRACT_RULES, words: tuple[str, ...] = BLOCKED_WORDS, hosts: tuple[str, ...] = (),
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """id, host, path, rule and verdict of every row, without a shuffle.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, at equal
    length the one with the longer host.  Without a rule a page is blocked if a word of its host is in ``words`` or
    its host or a parent is in ``hosts``.  An id named like a result gets ``_`` behind its
    name.  NULL and malformed URLs have an empty host, fit no rule and are allowed.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    results = ["host", "path", "rule", "verdict"]
    lengths = sorted({len(rule) - rule.index("/") for rule in verdicts}, reverse=True)
    name = ship_array(pages.sparkSession, [*(f"r:{r}" for r in verdicts), *(f"w:{w}" for w in words), *(f"h:{h}" for h in hosts)])
    given = pages.select(name_of(id_col).alias("__id"), name_of(url_col).cast("string").alias("__url"))

    def probes(host: str, path: str) -> tuple[list[str], list[str]]:
        labels = host.split(".")
        parents = [".".join(labels[i:]) for i in range(len(labels))]
        fitting = [f"r:{p}{path[:n]}" for p in parents for n in lengths if len(path) >= n]  # a rule has a slash, so n is 1 at least
        fitting.sort(key=lambda e: (-len(e), -e.index("/")))
        return fitting, [*(f"w:{w}" for w in _WORD.split(host)), *(f"h:{p}" for p in parents)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _opened(name)
        for batch in batches:
            split = [parts(u) for u in batch.column("__url").to_pylist()]
            asked = {key: probes(*key) for key in set(split)}
            flat = list(dict.fromkeys(e for pair in asked.values() for own in pair for e in own))
            known = {e for e, hit in zip(flat, array.find(flat), strict=True) if hit}
            decided = {}
            for key, (fitting, others) in asked.items():
                rule = next((e[2:] for e in fitting if e in known), None)
                decided[key] = (rule, verdicts[rule] if rule else "block" if not known.isdisjoint(others) else "allow")
            columns = [[k[0] for k in split], [k[1] for k in split], [decided[k][0] for k in split], [decided[k][1] for k in split]]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(c, pa.string()) for c in columns)], ["__id", *results])

    return given.mapInArrow(run, schema_of(given, "__id") + ", host string, path string, rule string, verdict string").toDF(*beside([id_col], results), *results)
