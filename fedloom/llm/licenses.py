"""License scans by canonical digests.

A text is brought to a canonical form - lower case, no copyright clauses, equivalent spellings, no punctuation - and
its whole digest is hash-joined to the digests of known licence texts.  Each whole line is looked up the same way,
which finds one-line notices inside other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, name_of, steady
from .notices import notices, whole_texts

#: Patterns of Java and, without the ``>`` of ``(?>``, of RE2, with the same matches: what such a group found first is
#: its only find that counts, so none is tried again and the time is linear in the line.  Java needs it, RE2 does not.
_MARK = r"^(?>[^\p{L}\p{N}]*(?:copyright|\(c\)|©))"
_YEAR = r"(?:[0-9]{4}|[\[<{(](?:yyyy|year|date))"
#: A copyright clause as far as its first year, or the place left for one; up to four full stops before it, after a letter each.
_CLAUSE = _MARK + r"(?>[^.!?\n]*?(?:\p{L}[.][^.!?\n]*?){0,4}" + _YEAR + r")"
#: What begins a statement about the licence after such a clause.
_STATED = (
    r"(?:this |these |all rights reserved|permission |redistribution |spdx|subject to |use of |code licens|"
    r"licens[^ .,;:|()\]>-]*(?:[-(][^ .,;:|()\]>-]*\)?){0,3} *:|"
    r"(?:licensed|released|distributed|published|available|made available|provided) under |"
    r"(?:the )?(?:mit|isc|bsd|apache|gnu|gpl|lgpl|agpl|mozilla|mpl|cc|creative commons) [^.!?\n]{0,120}licens)"
)
#: (pattern, replacement), in this order, for one line in lower case.  They are applied to both sides of the join.  Of
#: a line that begins with a copyright clause the rest stays: from a statement about the licence on, or else from the
#: next sentence on.  A full stop ends the clause after a word of five letters or a year, as names are abbreviated.
#: The beginnings of notices count as one spelling.
CANONICAL = (
    (r"licenc", "licens"),
    (_CLAUSE + r"[^\n]*?[.,;:|()\]> -](" + _STATED + r"[^\n]*)$", "$1"),
    (_CLAUSE + r"(?:[^\n]*?[\p{L}\p{N}]{5}|(?:[^\n]*?" + _YEAR + r")??[0-9]{0,3}(?:[-–/][0-9]{1,2})?[^\p{L}\p{N}\n]{0,8}?)[.!?] +([^\n]*)$", "$1"),
    (_MARK + r"[^\n]*" + _YEAR + r"[^\n]*$", ""),
    (r"^[^\p{L}\p{N}]*all rights reserved(?:[^\p{L}\p{N}]*$|[.,;:|-]+[^\p{L}\p{N}]*)", ""),
    (r"^[^\p{L}\p{N}]*(?:(?:this|the) [a-z]+ (?:is|are) )?(?:licensed|released|distributed|published|available|made available|provided) under (?:the terms of )?(?:(?:the|an?) )?", "licensed under "),
    (r"is(e|ed|es|ing|ation)([^a-z0-9]|$)", "iz$1$2"),
    (r"our([^a-z0-9]|$)", "or$1"),
    (r"gnu general public license", "gnu gpl"),
    (r"(^|[^a-z0-9])(v\.?|version) ?([0-9])", "$1version $3"),
    (r"([0-9])[+]([^\p{L}\p{N}]|$)", "$1 or later$2"),
    (r"[^\p{L}\p{N}]+", " "),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: (licence, text): whole public licence texts and one-line notices; ``notices.py`` has most of both.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *whole_texts(), *notices(),
)


def canonical_line(line: Column) -> Column:
    line = F.lower(line)
    for pattern, by in CANONICAL:
        line = F.regexp_replace(line, pattern, by)
    return F.trim(line)


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines that have any; the canonical text is these joined by a space."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n"), "\n", -1)
    return F.filter(F.transform(lines, canonical_line), lambda x: x != "")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def known_licenses(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license), a row for each canonical text; where two licences share one, the first by name."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    return rows.select("license", digest(F.array_join(canonical_lines(F.col("text")), " ")).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``text_digest``, ``license`` of the whole text (NULL: unknown), ``n_license_lines``, ``line_licenses`` (sorted, comma-joined).

    NULL, empty and copyright-only texts have the digest of the empty string and no licence.  Repeated rows each get
    their row.  Lines are pre-aggregated beside their document before the only shuffle.
    """
    known = F.broadcast(known_licenses(docs.sparkSession)) if known is None else known  # the built-in list is bounded, two short strings a row
    row = fresh_name(docs, "row")
    rows = steady(docs).select(name_of(id_col).alias(id_col), canonical_lines(name_of(text_col)).alias("__lines"), F.monotonically_increasing_id().alias(row)).select(
        id_col, row, digest(F.array_join("__lines", " ")).alias("text_digest"), F.transform("__lines", digest).alias("__lines")
    )
    whole = known.withColumnRenamed("digest", "__whole")
    line = known.withColumnsRenamed({"digest": "__line", "license": "__found"})
    lines = rows.join(whole, F.col("text_digest") == F.col("__whole"), "left").withColumn("__line", F.explode_outer("__lines"))
    found = lines.join(line, "__line", "left").groupBy(id_col, row, "text_digest", "license").agg(
        F.count("__found").alias("n_license_lines"), F.array_join(F.sort_array(F.collect_set("__found")), ",").alias("line_licenses")
    )
    return found.drop(row)
