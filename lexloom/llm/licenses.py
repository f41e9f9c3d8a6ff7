"""Operator 10: licence scans by canonical digest lookup.

A text and its lines are brought to a canonical form - lower case, no copyright lines, equivalent
spellings, no punctuation - and the digest of the whole form is joined to those of known licences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import _SEQ, U64, WORD, mix, powers, slices, tokenise

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: (licence, text). Full texts and the notices by which works name their licence.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", _ISC + "\n\n" + _ISC_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]

#: Equivalent spellings, word by word.
SPELLINGS: dict[str, str] = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations",
    "favour": "favor", "honour": "honor", "authorised": "authorized", "recognised": "recognized", "merchantibility": "merchantability", "http": "https", "version": "v", "owners": "holders",
}
_COPYRIGHT, _SIGN, _RESERVED = "copyright", "©", ["all", "rights", "reserved"]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def word_hash(word: str) -> np.uint64:
    return tokenise(pa.array([word]), WORD).hashes[0]


_FROM = np.array([word_hash(w) for w in SPELLINGS], U64)
_TO = np.array([word_hash(w) for w in SPELLINGS.values()], U64)[np.argsort(_FROM)]
_FROM.sort()
_WORDS = {w: word_hash(w) for w in (_COPYRIGHT, _SIGN, "c", *_RESERVED)}


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, is line, number of words, digest) of each lower-cased text and each of its lines that has a word and is no copyright line.

    The digest is a hash of the sequence of canonical words; that of a text leaves out its copyright lines.
    """
    tok = tokenise(texts, WORD)
    h = tok.hashes
    at = np.minimum(np.searchsorted(_FROM, h), len(_FROM) - 1)
    same = _FROM[at] == h
    h = np.where(same, _TO[at], h)
    breaks = np.unique(np.concatenate([tok.row_at, np.flatnonzero(_NEWLINE[tok.data])]))
    first = np.unique(np.searchsorted(tok.starts, breaks))
    first = first[first < len(h)]
    edges = np.append(first, len(h))
    n = np.diff(edges)
    row = tok.rows()[first]
    word = lambda k: np.where(n > k, h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else 0, U64(0))
    digit = np.zeros(len(first), bool)
    digit[n > 1] = (tok.data[tok.starts[first[n > 1] + 1]] - 48) < 10
    notice = (word(0) == _WORDS[_SIGN]) | ((word(0) == _WORDS[_COPYRIGHT]) & (digit | (word(1) == _WORDS["c"]) | (word(1) == _WORDS[_SIGN])))
    notice |= (n == 3) & np.logical_and.reduce([word(k) == _WORDS[w] for k, w in enumerate(_RESERVED)])
    kept = np.repeat(~notice, n)

    def sequence(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
        up, down = powers(int(_SEQ), len(values) + 1)
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[cut[1:]] - sums[cut[:-1]]) * down[cut[:-1]])

    lines = sequence(h, edges)[~notice]
    before = np.concatenate([[0], np.cumsum(kept)])
    text_edges = before[tok.first]
    whole = sequence(h[kept], text_edges)
    words = np.diff(text_edges)
    some = np.flatnonzero(words)
    return np.concatenate([some, row[~notice]]), np.repeat([False, True], [len(some), len(lines)]), np.concatenate([words[some], n[~notice]]), np.concatenate([whole[some], lines])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            row, line, words, digest = digests(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(line), pa.array(words, pa.int64()), pa.array(digest.view(np.int64))], names=["doc_id", "line", "words", "digest"])


def license_scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, license, n): whole texts (``text``) and whole lines (``line``) that are a known licence, n times.

    A text is looked up as a whole and by its lines. Null texts and units without a word never match; null
    ids are kept; rows that repeat an id count together. The known licences are a list of the driver and
    are broadcast. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    _, line, words, digest = digests(pa.array([t.lower() for _, t in known], pa.string()))
    table = sorted({(name, int(w), int(d)) for (name, _), w, d in zip(known, words[~line], digest[~line].view(np.int64))})
    names = spark.createDataFrame(table, "license string, words long, digest long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("text IS NOT NULL")
    units = rows.mapInArrow(_units, "doc_id long, line boolean, words long, digest long")
    found = units.join(F.broadcast(names), ["words", "digest"])
    return found.groupBy("doc_id", F.when(F.col("line"), "line").otherwise("text").alias("unit"), "license").agg(F.count("*").alias("n"))


_LIT = lambda s: "'" + s.replace("'", "''") + "'"
SQL = (
    "WITH d AS (SELECT 0 AS known, doc_id AS id, text, NULL AS license FROM documents WHERE text IS NOT NULL UNION ALL SELECT 1, row_number() OVER (), t, l FROM (VALUES "
    + ", ".join(f"({_LIT(a)}, {_LIT(b)})" for a, b in KNOWN)
    + ") AS k(l, t)), s AS (SELECT known, id, license, string_split(lower(text), chr(10)) AS ls FROM d), "
    + "l AS (SELECT known, id, license, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM s), "
    + r"w AS (SELECT known, id, license, k, list_transform(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: coalesce(map {"
    + ", ".join(f"{_LIT(a)}: {_LIT(b)}" for a, b in SPELLINGS.items())
    + "}[x], x)) AS w FROM l), "
    + "c AS (SELECT * FROM w WHERE len(w) > 0 AND NOT (w[1] = '©' OR (w[1] = 'copyright' AND len(w) > 1 AND (w[2] IN ('c', '©') OR regexp_matches(w[2], '^[0-9]'))) OR w = ['all', 'rights', 'reserved'])), "
    + "u AS (SELECT known, id, license, 'line' AS unit, array_to_string(w, ' ') AS c FROM c UNION ALL SELECT known, id, license, 'text', string_agg(array_to_string(w, ' '), ' ' ORDER BY k) FROM c GROUP BY known, id, license), "
    + "n AS (SELECT DISTINCT license, c FROM u WHERE known = 1 AND unit = 'text') "
    + "SELECT u.id AS doc_id, u.unit, n.license, CAST(count(*) AS BIGINT) AS n FROM u JOIN n ON u.c = n.c WHERE u.known = 0 GROUP BY ALL"
)
