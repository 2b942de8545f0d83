"""License scan by patience alignment.

A text and a license template are sequences of words.  Words that occur once in
both are anchors; the longest increasing subsequence of them is kept, and the
gaps between kept anchors are aligned in the same way.  The coverage of a
template is the share of its words that align.

A window of the longest admitted occurrence starts at every word, so what is found
doesn't depend on where in the text an occurrence stands, and copies in a row are
found one by one.  The number of template words in a window, with and without
repeats, bounds its coverage: windows below the threshold by that count are
skipped, which drops nothing.
"""

from __future__ import annotations

import bisect
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import raw, word_chunks

#: Notices and grants of public licenses.
TEMPLATES = {
    "GPL": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def align(a: list[int], b: list[int], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: (place in a, place in b), rising."""
    if not a or not b:
        return []
    once_a = {w: i for i, w in enumerate(a) if w and a.count(w) == 1}
    pairs = sorted((once_a[w], j) for j, w in enumerate(b) if w in once_a and b.count(w) == 1)
    if not pairs:
        return []
    tops: list[int] = []
    chain: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(chain[at - 1] if at else -1)
        tops[at:at + 1], chain[at:at + 1] = [j], [n]
    kept: list[tuple[int, int]] = []
    n = chain[-1]
    while n >= 0:
        kept.append(pairs[n])
        n = back[n]
    out: list[tuple[int, int]] = []
    i = j = 0
    for x, y in [*kept[::-1], (len(a), len(b))]:
        out += align(a[i:x], b[j:y], a0 + i, b0 + j)
        if x < len(a):
            out.append((a0 + x, b0 + y))
        i, j = x + 1, y + 1
    return out


class Templates:
    """Templates as word numbers over one vocabulary."""

    def __init__(self, templates: dict[str, str]):
        self.vocab: dict[bytes, int] = {}
        self.words = {
            name: [self.vocab.setdefault(w, len(self.vocab) + 1) for w in text.encode().translate(_TABLE).split()]
            for name, text in templates.items()}
        self.words = {n: w for n, w in self.words.items() if w}
        self.member = {n: np.isin(np.arange(len(self.vocab) + 1), w) for n, w in self.words.items()}
        self.counts = {n: Counter(w) for n, w in self.words.items()}
        self.longest = max(map(len, self.words.values()), default=1)


def best_window(matched: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The most matches whose text places lie within ``span`` words."""
    best: list[tuple[int, int]] = []
    i = 0
    for j in range(len(matched)):
        while matched[j][0] - matched[i][0] >= span:
            i += 1
        if j + 1 - i > len(best):
            best = matched[i:j + 1]
    return best


def scan_words(ids: np.ndarray, t: Templates, threshold: float, first: int, found: dict) -> None:
    """Occurrences in one run of words, by (template, start): (end, coverage)."""
    for name, words in t.words.items():
        n = len(words)
        span = n + n // 4 + 1
        sums = np.concatenate([[0], np.cumsum(t.member[name][ids])])
        ends = np.minimum(np.arange(len(ids)) + span, len(ids))
        starts = np.flatnonzero((sums[ends] - sums[:-1] >= threshold * n) & t.member[name][ids])
        for b in starts.tolist():
            part = ids[b:b + span].tolist()
            if (Counter(part) & t.counts[name]).total() < threshold * n:
                continue
            # one occurrence without its neighbours' words, where those leave too few unique
            matched = max(best_window(align(part, words), span), align(part[:n], words), key=len)
            if len(matched) >= threshold * n:
                key = (name, first + b + matched[0][0])
                value = (first + b + matched[-1][0] + 1, len(matched) / n)
                if value[1] > found.get(key, (0, 0))[1]:
                    found[key] = value


def scan(text: bytes | None, t: Templates, threshold: float) -> list[dict]:
    """Licenses in a text by place; of overlapping ones that with the most words."""
    found: dict[tuple[str, int], tuple[int, float]] = {}
    keep, at = 2 * t.longest, 0
    for words in word_chunks(text.translate(_TABLE), keep) if text else ():
        ids = np.fromiter(map(t.vocab.get, words, repeat(0)), np.int64, len(words))
        if ids.any():
            scan_words(ids, t, threshold, at, found)
        at = max(at, at + len(words) - keep)
    rows = sorted(((round(c * len(t.words[n])), c, n, b, e) for (n, b), (e, c) in found.items()),
                  key=lambda r: (-r[0], -r[1], r[2], r[3]))
    out: list[dict] = []
    for _, c, n, b, e in rows:
        if all(e <= x["start"] or b >= x["end"] for x in out):
            out.append({"license": n, "start": b, "end": e, "coverage": c})
    return sorted(out, key=lambda x: x["start"])


MATCHES = "array<struct<license:string,start:long,end:long,coverage:double>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("coverage", pa.float64())]))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``licenses`` of each row: template, words covered (start,
    end) and coverage, by place.  Words are runs of letters, digits and bytes
    beyond ASCII, A-Z lowered.  Null and blank texts have none; repeated rows keep
    one row each; a null id stays null; other columns aren't read; an empty table
    gives no rows.  Without templates nothing is found."""
    ready = Templates(TEMPLATES if templates is None else templates)

    @F.arrow_udf(MATCHES)
    def licenses(texts: pa.Array) -> pa.Array:
        return pa.array([scan(t.as_py(), ready, threshold) for t in texts], _ARROW)

    return docs.select(F.col(f"`{id_col}`"), licenses(raw(text_col)).alias("licenses"))
