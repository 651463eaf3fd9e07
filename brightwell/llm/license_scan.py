"""License scan by conditional compression.

Candidate blocks are runs of lines that speak of licensing. A block is searched together with as
many words on either side as a match may have, since a wrapped wording has lines without a hint;
blocks that meet so are searched as one. Every template is held against these words by the exact
wording: the differences between the words of the template and those of the
block where it matches may not exceed a share of the template. Where several match the same words,
these are compressed on their own and with each template as a raw-content dictionary, and the
templates are ranked by how much they save, as a share of their own compressed size. So the text
around a wording decides nothing, and no template goes unless the block lacks too many of its words.

Defined cases: a null or empty text has no blocks; a block may hold several licenses if their
words lie apart; templates that save equally rank by name; rows that repeat are each
scanned; a match's lines are those that its words lie in. Documents are read once and nothing is shuffled; other columns are kept in `row`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightwell.llm.shared import map_rows, pieces

#: The wording of public licenses and of their usual notices, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0-only": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 2-Clause License.",
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 3-Clause License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
}
_HINT = re.compile(r"licen[cs]|copyright|permission|redistribut|warrant|public\W+domain|creative\W+commons|free\W+software|mozilla\W+public", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
#: Lines without a hint that may lie within a block, and lines of a block at most before it is cut into overlapping windows.
_GAP, _WINDOW = 2, 60


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each run of lines with hints; long runs as overlapping windows."""
    out, start, last, line, seen = [], None, -1, 0, 0
    for hint in _HINT.finditer(text):  # one of two words may go over a line's end
        line += text.count("\n", seen, hint.start())
        seen = hint.start()
        if start is not None and line - last > _GAP + 1:
            out.append((start, last + 1))
            start = None
        start, last = line if start is None else start, line + text.count("\n", seen, hint.end())
    if start is not None:
        out.append((start, last + 1))
    cut = []
    for a, b in out:
        while b - a > _WINDOW:
            cut.append((a, a + _WINDOW))
            a += _WINDOW // 2
        cut.append((a, b))
    return cut


def regions(text: str, more: int) -> list[tuple[list[str], np.ndarray]]:
    """(words, their lines) of each block with so many words more on either side; what overlaps is one."""
    found = blocks(text)
    if not found:
        return []
    per_line = [words(line) for line in text.split("\n")]
    begins = np.cumsum([0, *map(len, per_line)])
    flat, places = [w for line in per_line for w in line], np.repeat(np.arange(len(per_line)), np.diff(begins))
    out: list[list[int]] = []
    for first, after in found:
        a, b = max(0, int(begins[first]) - more), min(len(flat), int(begins[after]) + more)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(flat[a:b], places[a:b]) for a, b in out]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], level: int = 9, most_difference: float = 0.1):
        self.level, self.most_difference = level, most_difference
        self.alone = self._compressor(None)
        held = [(name, words(t)) for name, ts in sorted(templates.items()) for t in ts]
        self.codes = {w: i for i, w in enumerate(sorted({w for _, t in held for w in t}))}
        self.templates = [(name, self.coded(t), Counter(t), int(most_difference * len(t)), *self._held(" ".join(t).encode())) for name, t in held]

        self.longest = max((len(t) + limit for _, t, _, limit, _, _ in self.templates), default=0)  # words of a match at most

    def _compressor(self, held: bytes | None):
        more = {} if held is None else {"dict_data": zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)}
        return zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False, **more)

    def _held(self, data: bytes):
        """The compressor with a template at hand, and the template's compressed size without."""
        return self._compressor(data), len(self.alone.compress(data))

    def coded(self, block: list[str]) -> np.ndarray:
        """Numbers of the words; -1 for those in no template."""
        return np.fromiter((self.codes.get(w, -1) for w in block), np.int32, len(block))

    def scan(self, text: str) -> list[dict]:
        found: list[dict] = []
        for block, lines in regions(text, self.longest):
            held: list[tuple[int, int]] = []  # what matches cover in these words
            for gain, name, differ, a, b in self._confirmed(block):
                if all(b <= x or a >= y for x, y in held):
                    held.append((a, b))
                    found.append({"license": name, "first_line": int(lines[a]), "after_line": int(lines[b - 1]) + 1, "gain": gain, "differences": differ})
        return found

    def _confirmed(self, block: list[str]) -> list[tuple[float, str, int, int, int]]:
        """(gain, license, differing words, begin, end): exact wordings first, of these the longer, then by gain."""
        out, there, coded = [], Counter(block), self.coded(block)
        for name, template, needed, limit, compressor, own in self.templates:
            lacking = 0
            for w, n in needed.items():  # each word that the block lacks is a difference wherever the template matches
                lacking += max(0, n - there[w])
                if lacking > limit:
                    break
            else:
                for differ, a, b in occurrences(template, coded, limit):
                    data = " ".join(block[a:b]).encode()
                    gain = (len(self.alone.compress(data)) - len(compressor.compress(data))) / own
                    out.append((differ > 0, -len(template), -gain, name, a, (differ, a, b)))
        return [(-gain, name, *match) for _, _, gain, name, _, match in sorted(out)]


def _distances(template: np.ndarray, block: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Least number of words to leave out of either, for the template and the words up to each place of block."""
    places = np.arange(len(block) + 1)
    now = first
    for w in template:
        new = now + 1
        new[1:] = np.where(block == w, np.minimum(new[1:], now[:-1]), new[1:])
        now = places + np.minimum.accumulate(new - places)
    return now


def occurrences(template: np.ndarray, block: np.ndarray, limit: int) -> list[tuple[int, int, int]]:
    """(differing words, begin, end) of the places, apart from each other, where the template is within limit; the closest first."""
    at_end = _distances(template, block, np.zeros(len(block) + 1, np.int64))
    ends = np.flatnonzero(at_end <= limit)
    out: list[tuple[int, int, int]] = []
    taken = np.zeros(len(block), bool)
    for end in ends[np.argsort(at_end[ends], kind="stable")].tolist():
        if end and not taken[end - 1]:
            differ = int(at_end[end])
            low = max(0, end - len(template) - limit)
            back = _distances(template[::-1], block[low:end][::-1], np.arange(end - low + 1))
            begin = end - int(np.flatnonzero(back == differ)[0])
            if begin < end and not taken[begin:end].any():
                taken[begin:end] = True
                out.append((differ, begin, end))
    return out


_MATCH = T.StructType().add("license", T.StringType()).add("first_line", T.IntegerType()).add("after_line", T.IntegerType()).add("gain", T.DoubleType()).add("differences", T.IntegerType())
FOUND = T.StructType().add("n_blocks", T.LongType()).add("matches", T.ArrayType(_MATCH))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int32()), ("after_line", pa.int32()), ("gain", pa.float64()), ("differences", pa.int32())]))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, text_col: str = "text") -> DataFrame:
    """(row, found) for each row: the number of candidate blocks and the confirmed licenses with their places."""
    held = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held)
        for whole in batches:
            for batch in pieces(whole, 1):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                found = pa.StructArray.from_arrays([pa.array([len(blocks(t)) for t in texts], pa.int64()), pa.array([scanner.scan(t) for t in texts], _ARROW)], names=FOUND.names)
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "found"])

    return map_rows(docs, [F.col(f"`{text_col}`").cast("string").alias("words")], run, FOUND)
