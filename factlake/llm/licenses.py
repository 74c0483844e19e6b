"""License scans by conditional compression.

A candidate block is what stands around a cue word, as far as the longest template can reach, whatever lines and paragraphs it
is divided into; blocks that meet are one.  A template, a whole licence or a notice or an identifier, is confirmed wherever
the block holds its wording: the words of the template, aligned with the block's around each place of a telling word, differ in no more than
``SLACK`` of them, and none of the words that tell it from other licences is missing or changed.  The differences are
reported, so a winner is never taken on its compression alone.  What was confirmed is compressed alone and with the
template as a raw dictionary for zstandard; of findings that overlap, the one whose template saves most bytes, less those of
the words that differ, stays.

Defined cases: a null or empty text has no blocks; lines of any length are compared whole, and what stands around a
notice has no influence; equal savings go to the template that is first by name; several licences in one block are all
found; repeated rows are scanned one by one; an empty table gives an empty table.  Other columns don't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so"
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_TAIL = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of "
    "the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses"
)
#: Identifiers of licences in lines of the SPDX kind.
IDENTIFIERS = (
    "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT "
    "MPL-2.0 Unlicense Zlib"
).split()
#: The wording of licences as their owners publish it and of notices, and the words of each that no other may
#: have in their place.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        ("apache", "2.0", "compliance", "governing"),
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", ("bsd", "2-clause")),
    "BSD-2-Clause-text": (_BSD_HEAD + _BSD_TAIL, ("redistribution", "redistributions", "exemplary", "substitute")),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", ("bsd", "3-clause")),
    "BSD-3-Clause-text": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, ("redistribution", "endorse", "exemplary", "substitute")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    "GPL-2.0-notice": (_GNU.format("General Public License", 2), ("gnu", "general", "redistribute", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    "GPL-3.0-notice": (_GNU.format("General Public License", 3), ("gnu", "general", "redistribute", "3")),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("permission", "fee", "disclaims", "tortious"),
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "public", "3")),
    "LGPL-3.0-notice": (_GNU.format("Lesser General Public License", 3), ("gnu", "lesser", "redistribute", "3")),
    "MIT": ("Released under the MIT License.", ("mit",)),
    "MIT-grant": (_MIT_GRANT, ("permission", "hereby", "granted", "sublicense")),
    "MIT-text": (
        _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. " + _AS_IS,
        ("hereby", "sublicense", "substantial", "noninfringement"),
    ),
    "MPL-2.0": ("This work is subject to the terms of the Mozilla Public License, version 2.0.", ("mozilla", "2.0")),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0",
        ("mozilla", "form", "obtain"),
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
        ("unencumbered", "domain", "compiled"),
    ),
    **{f"SPDX-{name}": (f"SPDX-License-Identifier: {name}", ("spdx-license-identifier", name.lower())) for name in IDENTIFIERS},
}

_CUE = re.compile(r"licen[sc]|copyright|hereby\s+granted|spdx|cc\s+by|warrant|unencumbered|redistribut", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: A winner may lack or change this share of the template's words; none of its telling ones.
SLACK = 0.2
#: So many words on either side of a cue word belong to its block: a template's wording with all that may be added to it.
REACH = max(int((1 + SLACK) * len(_WORD.findall(wording))) for wording, _ in TEMPLATES.values())


class License(NamedTuple):
    start: int
    end: int
    name: str
    reduction: float
    missing: str
    added: str


def blocks(text: str, reach: int = REACH) -> list[tuple[int, int]]:
    """The words around cue words, as spans of characters."""
    cues = list(_CUE.finditer(text))
    if not cues:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[int, int]] = []  # as numbers of words
    for cue in cues:
        low = max(0, bisect_right(at, cue.start(), key=lambda w: w[0]) - 1 - reach)
        high = min(len(at), bisect_left(at, cue.end(), key=lambda w: w[0]) + reach)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        elif at:
            out.append((low, high))
    return [(at[low][0], at[high - 1][1]) for low, high in out]


def extend(words: list[str], wanted: list[str], telling: set[str]) -> tuple[int, int, list[str], list[str]] | None:
    """The alignment of all wanted words with the first so many words that has the fewest differences.

    Returns (differences, words used, missing, added), or None if a telling word would be missing.
    """
    never = len(words) + len(wanted) + 1
    costs = [list(range(len(words) + 1))]
    for w in wanted:
        above, drop = costs[-1], never if w in telling else 1
        row = [above[0] + drop]
        for j, x in enumerate(words):
            row.append(min(above[j + 1] + drop, row[j] + 1, above[j] if x == w else never * (len(wanted) + 1)))
        costs.append(row)
    least = min(costs[-1])
    if least >= never:
        return None
    i, j = len(wanted), costs[-1].index(least)
    used, missing, added = j, [], []
    while i or j:
        if i and j and words[j - 1] == wanted[i - 1] and costs[i][j] == costs[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and costs[i][j] == costs[i - 1][j] + (never if wanted[i - 1] in telling else 1):
            i -= 1
            missing.append(wanted[i])
        else:
            j -= 1
            added.append(words[j])
    return least, used, missing[::-1], added[::-1]


class Scanner:
    """Templates with their compressors."""

    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES) -> None:
        import zstandard

        plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**plain)
        self.templates = []
        for name, (wording, telling) in sorted(templates.items()):
            raw = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words = [w.lower() for w in _WORD.findall(wording)]
            self.templates.append((name, zstandard.ZstdCompressor(dict_data=raw, **plain), words, set(telling)))
        self.reach = max((int((1 + SLACK) * len(t[2])) for t in self.templates), default=0)

    def saved(self, piece: str, template: int) -> tuple[int, float]:
        """The bytes, and their share, by which the template makes the piece smaller."""
        data = piece.encode()
        alone = len(self.plain.compress(data))
        with_it = len(self.templates[template][1].compress(data))
        return alone - with_it, 1 - with_it / alone

    def confirm(self, words: list[str], template: int, places: dict[str, list[int]]) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """Where in the words the template's wording stands, and which of its words are missing or added.

        ``places``: the positions of each word.  A telling word is never missing, so each place of one is tried.
        """
        _, _, wanted, telling = self.templates[template]
        if not all(w in places for w in telling):
            return
        key = min(sorted(telling), key=lambda w: len(places[w]))
        k, most = wanted.index(key), int(SLACK * len(wanted))
        for at in places[key]:
            before, after = words[max(0, at - k - most) : at][::-1], words[at + 1 : at + len(wanted) - k + most]
            if (Counter(wanted) - Counter([key, *before, *after])).total() > most:
                continue
            left, right = extend(before, wanted[:k][::-1], telling), extend(after, wanted[k + 1 :], telling)
            if left and right and left[0] + right[0] <= most:
                yield at - left[1], at + 1 + right[1], left[2][::-1] + right[2], left[3][::-1] + right[3]

    def scan(self, text: str) -> list[License]:
        out: list[License] = []
        for start, end in blocks(text, self.reach):
            block = text[start:end]
            at = [(m.start(), m.end()) for m in _WORD.finditer(block)]
            words = [block[a:b].lower() for a, b in at]
            places: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                places.setdefault(w, []).append(i)
            found = []
            for template in range(len(self.templates)):
                for first, last, missing, added in self.confirm(words, template, places):
                    less, share = self.saved(block[at[first][0] : at[last - 1][1]], template)
                    differing = sum(len(w.encode()) + 1 for w in (*missing, *added))
                    found.append((differing - less, template, first, last, share, missing, added))
            taken = bytearray(len(at))
            for _, template, first, last, share, missing, added in sorted(found):
                if not any(taken[first:last]):
                    taken[first:last] = b"\1" * (last - first)
                    out.append(License(start + at[first][0], start + at[last - 1][1], self.templates[template][0], share, " ".join(missing), " ".join(added)))
        return sorted(out)


_scanner: list[Scanner] = []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_blocks, and licenses, an array of (start, end, name, reduction, missing, added)."""
    df = columns(docs, doc_id=id_col, text=text_col)
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("reduction", pa.float64()), ("missing", pa.string()), ("added", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(blocks(t)) for t in texts], pa.int64()),
                     pa.array([[x._asdict() for x in _scanner[0].scan(t)] for t in texts], pa.list_(item))],
                    names=["doc_id", "n_blocks", "licenses"],
                )

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(
        run, f"doc_id {kind}, n_blocks bigint, licenses array<struct<start:int,end:int,name:string,reduction:double,missing:string,added:string>>"
    )
