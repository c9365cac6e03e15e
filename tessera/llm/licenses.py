r"""Operator 8: license scans by conditional compression.

Lines with a license's cue words are grouped to candidate blocks. A block is compressed alone and with each template as a raw
zstandard dictionary; the relative reduction of its size ranks the templates, and the best ones are confirmed by the exact
differences in wording: words that the block lacks, adds or replaces, apart from years and holders.

Where a block isn't confirmed as it stands, windows of the templates' length are sought in and around it, so that neither the prose
of a line nor line ends hide a notice.

The templates are the whole texts of short licenses, and the notices that long ones ask for and hold themselves, so that a file of
either kind is found. Words around a notice don't count against it, missing ones do. Texts without any cue never leave the JVM: every
template has some, so only a notice from which all of them are gone is passed over. Blocks are found in whole texts, whatever their length.

Defined cases: null and empty texts give no rows; a block is reported once, with its best template, ties going to the template
that is listed first; repeated rows are scanned and reported each; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

CUES = ("licens", "licenc", "copyright", "permission", "warrant", "redistribut", "spdx", "unencumbered", "reserved", "waived")
#: A block ends where so many lines hold no cue; long lines are cut into sentences first.
QUIET_LINES, LONG_LINE = 2, 400
LEAST_REDUCTION, BEST, MAX_DIFFERENCE = 0.30, 3, 0.15
#: Characters around a block in which notices that begin before it or go on after it are sought: more than the longest template has.
AROUND = 2000

# fixed values: names of licenses and the wording of their notices
_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software "
    "Foundation, either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT "
    "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} General Public License for more details."
)


def _gnu(what: str, kind: str, version: str) -> str:
    return _GNU.format(what, kind, version).replace("GNU  ", "GNU ")


TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("This program", "", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", _gnu("This program", "", "3")),
    ("LGPL-2.1", _gnu("This library", "Lesser", "2.1")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("This library", "Lesser", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("This program", "Affero", "3")),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS_BSD),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. " + _AS_IS_BSD,
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
    *((x, f"SPDX-License-Identifier: {x}") for x in "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-2.0 Unlicense CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later".split()),
)
_MARKS = ".,;:()\"'`*#/<>!%{}[]-\u2018\u2019\u201c\u201d\u2022"
_IGNORED = re.compile(r"^(?:c|©|copyright|(?:19|20)[0-9]{2}(?:-(?:19|20)?[0-9]{2})?)$")


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of the candidate blocks of a text, in characters."""
    pieces: list[tuple[int, int]] = []
    at = 0
    for line in text.split("\n"):
        if len(line) <= LONG_LINE:
            pieces.append((at, at + len(line)))
        else:
            start = at
            for m in re.finditer(r"[.!?]+\s+", line):
                if at + m.end() > start:
                    pieces.append((start, at + m.start() + 1))
                    start = at + m.end()
            pieces.append((start, at + len(line)))
        at += len(line) + 1
    out: list[tuple[int, int]] = []
    quiet = QUIET_LINES + 1
    for a, b in pieces:
        low = text[a:b].lower()
        if any(c in low for c in CUES):
            if out and quiet <= QUIET_LINES and any(c in text[out[-1][0] : out[-1][1]].lower() for c in ("permission", "redistribut")):
                out[-1] = (out[-1][0], b)  # a longer notice goes on
            else:
                out.append((a, b))
            quiet = 0
        else:
            quiet += 1
    return out


def wording(text: str) -> list[str]:
    """Words in small letters without the marks around them, those of comments and lists too; years and the like go."""
    return [w for w in (x.strip(_MARKS).lower() for x in text.split()) if w and not _IGNORED.match(w)]


@lru_cache(1)
def _compressors() -> tuple:
    plain = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = []
    for name, text in TEMPLATES:
        raw = zstandard.ZstdCompressionDict(" ".join(text.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, wording(text), zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return plain, made


def differences(have: list[str], want: list[str]) -> list[str]:
    """Changes from a template's words to a block's: ``-word``, ``+word``."""
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_opcodes():
        if op != "equal":
            out += [f"-{w}" for w in want[i:j]] + [f"+{w}" for w in have[k:m]]
    return out


def judge(block: str) -> tuple[str, float, list[str], bool] | None:
    """(license, reduction, differences, confirmed) of the best template, or None if none shortens the block."""
    plain, made = _compressors()
    data = " ".join(block.split()).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    ranked = sorted(((1 - len(z.compress(data)) / alone, -i) for i, (_, _, z) in enumerate(made)), reverse=True)
    words, best = wording(block), None
    for reduction, i in ranked[:BEST]:
        if reduction < LEAST_REDUCTION:
            break
        name, want, _ = made[-i]
        diff = differences(words, want)
        good = len(diff) <= MAX_DIFFERENCE * len(want)
        if best is None or (good, -len(diff)) > (best[3], -len(best[2])):
            best = (name, reduction, diff, good)
    return best


@lru_cache(1)
def _grams() -> tuple[list[list[str]], dict[tuple, list[tuple[int, int]]]]:
    """Words of the templates, and where three words in a row stand in them: (template, place)."""
    wants, at = [wording(t) for _, t in TEMPLATES], {}
    for t, want in enumerate(wants):
        for k in range(len(want) - 2):
            at.setdefault(tuple(want[k : k + 3]), []).append((t, k))
    return wants, at


def windows(text: str, near: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, stop, words) around candidate blocks whose wording is that of a template, whatever lines and prose they stand in."""
    regions: list[list[int]] = []
    for a, b in near:
        a, b = max(0, a - AROUND), min(len(text), b + AROUND)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    wants, at = _grams()
    found = []
    for a, b in regions:
        held = [(w[0], m.start(), m.end()) for m in re.finditer(r"\S+", text[a:b]) if (w := wording(m.group()))]
        words = [w for w, *_ in held]
        starts: dict[int, set[int]] = {}
        for i in range(len(words) - 2):
            for t, k in at.get(tuple(words[i : i + 3]), ()):
                starts.setdefault(t, set()).add(i - k)
        for t, places in starts.items():
            want, slack, last = wants[t], int(MAX_DIFFERENCE * len(wants[t])), None
            for i in sorted(places):
                if last is not None and i - last <= slack:
                    continue
                last = i
                low = max(0, i - slack)
                have = words[low : max(0, i + 2 * slack) + len(want)]
                equal = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
                if not equal:
                    continue
                x, y = low + equal[0].b, low + equal[-1].b + equal[-1].size
                n = len(differences(words[x:y], want))
                if n <= MAX_DIFFERENCE * len(want):
                    found.append((len(want) - n, -n, -t, a + held[x][1], a + held[y - 1][2]))
    out: list[tuple[int, int, int]] = []
    for n, _, _, x, y in sorted(found, reverse=True):  # the most equal words first
        if all(y <= u or v <= x for u, v, _ in out):
            out.append((x, y, n))
    return sorted(out)


def scan(text: str) -> list[tuple[int, int, tuple[str, float, list[str], bool]]]:
    """(start, stop, judgement) of a text's blocks, and of the windows in and across blocks that aren't confirmed as they are."""
    near = blocks(text)
    judged = [(a, b, judge(text[a:b])) for a, b in near]
    sure = [(a, b) for a, b, found in judged if found and found[3]]
    more = []
    for x, y, n in windows(text, near):
        inside = [(a, b) for a, b in sure if a < y and x < b]
        # a notice that goes on beyond confirmed blocks takes their place
        if all(x <= a and b <= y and n > len(wording(text[a:b])) for a, b in inside):
            found = judge(text[x:y])
            if found and found[3]:
                more.append((x, y, found))
    # a block is replaced by a window that holds it whole, or that finds the same license in it
    kept = [(a, b, found) for a, b, found in judged if found and not any((x <= a and b <= y) or (a < y and x < b and w[0] == found[0]) for x, y, w in more)]
    return sorted(kept + more, key=lambda r: r[:2])


SCHEMA = "doc_id long, start long, stop long, license string, reduction double, n_differences long, differences string, confirmed boolean"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each block that a template shortens by LEAST_REDUCTION or more: place, license, reduction of size, differences in
    wording, and whether these confirm it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("n_differences", pa.int64()), ("differences", pa.string()), ("confirmed", pa.bool_())])
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                out = []
                for i, t in zip(*(c.to_pylist() for c in whole.slice(low, 256).columns), strict=True):
                    for a, b, (name, reduction, diff, good) in scan(t):
                        out.append((i, a, b, name, round(reduction, 6), len(diff), " ".join(diff), good))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    lowered = F.lower(F.col(text))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(lowered, F.lit(c))
    return docs.where(cue).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
