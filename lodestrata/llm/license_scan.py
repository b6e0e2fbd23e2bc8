"""Licence scan: normalised text against templates by the Dice coefficient of word bigrams, in DataFrame functions only.

A template is held against every run of as many words of a text that starts with one of its bigrams, wherever lines
break. For sets of a and b bigrams that share m the coefficient 2m / (a + b) reaches t only if m is at least bt / (2 - t);
so a text that holds fewer of a template's bigrams is no candidate for it, and neither is one that holds none of the
first b - m + 1 in any fixed order. No text leaves its row: nothing is shuffled.
"""

from __future__ import annotations

import math
import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, let

#: Notices, opening passages and whole texts of well-known licences.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."
    ),
    "Apache-2.0-text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" "
        "shall mean the copyright owner or entity authorized by the copyright owner that is granting the License."
    ),
    "BSD-2-Clause": f"{_REDISTRIBUTION} {_BSD_TWO} {_BSD_AS_IS}",
    "BSD-3-Clause": f"{_REDISTRIBUTION} {_BSD_TWO} {_BSD_NAME} {_BSD_AS_IS}",
    "BSD-header": _REDISTRIBUTION,
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
    ),
    "GPL-3.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for "
        "software and other kinds of works."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-header": _GRANT,
    "MIT-text": f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or "
        "altered from any source distribution."
    ),
}
#: Least Dice coefficient of a match.
DICE = 0.8
#: Fixed value: what separates words, after A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of_template(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN_WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def bigrams_of_template(text: str) -> list[tuple[str, str]]:
    words = words_of_template(text)
    return sorted(set(zip(words, words[1:], strict=False)))


def needed(b: int, dice: float = DICE) -> int:
    """Bigrams of b that a run must share, at least."""
    return max(1, math.ceil(b * dice / (2 - dice) - 1e-9))


def hash_of(a: str, b: str) -> int:
    """What Spark's xxhash64(a, b) gives, as a constant of the plan: each word's XXH64 seeds the next one's."""
    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def matches(text: Column, templates: dict[str, str], dice: float = DICE) -> Column:
    """array<struct<license, word, dice>>: for each template that matches its best run, by the word it starts at (from 0), leftmost among equals."""
    parts = {n: b for n, t in templates.items() if (b := bigrams_of_template(t))}
    length = {n: len(words_of_template(templates[n])) - 1 for n in parts}
    common = {}
    for b in parts.values():
        for x in b:
            common[x] = common.get(x, 0) + 1
    # the bigrams that fewest templates hold, longest first, come first in the fixed order
    first = {n: sorted(b, key=lambda x: (common[x], -len(x[0]) - len(x[1]), x))[: len(b) - needed(len(b), dice) + 1] for n, b in parts.items()}
    known = {n: F.lit([hash_of(*x) for x in b]) for n, b in parts.items()}
    lead = {n: F.lit([hash_of(*x) for x in b]) for n, b in first.items()}
    none = F.lit(None).cast("struct<license:string,word:int,dice:double>")

    def best(b: Column, n: str) -> Column:
        """The best run of the template's length among those that start with one of its bigrams."""
        starts = F.filter(F.transform(b, lambda x, i: F.when(F.array_contains(known[n], x), i)), lambda i: i.isNotNull())

        def run(i: Column) -> Column:
            value = lambda s: 2.0 * F.size(F.array_intersect(s, known[n])) / (F.size(F.array_distinct(s)) + len(parts[n]))
            return let(F.slice(b, i + 1, F.lit(length[n])), lambda s: F.struct((-value(s)).alias("d"), i.alias("word")))

        top = let(F.array_min(F.transform(starts, run)), lambda r: F.when(-r["d"] >= dice, F.struct(F.lit(n).alias("license"), r["word"].alias("word"), (-r["d"]).alias("dice"))))
        return F.when(F.size(F.array_intersect(b, known[n])) >= needed(len(parts[n]), dice), top).otherwise(none)

    leads = [hash_of(*x) for x in sorted({x for b in first.values() for x in b})]

    def of(b: Column) -> Column:
        # one look-up for each bigram of a text tells most texts from all templates
        each = lambda h: F.array_compact(F.array(*(F.when(F.arrays_overlap(h, lead[n]), best(b, n)).otherwise(none) for n in sorted(parts))))
        return let(F.filter(b, lambda x: x.isin(leads)), lambda h: F.when(F.size(h) > 0, each(h)))

    def bigrams(words: Column) -> Column:
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))

    words = let(F.split(ascii_lower(text), BETWEEN_WORDS), lambda ws: F.filter(ws, lambda w: w != ""))
    return let(let(words, bigrams), of)


def scan_licenses(df: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """(id, n_matches, licenses, best_license, best_dice, matches), one row per row of df.

    n_matches: templates that some run of the text matches; licenses: their names, sorted; best: highest coefficient,
    ties by name. Null and empty texts match nothing: 0, an empty list, and null for the best. Texts of fewer than two
    words match nothing. Rows, repeated ones too, keep their number; no template is skipped unless its bounds prove
    that it cannot match.
    """
    found = df.select(F.col(id), F.coalesce(matches(F.col(text), templates or TEMPLATES, dice), F.array().cast("array<struct<license:string,word:int,dice:double>>")).alias("matches"))
    best = F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    return found.select(
        F.col(id),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"),
        F.get(best, F.lit(0))["license"].alias("best_license"),
        F.round(-F.get(best, F.lit(0))["d"], 6).alias("best_dice"),
        "matches",
    )
