"""License scan by Dice similarity of word bigrams, in DataFrame and SQL functions only.

Lines of a text, its blank-line paragraphs and the whole text are compared with short licenses,
whole and by paragraph, and with the notices and titles of longer ones. Sizes prune first: two sets of a and b bigrams can reach a Dice coefficient of t only if
a >= b * t / (2 - t) and the reverse. Among the templates that remain for a unit, one whose rarer
bigrams the unit lacks entirely cannot reach it either, which spares most units any comparison.
Windows of the whole text, as long as a template and placed around hits of its rarer bigrams, find
notices that stand inside a line or paragraph.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICE = 0.8

#: Paragraphs of the licenses that are short enough to stand whole in a text.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
#: Notices that longer licenses ask for; their own texts are known by title and by these.
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
)
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details."
_CC = "This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."

#: The notices that licenses ask for or that are commonly used to name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    # whole paragraphs and whole texts, beside the mentions above
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", _MIT[0]),
    ("MIT", _MIT[1]),
    ("MIT", _MIT[2]),
    ("MIT", " ".join(_MIT)),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _ISC[0]),
    ("ISC", _ISC[1]),
    ("ISC", " ".join(_ISC)),
    ("BSD-2-Clause", _BSD[0]),
    ("BSD-2-Clause", " ".join((*_BSD[:3], _BSD[4]))),
    ("BSD-3-Clause", _BSD[3]),
    ("BSD-3-Clause", " ".join(_BSD)),
    ("BSD-2-Clause", _BSD[4]),
    ("BSD-3-Clause", _BSD[4]),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE[0]),
    ("Apache-2.0", " ".join(_APACHE[:2])),
    ("Apache-2.0", _APACHE[2]),
    ("Apache-2.0", " ".join(_APACHE)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("program", "General", 2)),
    ("GPL-2.0", " ".join((_GNU.format("program", "General", 2), _HOPE.format("program", "General")))),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", " ".join((_GNU.format("program", "General", 3), _HOPE.format("program", "General")))),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("program", "Affero General", 3)),
    ("AGPL-3.0", " ".join((_GNU.format("program", "Affero General", 3), _HOPE.format("program", "Affero General")))),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GNU.format("library", "Lesser General", "2.1")),
    ("LGPL-2.1", " ".join((_GNU.format("library", "Lesser General", "2.1"), _HOPE.format("library", "Lesser General")))),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", " ".join((_GNU.format("library", "Lesser General", 3), _HOPE.format("library", "Lesser General")))),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((f"CC-{c.upper()}-4.0", _CC.format(n, c)) for c, n in (("by", "Attribution"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-sa", "Attribution-ShareAlike"))),
)


def bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _quoted(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _bounds(size: int, dice: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach ``dice`` with a template of ``size``."""
    fits = [n for n in range(1, 4 * size + 4) if 2 * min(n, size) >= dice * (n + size) - 1e-9]
    return fits[0], fits[-1]


def _rarer(grams: list[str], low: int, dice: float) -> list[str]:
    """Bigrams of which any unit that reaches ``dice`` has one: all but the overlap, plus one.

    Which ones is free; those with the most letters are rarest in prose.
    """
    overlap = next(o for o in range(len(grams) + 1) if 2 * o >= dice * (low + len(grams)) - 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - overlap + 1]


def units(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, whole, unit: lines, paragraphs of several lines, and whole texts, normalised; whole marks the last."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("_text")).where("_text is not null")
    plain = rows.select("doc_id", F.regexp_replace(F.lower("_text"), r"[^a-z0-9\n]+", " ").alias("t"))
    pieces = F.expr(r"concat(split(t, '\n'), filter(split(t, r'\n *(?:\n *)+'), p -> contains(p, '\n')), CASE WHEN rlike(t, r'\n *\n') THEN array(t) ELSE array() END)")
    # the last piece has all of the text: it is the whole, the only paragraph or the only line
    return plain.select("doc_id", F.posexplode(F.reverse(pieces)).alias("at", "u")).select("doc_id", (F.col("at") == 0).alias("whole"), F.trim(F.translate("u", "\n", " ")).alias("unit"))


def _window_test(name: str, text: str, grams: list[str], low: int, dice: float) -> str:
    """The best window of as many words as ``text`` has, of those that hold one of its rarer bigrams."""
    width = len(re.findall(r"[a-z0-9]+", text.lower())) - 1
    overlap = next(o for o in range(len(grams) + 1) if 2 * o >= dice * (low + len(grams)) - 1e-9)
    own, rare = _quoted(grams), _quoted(_rarer(grams, low, dice))
    starts = f"array_distinct(flatten(transform(filter(sequence(0, size(listed) - 1), p -> array_contains({rare}, listed[p])), p -> sequence(greatest(0, p - {width - 1}), least(p, size(listed) - {width})))))"
    value = f"2D * size(array_intersect(slice(listed, s + 1, {width}), {own})) / (size(array_distinct(slice(listed, s + 1, {width}))) + {len(grams)})"
    return f"CASE WHEN size(listed) >= {width} AND size(array_intersect(grams, {own})) >= {overlap} THEN struct('{name}' AS license, array_max(transform({starts}, s -> {value})) AS dice) END"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", dice: float = DICE, templates: tuple[tuple[str, str], ...] = TEMPLATES, inside: bool = False) -> DataFrame:
    """doc_id, license, dice, n_units: a row for each license found in a text, with its best Dice.

    Letters other than a-z and digits other than 0-9 separate words; A-Z count as a-z. Null and
    empty texts have no rows; rows that repeat an id are counted together. n_units counts the
    lines, paragraphs and whole texts that reach ``dice`` for the license. ``inside`` adds licenses that only a window of words inside these
    reaches, with 0 as n_units. Other columns are ignored.
    """
    grams = [(name, bigrams(t)) for name, t in templates]
    sizes = [_bounds(len(g), dice) for _, g in grams]
    fewest, most = min(s[0] for s in sizes), max(s[1] for s in sizes)
    rare = sorted({g for (_, gs), (low, _) in zip(grams, sizes, strict=True) for g in _rarer(gs, low, dice)})
    # a unit with n distinct bigrams has more than n words; one with a rare bigram has its longer word
    words = sorted({max(g.split(), key=len) for g in rare})
    long_enough = units(docs, id_col, text).where(F.length("unit") - F.length(F.translate("unit", " ", "")) >= fewest)
    told = long_enough.select("doc_id", "whole", F.expr("inline(array(struct(split(unit, ' +') AS w)))")).where(f"arrays_overlap(w, {_quoted(words)})")
    listed = told.select("doc_id", "whole", F.expr("inline(transform(array(w), w -> struct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])) AS listed)))"))
    sets = listed.where(f"arrays_overlap(listed, {_quoted(rare)})").select("doc_id", "whole", "listed", F.expr("inline(array(struct(array_distinct(listed) AS grams)))"))
    likely = sets.where(F.size("grams").between(fewest, most) | (F.col("whole") & F.lit(inside)))
    tests = ", ".join(
        f"CASE WHEN size(grams) BETWEEN {low} AND {high} THEN struct('{name}' AS license, 2D * size(array_intersect(grams, {_quoted(g)})) / (size(grams) + {len(g)}) AS dice) END"
        for (name, g), (low, high) in zip(grams, sizes, strict=True)
    )
    windows = ", ".join(_window_test(name, t, g, low, dice) for (name, t), (_, g), (low, _) in zip(templates, grams, sizes, strict=True))
    reached = lambda tests: f"filter(array({tests}), x -> x.dice >= {dice - 1e-9}D)"
    within = f"CASE WHEN whole THEN {reached(windows)} ELSE array() END" if inside else "array()"
    hits = likely.select("doc_id", F.expr(f"inline(array(struct({reached(tests)} AS hits, cast({within} AS array<struct<license: string, dice: double>>) AS within)))"))
    best = lambda hits, n: f"transform(array_distinct(transform({hits}, x -> x.license)), n -> struct({n} AS n, n AS license, array_max(transform(filter({hits}, x -> x.license = n), x -> x.dice)) AS dice))"
    found = hits.select("doc_id", F.expr(f"inline(concat({best('hits', 1)}, {best('within', 0)}))"))
    in_units, in_windows = (F.max(F.when(F.col("n") == n, F.col("dice"))) for n in (1, 0))
    return found.groupBy("doc_id", "license").agg(F.round(F.coalesce(in_units, in_windows), 6).alias("dice"), F.sum("n").cast("long").alias("n_units"))
