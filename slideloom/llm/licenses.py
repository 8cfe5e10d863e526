"""Licence texts and notices in documents, by word bigrams shared with templates.

DataFrame functions only; no Python runs on executors.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from slideloom.llm.common import text_of
from slideloom.llm.secrets import let

# Names of licences as notices give them, and the sentences around them.
NAMES = (
    ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"), ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("ISC", "the ISC License"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC0-1.0", "CC0 1.0"),
)
NOTICES = ("Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "This project is licensed under the terms of {}.")
# Standard licence texts.
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("BSD-2-Clause", _REDISTRIBUTION + _DISCLAIMER), ("BSD-3-Clause", _REDISTRIBUTION + _ENDORSEMENT + _DISCLAIMER),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
and by any means."""),
)
TEMPLATES = (*((n, form.format(name)) for n, name in NAMES for form in NOTICES), *TEXTS)

OTHER = r"[^\p{L}\p{N}]+"
OWNER = r"(?i)^\s*(copyright|\(c\)|©)"
PARAGRAPH = r"\n[\x20\t\r]*\n"


def template_bigrams(text: str) -> Counter:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def words_of(text: Column) -> Column:
    """Letters and digits in lower case; all else separates."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), OTHER, " "), " "), lambda w: w != "")


def passages(text: Column) -> Column:
    """Words of every line, paragraph and the whole text, without lines that name an owner; each once."""
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: ~F.rlike(x, F.lit(OWNER)))
    by_line = F.transform(lines(text), words_of)
    by_part = F.transform(F.split(text, PARAGRAPH, -1), lambda p: words_of(F.array_join(lines(p), " ")))
    return let(by_part, lambda parts: F.array_distinct(F.concat(by_line, parts, F.array(F.flatten(parts)))))


def scan(docs: DataFrame, text: str = "text", least: float = 0.8, templates=TEMPLATES, name: str = "licenses") -> DataFrame:
    """``docs`` with the licences of each text: array of (dice, license, words) of matching passages, best first.

    Passages (lines, paragraphs, whole text) and templates are bags of word bigrams; their Dice
    coefficient is twice the shared bigrams by the sum of both sizes. To reach ``least`` = t, sizes may differ by the factor (2 - t) / t
    at most, so passages meet only templates within it, and none at all beyond the
    largest. Shared bigrams are looked up once per passage; repeats are counted only
    where the bound by the template's own counts reaches t. No shuffle.

    A null or empty text has no licence; repeated rows are treated alike; all columns stay.
    """
    bags = [(label, template_bigrams(t)) for label, t in templates]
    ratio = (2 - least) / least
    sizes = [b.total() for _, b in bags]
    low, high = min(sizes) / ratio, max(sizes) * ratio
    union = sorted({g for _, b in bags for g in b})
    place = {g: i for i, g in enumerate(union)}
    known = F.array(*[F.lit(g) for g in union])
    table = F.array(*[F.struct(
        F.lit(label).alias("license"), F.lit(b.total()).alias("size"),
        F.map_from_arrays(F.array(*[F.lit(g) for g in b]), F.array(*[F.lit(n) for n in b.values()])).alias("counts"),
    ) for label, b in bags])
    assert len(place) == len(union)

    def compare(words):
        def against(pairs, shared):
            size = F.size(pairs)

            def one(t):
                bound = F.aggregate(shared, F.lit(0), lambda a, g: a + F.coalesce(t["counts"][g], F.lit(0)))
                exact = F.aggregate(shared, F.lit(0), lambda a, g: a + F.least(F.coalesce(t["counts"][g], F.lit(0)), F.size(F.filter(pairs, lambda p: p == g))))
                both = (size + t["size"]).cast("double")
                common = F.when(2 * bound >= least * both - 1e-9, exact).otherwise(F.lit(0))
                return F.struct((2 * common / both).alias("dice"), t["license"].alias("license"), F.size(words).alias("words"))

            near = F.filter(table, lambda t: (t["size"] <= size * ratio + 1e-9) & (size <= t["size"] * ratio + 1e-9))
            return F.filter(F.transform(near, one), lambda m: m["dice"] >= least - 1e-9)

        none = F.array().cast("array<struct<dice:double,license:string,words:int>>")
        pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
        return let(pairs, lambda p: let(F.array_intersect(p, known), lambda s: F.when(F.size(s) > 0, against(p, s)).otherwise(none)))

    fit = F.filter(passages(text_of(text)), lambda w: (F.size(w) - 1 >= low - 1e-9) & (F.size(w) - 1 <= high + 1e-9) & (F.size(w) > 1))
    found = F.flatten(F.transform(fit, compare))
    # best first, ties by name
    order = F.array_sort(F.transform(found, lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"), m["words"].alias("words"))))
    return docs.withColumn(name, F.transform(order, lambda m: F.struct((-m["d"]).alias("dice"), m["license"], m["words"])))
