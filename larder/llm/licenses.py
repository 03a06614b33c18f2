"""License scan: pieces of text compared with licence templates by Dice over word bigrams.

Text is lower-cased, everything but letters and digits becomes one space, and a piece of text is the set
of its word bigrams. Dice = 2 * shared / (bigrams here + bigrams there). The pieces are, for each
template: every line, the whole text, and every run of as many words as the template has that starts
with one of its bigrams, so that a notice is found where it is wrapped over lines or shares a line.
Pieces of one template that overlap are one finding, reported where it is best. Of two findings of which
one holds the middle word of the other, no longer one, that with more shared bigrams stays; of equals, the
one with the higher Dice, then the first by name.

Size bounds prune: a template of n bigrams can reach the threshold t only with n t / (2 - t) of its own
bigrams or more, in a piece of n t / (2 - t) to n (2 - t) / t bigrams. So some of its words have to occur
in a text at all, which drops nearly every text before its words are cut apart; and a run of words is
only looked at if so many of its bigrams are the template's. All of it is DataFrame functions in one
pass over the table; only findings are shuffled.

Defined cases: null and empty texts have no pieces; a piece of one word has no bigram and matches
nothing; repeated rows are each reported; a null doc_id stays null; other columns are ignored; very long
texts are scanned whole.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

# Wordings of licence notices, as their licences give them or as they are commonly put.
TEMPLATES = {
    "0BSD text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0 header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


# Words too common to tell a text that may have a notice from others.
COMMON = frozenset("a all and any are at be but by for from has have if in is it its may must no not of on or other see so that the this to under will with without you your".split())
MOST_TEMPLATES = 10_000  # they are part of the plan


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates out of a table (license, text), such as one read from Parquet."""
    rows = table.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return {r["license"]: r["text"] for r in rows}


def template_words(text: str) -> list[str]:
    """The words of a template, as words_of gives them for a column."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigram_set(text: str) -> list[str]:
    """The bigrams of a template in order, for a stable plan."""
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def least_shared(n: int, threshold: float) -> int:
    """How many of a template's n bigrams a piece has at least if it reaches the threshold."""
    return max(1, math.ceil(n * threshold / (2 - threshold) - 1e-9))


def telling_words(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every text with a finding has one: for each template, words that are in so many
    of its bigrams that the others are too few for the threshold. Long words first, which are rare, and
    common ones last."""
    out: set[str] = set()
    for own in sets.values():
        left = set(own)
        spare = len(own) - (len(own) - least_shared(len(own), threshold) + 1)
        words = sorted({w for b in own for w in b.split()}, key=lambda w: (w not in out, w in COMMON, -len(w), w))
        for w in words:
            if len(left) <= spare:
                break
            met = {b for b in left if w in b.split()}
            if met:
                out.add(w)
                left -= met
    return sorted(out)


def any_of(words: list[str]) -> str:
    """A pattern for any of the words at the start of a word, as a tree of their letters, which a
    matcher leaves at the first letter that none has."""

    def tree(rest: list[str]) -> str:
        if "" in rest:
            return ""
        by_first: dict[str, list[str]] = {}
        for w in rest:
            by_first.setdefault(w[0], []).append(w[1:])
        branches = [re.escape(c) + tree(more) for c, more in by_first.items()]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return f"(?<![a-z0-9]){tree(words)}"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    n = F.greatest(F.size(words), F.lit(1))
    return F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))


TEMPLATE = "array<struct<license: string, own: array<string>, length: int, need: int, low: double, high: double>>"


def as_column(templates: dict[str, str], sets: dict[str, list[str]], threshold: float) -> Column:
    """The templates as one constant, so that the plan does not grow with their number."""
    rows = [
        {
            "license": name,
            "own": own,
            "length": len(template_words(templates[name])),
            "need": least_shared(len(own), threshold),
            "low": len(own) * threshold / (2 - threshold),
            "high": len(own) * (2 - threshold) / threshold,
        }
        for name, own in sets.items()
    ]
    return F.from_json(F.lit(json.dumps(rows)), TEMPLATE)


def pieces(t: Column, threshold: float) -> Column:
    """The pieces of a text that reach the threshold for template t; first and last are their words."""

    def piece(grams: Column, first: Column, last: Column) -> Column:
        distinct, shared = F.size(F.array_distinct(grams)), F.size(F.array_intersect(grams, t["own"]))
        dice = 2.0 * shared / (distinct + F.size(t["own"]))
        return F.struct(t["license"].alias("license"), first.cast("int").alias("first"), last.cast("int").alias("last"), dice.alias("dice"), distinct.alias("bigrams"), shared.alias("shared"))

    # nothing but columns and the lambda's own names inside a lambda: what it captures is made anew for each element
    hits = F.filter("hits", lambda i: F.array_contains(t["own"], F.get("grams", i)))
    later = F.slice(hits, t["need"], F.greatest(F.size(hits), F.lit(1)))
    starts = F.filter(F.zip_with(hits, later, lambda at, enough: F.when(enough <= at + t["length"] - 2, at)), lambda at: at.isNotNull())
    windows = F.transform(starts, lambda at: piece(F.slice("grams", at + 1, t["length"] - 1), at, F.least(at + t["length"] - 1, F.size("words") - 1)))
    fitting = F.filter("units", lambda u: u["size"].between(t["low"], t["high"]) & (u["hits"] >= t["need"]))
    units = F.transform(fitting, lambda u: piece(F.slice("grams", u["first"] + 1, u["last"] - u["first"]), u["first"], u["last"]))
    return F.filter(F.array_distinct(F.concat(windows, units)), lambda p: p["dice"] >= threshold)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id, line, last_line, license, dice, bigrams: one row per finding, with the lines (from 1) of
    its first and its last word. The templates are part of the plan."""
    sets = {name: bigram_set(text) for name, text in sorted(templates.items())}
    sets = {name: s for name, s in sets.items() if s}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    if not sets:
        return rows.select("doc_id", *(F.lit(0).alias(c) for c in ("line", "last_line")), F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit(0).alias("bigrams")).where("false")
    rows = rows.where(F.lower("text").rlike(any_of(telling_words(sets, threshold))))
    rows = rows.select("doc_id", "row", F.transform(F.split("text", "\n"), words_of).alias("lines"))
    rows = rows.withColumn("words", F.flatten("lines"))
    rows = rows.withColumn("line_of", F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, F.size(x)))))
    rows = rows.withColumn("grams", bigrams_of(F.col("words"))).drop("lines")
    # as literals for the parser, which plans them faster than one column each; words are letters and digits
    every = ", ".join(f"'{b}'" for b in sorted({b for s in sets.values() for b in s}))
    rows = rows.withColumn("hits", F.expr(f"filter(transform(grams, (b, i) -> CASE WHEN b IN ({every}) THEN i END), i -> i IS NOT NULL)"))
    rows = rows.where(F.size("hits") >= min(least_shared(len(s), threshold) for s in sets.values()))
    rows = rows.withColumn("units", units_of(every))
    met = F.flatten(F.transform(as_column(templates, sets, threshold), lambda t: pieces(t, threshold)))
    found = rows.select("doc_id", "row", "line_of", F.explode(met).alias("p"))
    found = found.select("doc_id", "row", "p.*", F.get("line_of", F.col("p.first")).alias("line"), F.get("line_of", F.col("p.last")).alias("last_line"))
    found = Scratch(docs.sparkSession, "licenses").keep(found)  # few; else the texts would be cut apart for each side of a join
    return best_findings(found).select("doc_id", "line", "last_line", "license", "dice", "bigrams")


def units_of(every: str) -> Column:
    """(first, last, size, hits) of lines with two or more words, and of a whole text of several lines."""
    n = F.size("words")
    ends = F.filter(F.transform("line_of", lambda x, i: F.when((i == n - 1) | (F.get("line_of", i + 1) != x), i)), lambda i: i.isNotNull())
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    spans = F.zip_with(before, ends, lambda a, b: F.struct((a + 1).alias("first"), b.alias("last")))
    whole = F.when(F.get("line_of", F.lit(0)) != F.get("line_of", n - 1), F.array(F.struct(F.lit(0).alias("first"), (n - 1).alias("last")))).otherwise(F.array().cast("array<struct<first: int, last: int>>"))
    own = F.filter(F.concat(whole, spans), lambda u: u["last"] > u["first"])
    cut = F.transform(own, lambda u: F.struct(u["first"].alias("first"), u["last"].alias("last"), F.slice("grams", u["first"] + 1, u["last"] - u["first"]).alias("own")))
    met = F.transform(cut, lambda u: F.struct(u["first"].alias("first"), u["last"].alias("last"), F.size(F.array_distinct(u["own"])).alias("size"), F.size(F.array_intersect(u["own"], F.expr(f"array({every})"))).alias("hits")))
    return F.filter(met, lambda u: u["hits"] > 0)


def best_findings(found: DataFrame) -> DataFrame:
    """Of the overlapping pieces of one row and template the best; of findings in one place, one."""
    of_one = Window.partitionBy("row", "license").orderBy("first", "last", F.desc("dice"))
    before = F.max("last").over(of_one.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(F.coalesce(F.col("first") > before, F.lit(True)), 1).otherwise(0))
    found = found.withColumn("island", F.sum("new").over(of_one.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy("row", "license", "island").orderBy(F.desc("dice"), "first", "last")
    found = found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("new", "place")
    # two findings meet in the stretch of 256 words that has the shorter one's middle
    middle = F.floor((F.col("first") + F.col("last")) / 2)
    rank = F.struct(F.col("shared"), F.col("dice"))
    inner = found.select("row", F.floor(middle / 256).alias("stretch"), middle.alias("middle"), (F.col("last") - F.col("first")).alias("in_length"), *(F.col(c).alias(f"in_{c}") for c in ("license", "island")), rank.alias("in_rank"))
    outer = found.select("row", F.explode(F.sequence(F.floor(F.col("first") / 256), F.floor(F.col("last") / 256))).alias("stretch"), "license", "island", "first", "last", rank.alias("rank"))
    met = outer.join(inner, ["row", "stretch"]).where("middle BETWEEN first AND last AND in_length <= last - first AND license <> in_license")
    outer_stays = (F.col("rank") > F.col("in_rank")) | (F.col("rank") == F.col("in_rank")) & (F.col("license") < F.col("in_license"))
    loser = F.when(outer_stays, F.struct(F.col("in_license").alias("license"), F.col("in_island").alias("island"))).otherwise(F.struct("license", "island"))
    return found.join(met.select("row", loser.alias("l")).select("row", "l.*"), ["row", "license", "island"], "left_anti")
