"""License scans: text units and runs of words compared with license templates by the Dice coefficient over word bigrams.

Units are the lines, the blocks between blank lines, and the whole text. A unit is lower-cased, everything but a-z and
digits separates words, and its set of word bigrams is compared with each template whose size allows the wanted Dice value:
2 min(a, b) / (a + b) bounds it, so a unit of b bigrams only meets templates of between t/(2-t) b and (2-t)/t b bigrams. Units
outside the bounds of all templates are dropped. Before that, texts and units without any marker word are: a match of Dice t
shares more than t/(2-t) of a template's bigrams, and markers are chosen so that fewer than that lack them, so nothing is lost.

A license of several paragraphs amid other text, or a notice inside a longer line, is no unit. Where no unit matches, runs are
compared: neighbouring lines (blank ones don't count) within the size bounds, and words, across lines and blocks, of at least
the template's number and at most (2-t)/t of its bigrams, beginning with one of the template's bigrams or ending the text.
Shorter runs of words aren't taken: without its last word, another version's notice would match. Only templates of which the
text holds t/(2-t) of the bigrams are looked at, which every match does.

DataFrame functions only, one pass, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import table

#: Smallest Dice value that counts as a match.
MATCH = 0.8

# License notices and texts as published.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission."
)
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (license, template text); several templates may stand for one license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", f"{_GRANT_MIT} {_WARRANTY_MIT}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
        "under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_ONE} {_BSD_TWO} {_WARRANTY_BSD}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_ONE} {_BSD_TWO} {_BSD_THREE} {_WARRANTY_BSD}"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    ("proprietary", "All rights reserved."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def bigrams_of(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _bounds(match: float, templates: tuple[tuple[str, str], ...]) -> tuple[int, int]:
    sizes = [len(bigrams_of(t)) for _, t in templates]
    return max(1, int(min(sizes) * match / (2 - match))), int(max(sizes) * (2 - match) / match) + 1


def markers(match: float, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """Words of which every match of any template holds at least one. Each template's words are added, most bigrams first, until
    the bigrams without a marker are too few for a match."""
    chosen: list[str] = []
    for _, text in templates:
        grams = bigrams_of(text)
        while len(rest := [g for g in grams if not set(g.split()) & set(chosen)]) >= len(grams) * match / (2 - match):
            words = {w: sum(w in g.split() for g in rest) for w in normal_words(text)}
            chosen.append(max(words, key=lambda w: (len(w) > 4, words[w] * len(w), w)))
    return chosen


def _best(units: Column, match: float, templates: tuple[tuple[str, str], ...]) -> Column:
    """(dice, -template, license) of the best template for any of the units, which are arrays of distinct bigrams."""
    known = []
    for i, (name, text) in enumerate(templates):
        grams = bigrams_of(text)
        known.append((len(grams), i, name, F.array(*(F.lit(g) for g in grams))))

    def compare(u: Column) -> Column:
        n = F.size(u)
        found = []
        for size, i, name, grams in known:
            fits = (n >= size * match / (2 - match)) & (n <= size * (2 - match) / match)
            dice = 2.0 * F.size(F.array_intersect(u, grams)) / (n + size)
            found.append(F.when(fits, F.struct(dice.alias("dice"), F.lit(-i).alias("rank"), F.lit(name).alias("license"))))
        return F.array_max(F.array_compact(F.array(*found)))

    return F.array_max(F.array_compact(F.transform(units, compare)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _best_run(low: Column, match: float, templates: tuple[tuple[str, str], ...]) -> Column:
    """(dice, -template, license) of the best template for any run of the lower-cased text ``low``; null below ``match``."""
    known, union = [], set()
    for i, (name, text) in enumerate(templates):
        grams = bigrams_of(text)
        least, most = max(1, math.ceil(len(grams) * match / (2 - match) - 1e-9)), int(len(grams) * (2 - match) / match + 1e-9)
        numbers = {"rank": -i, "license": name, "size": len(grams), "least": least, "most": most, "usual": len(normal_words(text)) - 1}
        known.append(F.struct(*(F.lit(v).alias(k) for k, v in numbers.items()), F.array(*(F.lit(g) for g in grams)).alias("grams")))
        union |= set(grams)

    def of_template(grams: Column, t: Column, at: Column, heads: Column, tails: Column) -> Column:
        """Best Dice value. ``at``: places of the template's bigrams among ``grams``; lines go from word ``heads`` to ``tails``."""

        def better(best: Column, held: Column | None, first: Column, last: Column) -> Column:
            run = F.slice(grams, first + 1, last - first + 1)
            dice = F.greatest(best, 2.0 * F.size(F.array_intersect(run, t["grams"])) / (F.size(F.array_distinct(run)) + t["size"]))
            if held is None:
                return dice
            # A run that holds so many template bigrams reaches 2 held / (held + size) at most.
            most = F.least(held, t["size"])
            return F.when(2.0 * most / (most + t["size"]) > best, dice).otherwise(best)

        def words_from(best: Column, a: Column) -> Column:
            first = F.least(at[a], F.greatest(F.size(grams) - t["usual"], F.lit(0)))
            usual_end = first + t["usual"] - 1
            ends = F.sequence(a + t["least"] - 1, F.least(F.size(at) - 1, a + t["most"] - 1))
            fits = F.filter(ends, lambda b: (at[b] - first < F.greatest(t["most"], t["usual"])) & ((b == F.size(at) - 1) | (F.get(at, b + 1) > usual_end)))
            return F.when(best < 1, F.aggregate(fits, best, lambda x, b: better(x, b - a + 1, first, F.greatest(at[b], usual_end)))).otherwise(best)

        def lines_from(best: Column, a: Column) -> Column:
            ends = F.sequence(a, F.least(F.size(heads) - 1, a + t["most"]))
            fits = F.filter(ends, lambda b: (tails[b] - heads[a]).between(t["least"], t["most"]))
            return F.when(best < 1, F.aggregate(fits, best, lambda x, b: better(x, None, heads[a], tails[b] - 1))).otherwise(best)

        by_words = F.aggregate(F.sequence(F.lit(0), F.size(at) - t["least"]), F.lit(0.0), words_from)
        lines = F.sequence(F.lit(0), F.size(heads) - 1)
        enough = F.filter(lines, lambda a: F.size(F.filter(at, lambda p: (p >= heads[a]) & (p < heads[a] + t["most"]))) >= t["least"])
        return F.aggregate(enough, by_words, lines_from)

    def of_text(grams: Column, words: Column) -> Column:
        placed = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda p: p["gram"].isin(sorted(union)))

        def of_places(places: Column) -> Column:
            near = _let(F.array_distinct(places["gram"]), lambda some: F.filter(F.array(*known), lambda t: F.size(F.array_intersect(some, t["grams"])) >= t["least"]))
            places_of = lambda t: F.filter(places, lambda p: F.array_contains(t["grams"], p["gram"]))["at"]
            index = F.sequence(F.lit(0), F.size(words) - 1)
            heads = F.filter(index, lambda i: (i == 0) | (F.get(words, i - 1)["line"] != words[i]["line"]))
            tails = F.filter(index, lambda i: (i == F.size(words) - 1) | (F.get(words, i + 1)["line"] != words[i]["line"]))

            def compare(t: Column) -> Column:
                dice = _let(places_of(t), lambda at: _let(heads, lambda h: _let(tails, lambda e: of_template(grams, t, at, h, e))))
                return _let(dice, lambda d: F.when(d >= match, F.struct(d.alias("dice"), t["rank"].alias("rank"), t["license"].alias("license"))))

            return F.array_max(F.array_compact(F.transform(near, compare)))

        return _let(placed, of_places)

    in_line = lambda x, i: F.transform(F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.struct(w.alias("word"), i.alias("line")))
    words = F.flatten(F.transform(F.split(low, "\n"), in_line))
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", w[i]["word"], w[i + 1]["word"]))
    return _let(words, lambda w: F.when(F.size(w) > 1, _let(pairs(w), lambda g: of_text(g, w))))


def license_scan(docs: DataFrame, *, match: float = MATCH, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, license, dice, n_units) for each row of ``docs`` (doc_id, text; more columns are ignored).

    license is that of the best unit and template with a Dice value of at least ``match``, or else of the best run and template,
    null where none reaches it (then dice is null as well); ties go to the template that stands first. n_units counts the distinct units, not runs, that
    hold a marker word and are within the size bounds. Whole texts are scanned. Null or empty texts have no units. Repeated rows give repeated rows; an empty table gives none.
    """
    low, high = _bounds(match, templates)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    marked = lambda x: " or ".join(f"contains({x}, '{m}')" for m in markers(match, templates))
    parts = rf"filter(array_distinct(concat(split(_low, '\n'), split(_low, '\n[ \t\r]*\n'), array(_low))), u -> {marked('u')})"
    units = base.withColumn("_low", F.lower("_text")).withColumn("_units", F.expr(f"if({marked('_low')}, {parts}, array())"))
    words = units.withColumn("_words", F.expr(f"filter(transform(_units, u -> filter(split(u, '[^a-z0-9]+'), w -> w != '')), w -> size(w) > {low})"))
    grams = F.expr(f"filter(transform(_words, w -> array_distinct(transform(sequence(0, size(w) - 2), i -> w[i] || ' ' || w[i + 1]))), g -> size(g) between {low} and {high})")
    held = words.select("doc_id", "_low", grams.alias("_grams"))
    units = held.select("doc_id", "_low", F.size("_grams").cast("long").alias("n_units"), _best(F.col("_grams"), match, templates).alias("_unit"))
    run = F.when(F.expr(marked("_low")), _best_run(F.col("_low"), match, templates))
    best = units.select("doc_id", "n_units", F.when(F.col("_unit.dice") >= match, F.col("_unit")).otherwise(run).alias("_b"))
    hit = F.col("_b.dice") >= match
    return best.select("doc_id", F.when(hit, F.col("_b.license")).alias("license"), F.when(hit, F.col("_b.dice")).alias("dice"), "n_units")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    low, high = _bounds(MATCH, TEMPLATES)
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in bigrams_of(text))}])" for i, (name, text) in enumerate(TEMPLATES))
    return rf"""
with tpl(i, license, grams) as (values {rows}),
t as (select row_number() over () r, doc_id, lower(coalesce(text, '')) x from documents),
u as (select distinct r, unnest(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\n[ \t\r]*\n'), [x])) u from t),
w as (select r, list_filter(regexp_split_to_array(u, '[^a-z0-9]+'), lambda v: v <> '') w from u where {" or ".join(f"contains(u, '{m}')" for m in markers(MATCH, TEMPLATES))}),
g as (select r, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) g from w where len(w) > {low}),
f as (select r, g from g where len(g) between {low} and {high}),
d as (select r, i, license, 2.0::double * len(list_intersect(f.g, tpl.grams)) / (len(f.g) + len(tpl.grams)) dice from f join tpl
  on len(f.g) >= len(tpl.grams) * {MATCH}::double / {2 - MATCH}::double and len(f.g) <= len(tpl.grams) * {2 - MATCH}::double / {MATCH}::double),
b as (select r, license, dice from d qualify row_number() over (partition by r order by dice desc, i) = 1),
n as (select r, count(*) n from f group by 1)
select t.doc_id, case when dice >= {MATCH} then license end license, case when dice >= {MATCH} then dice end dice, coalesce(n.n, 0)::bigint n_units from t left join b using (r) left join n using (r)
"""


OP2_SQL = _sql()
