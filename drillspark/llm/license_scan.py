"""Licence notices in texts: lines, whole texts and runs of words compared with templates by Dice's coefficient over word bigrams.

Two bigram sets of sizes a and b have at most the coefficient 2 min(a, b) / (a + b), so a template is compared only with
units whose size lies between t / (2 - t) and (2 - t) / t times its own. To reach t, a unit needs at least t / (2 - t) of
a template's bigrams; so a text without any of a few telling ones of each template, its anchors, has no match and is left
after one pass. The templates are short notices and the full texts in ``licences``; they are part of the expression, so
each row is judged by itself, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and wordings of common notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("AGPL-3.0", "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]
#: Full texts, named by their files.
TEMPLATES += [(path.stem, path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
GAP = "[^a-z0-9]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def template_bigrams(text: str) -> list[str]:
    words = [w for w in re.split(GAP, text.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _anchors(bigrams: list[str], need: int) -> list[str]:
    """So many of the longest bigrams that a text with ``need`` of all has one of them."""
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - need + 1]


def scan(docs: DataFrame, least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_units, n_matches, licenses, best_license, best_dice.

    Units are the lines of a text and, if it has several, the whole text. A unit matches the templates that it reaches
    ``least`` with. A template that no unit matches is sought in runs of words, over line ends and within lines: a run
    starts and ends with bigrams of the template and has at most as many others in between as the size bounds leave; the
    best run counts as one more match. ``licenses`` lists the names in order, ``best_license`` is the name with the
    highest coefficient, the first by name among equals. A missing or empty text, or one of single words, has no match;
    repeated rows each have a result; an empty table gives an empty one; other columns are ignored.
    """
    low, high = least / (2 - least), (2 - least) / least
    sets = [(name, bigrams) for name, text in templates if (bigrams := template_bigrams(text))]
    needs = [max(1, math.ceil(low * len(s) - 1e-9)) for _, s in sets]
    anchors = sorted({a for (_, s), need in zip(sets, needs) for a in _anchors(s, need)})
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(len(s)).alias("size"),
                F.lit(need).alias("need"),
                F.lit(math.floor((high - 1) * len(s) + 1e-9)).alias("others"),
                F.split(F.lit("\n".join(s)), "\n").alias("bigrams"),
            )
            for (name, s), need in zip(sets, needs)
        ]
    )

    def pairs_of(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))

    def scored(found: Column, at: Column) -> Column:
        template = F.get(known, at)
        dice = 2.0 * F.size(F.array_intersect(found, template["bigrams"])) / (F.size(found) + template["size"])
        return F.struct(dice.alias("dice"), template["name"].alias("name"), at.alias("at"))

    def matches(found: Column) -> Column:
        n = F.size(found)
        near = F.filter("possible", lambda at: (n >= low * F.get(known, at)["size"]) & (n <= high * F.get(known, at)["size"]))
        return F.filter(F.transform(near, lambda at: scored(found, at)), lambda m: m["dice"] >= least)

    def best_run(at: Column) -> Column:
        template = F.get(known, at)

        def among(hits: Column) -> Column:
            """``hits``: the places of the template's bigrams; runs of neighbours are taken whole, which never lowers Dice."""
            spots = F.transform(hits, lambda p, k: F.struct(p.alias("p"), k.alias("k")))
            firsts = F.filter(spots, lambda s: F.coalesce(F.get(hits, s["k"] - 1) != s["p"] - 1, F.lit(True)))
            lasts = F.filter(spots, lambda s: F.coalesce(F.get(hits, s["k"] + 1) != s["p"] + 1, F.lit(True)))

            def from_(first: Column, n: Column, ends: Column) -> Column:
                fits = lambda e: (e["k"] - first["k"] + 1 >= template["need"]) & (e["p"] - first["p"] - e["k"] + first["k"] <= template["others"])
                runs = F.filter(F.slice(ends, n + 1, template["others"] + 1), fits)
                return F.transform(runs, lambda e: scored(F.array_distinct(F.slice("pairs", first["p"] + 1, e["p"] - first["p"] + 1)), at))

            return _bound(lasts, lambda ends: F.flatten(F.transform(firsts, lambda first, n: from_(first, n, ends))))

        hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda i: F.array_contains(template["bigrams"], F.get("pairs", i)))
        return F.array_max(_bound(hits, among))

    none = F.lit(None)
    out = docs.select("doc_id", text.alias("text"), _words(text).alias("words"))
    words = F.col("words")
    anchored = F.exists(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)).isin(anchors))
    out = out.select("doc_id", "text", F.when((F.size(words) > 1) & anchored, pairs_of(words)).alias("pairs"))
    out = out.select("*", F.array_distinct("pairs").alias("distinct"))
    enough = lambda at: (F.size("distinct") >= F.get(known, at)["need"]) & (F.size(F.array_intersect("distinct", F.get(known, at)["bigrams"])) >= F.get(known, at)["need"])
    possible = F.filter(F.sequence(F.lit(0), F.lit(len(sets) - 1)), enough)
    out = out.select("doc_id", "text", "pairs", F.when(F.col("pairs").isNotNull(), possible).otherwise(none).alias("possible"))
    any_possible = F.size("possible") > 0
    lines = F.split("text", "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array("text"))).otherwise(lines)
    split = F.filter(F.transform(units, _words), lambda w: F.size(w) > 1)
    by_unit = F.flatten(F.transform(F.transform(split, lambda w: F.array_distinct(pairs_of(w))), matches))
    n_units = F.size(lines) + F.when(F.size(lines) > 1, 1).otherwise(0)
    out = out.select("doc_id", n_units.cast("long").alias("n_units"), "pairs", "possible", F.when(any_possible, by_unit).otherwise(none).alias("by_unit"))
    rest = F.filter("possible", lambda at: ~F.exists("by_unit", lambda m: m["at"] == at))
    by_run = F.filter(F.transform(rest, best_run), lambda m: m["dice"] >= least)
    found = F.when(any_possible, F.concat("by_unit", by_run))
    out = out.select("doc_id", "n_units", F.coalesce(found, F.array().cast(out.schema["by_unit"].dataType)).alias("found"))
    best = F.array_min(F.transform("found", lambda m: F.struct((-m["dice"]).alias("less"), m["name"].alias("name"))))
    return out.select(
        "doc_id",
        "n_units",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))), ",").alias("licenses"),
        best["name"].alias("best_license"),
        (-best["less"]).alias("best_dice"),
    )
