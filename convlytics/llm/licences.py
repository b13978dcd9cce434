"""Licence scans: normalised text against templates by the Dice coefficient over word bigrams.

Units are the lines of a text and the text as a whole.  A template can only reach the threshold
for units whose number of bigrams lies within bounds that follow from its own, so most units
meet no template at all; and a unit that reaches it must share one of the template's rarest
bigrams, so one search for their longer words leaves out most texts.  All of it is column expressions on the row that
holds the text: nothing is exploded before a unit passed the bounds, and nothing is shuffled
but the matches, which are few.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.plans.once import evaluate_once

# Notices by which texts name their licence.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-3-clause-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "Copyright. All rights reserved.",
}
# Whole licences, compared with passages of texts (`licence_passages`).
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
FULL_TEXTS = {
    "mit-full": TEMPLATES["mit-notice"]
    + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-full": _BSD + _BSD_DISCLAIMER,
    "bsd-3-clause-full": _BSD + _BSD_THIRD + _BSD_DISCLAIMER,
}
#: Dice coefficient in percent from which a unit matches.
PERCENT = 80
#: Possessive, so that a word of any length takes no stack.
_WORD = "[a-z0-9]++(?:[.\\-][a-z0-9]++)*+"


def normal_words(text: str) -> list[str]:
    """The words of a text as templates and units are compared: lower case, no marks."""
    return re.findall(_WORD, text.translate({i: i + 32 for i in range(65, 91)}))


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(n: int, percent: int) -> tuple[int, int]:
    """Least and most bigrams of a unit whose Dice coefficient with ``n`` can reach ``percent``."""
    return -(-percent * n // (200 - percent)), (200 - percent) * n // percent


def _prepared(templates: dict[str, str], percent: int) -> list[tuple[str, list[str], int, int, list[str]]]:
    """(name, bigrams, least, most, rare): a unit that matches holds one of ``rare``."""
    grams = {name: bigrams(normal_words(text)) for name, text in templates.items()}
    known = Counter(g for some in grams.values() for g in some)
    out = []
    for name, some in grams.items():
        if not some:
            raise ValueError(f"template {name} has fewer than two words")
        least, most = size_bounds(len(some), percent)
        shared = math.ceil(percent * (len(some) + least) / 200)  # bigrams that any match has in common
        out.append((name, some, least, most, sorted(some, key=lambda g: (known[g], -max(map(len, g.split(" "))), g))[: len(some) - shared + 1]))
    return out


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({_WORD})"), F.lit(1))


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def _anchored(text: Column, known: list[tuple]) -> Column:
    """A match holds a rare bigram, so it holds the longer word of one: most texts end here."""
    anchors = sorted({max(g.split(" "), key=len) for _, _, _, _, rare in known for g in rare})
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, anchors)) + ")(?![a-z0-9])")


def licence_matches(docs: DataFrame, templates: dict[str, str] | None = None, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template that a unit of it matches.

    ``doc_id, licence, shared, united, units``: the shared bigrams and the sum of both sizes of
    the best unit (Dice = 2 * shared / united), and how many units match.  Of ties the smaller
    ``united`` counts.  NULL and empty texts, and units with fewer than two words, match
    nothing; a line that is the whole text is one unit; whole texts of any length are compared;
    repeated rows add their units; an empty table gives none.  Other columns are not read.
    """
    known = _prepared(templates or TEMPLATES, percent)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).filter(_anchored(text, known))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 2)
    units = F.when(F.size(F.split("text", "\n")) > 1, F.concat(lines, F.array("text"))).otherwise(F.array("text"))
    least, most = min(k[2] for k in known), max(k[3] for k in known)
    # A word has a character at least and a blank before it: texts under the bound are too short.
    short = F.filter(units, lambda u: F.length(u) >= 2 * least + 1)
    grams = F.transform(short, lambda u: _bigrams(_words(u)))
    fitting = F.filter(grams, lambda g: F.size(g).between(least, most))
    rows = evaluate_once(rows, {"grams": fitting}).filter(F.size("grams") > 0).select("doc_id", F.explode("grams").alias("gram"))
    found = F.array(
        *(
            F.when(
                F.size("gram").between(low, high) & F.arrays_overlap("gram", F.array(*map(F.lit, rare))),
                F.struct(F.lit(name).alias("licence"), F.size(F.array_intersect("gram", F.array(*map(F.lit, some)))).alias("shared"), (F.size("gram") + len(some)).alias("united")),
            )
            for name, some, low, high, rare in known
        )
    )
    met = evaluate_once(rows, {"found": found}).select("doc_id", F.explode("found").alias("m")).filter("m is not null").select("doc_id", "m.*")
    met = met.filter(F.col("shared") * 200 >= F.col("united") * percent)
    # Dice rises with shared / united; both stay whole numbers.
    best = F.max(F.struct((F.col("shared") / F.col("united")).alias("share"), (-F.col("united")).alias("size"), "shared"))
    per = met.groupBy("doc_id", "licence").agg(best.alias("best"), F.count("*").alias("units"))
    return per.select("doc_id", "licence", F.col("best.shared").cast("long").alias("shared"), (-F.col("best.size")).cast("long").alias("united"), "units")


def licence_passages(docs: DataFrame, templates: dict[str, str] | None = None, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template that a passage of it matches: ``doc_id, licence, shared, united``.

    A passage is any run of neighbouring words that has as many bigrams as a match can have, across
    lines, sentences and marks, so wrapped and embedded notices are found.  The best passage
    counts as in `licence_matches`.  It starts and ends with bigrams of the template (others
    only lower its coefficient), so only such runs are compared, where enough of them are near.

    NULL and empty texts and texts of fewer than two words match nothing; whole texts of any length
    are compared; rows with equal ids give one result, the best of their passages; a NULL id is
    kept as one; an empty table gives no row.  Other columns are not read, whatever their names.
    """
    known = _prepared(templates or TEMPLATES | FULL_TEXTS, percent)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).filter(_anchored(text, known))
    words = _words(F.col("text"))
    rows = evaluate_once(rows, {"words": words}).select("doc_id", "words").filter(F.size("words") > 1)
    rows = evaluate_once(rows, {"pairs": F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))})
    every = sorted({g for _, _, _, _, rare in known for g in rare})
    rows = evaluate_once(rows.select("doc_id", "pairs"), {"marks": F.array_intersect("pairs", F.array(*map(F.lit, every)))}).filter(F.size("marks") > 0)

    def best(name: str, some: list[str], least: int, most: int) -> Column:
        enough = math.ceil(percent * (len(some) + least) / 200)
        hits = F.filter(F.transform("pairs", lambda g, i: F.when(g.isin(some), F.struct(i.alias("at"), g.alias("gram")))), lambda h: h.isNotNull())

        def passage(hits: Column, i: Column, j: Column) -> Column:
            first, last = F.get(hits, i)["at"], F.get(hits, j)["at"]
            shared = F.size(F.array_distinct(F.transform(F.slice(hits, i + 1, j - i + 1), lambda h: h["gram"])))
            united = F.size(F.array_distinct(F.slice("pairs", first + 1, last - first + 1))) + len(some)
            return F.struct((shared / united).alias("share"), (-united).alias("size"), shared.alias("shared"))

        def of_start(hits: Column, i: Column) -> Column:
            near = F.filter(F.sequence(i + (enough - 1), F.least(i + (most - 1), F.size(hits) - 1)), lambda j: F.get(hits, j)["at"] - F.get(hits, i)["at"] < most)
            fits = F.get(hits, i + (enough - 1))["at"] - F.get(hits, i)["at"] < most
            return F.when(fits, F.array_max(F.transform(near, lambda j: passage(hits, i, j))))

        of_hits = lambda h: F.when(F.size(h) >= enough, F.array_max(F.transform(F.sequence(F.lit(0), F.size(h) - enough), lambda i: of_start(h, i))))
        return F.struct(F.lit(name).alias("licence"), F.get(F.transform(F.array(hits), of_hits), F.lit(0)).alias("best"))

    found = F.array(*(F.when(F.arrays_overlap("marks", F.array(*map(F.lit, rare))), best(name, some, low, high)) for name, some, low, high, rare in known))
    met = evaluate_once(rows, {"found": found}).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.licence", "m.best")
    met = met.filter(F.col("best.shared") * 200 >= -F.col("best.size") * percent)
    per = met.groupBy("doc_id", "licence").agg(F.max("best").alias("best"))
    return per.select("doc_id", "licence", F.col("best.shared").cast("long").alias("shared"), (-F.col("best.size")).cast("long").alias("united"))
