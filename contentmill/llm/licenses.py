"""License scans: Dice coefficient of word bigrams with licence templates."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statements by which public licences are commonly applied.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
}
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
# Standard notices, and the licences in full as far as they are short.
NOTICES = {
    "MIT": (_MIT_GRANT, f"{_MIT_GRANT} {_MIT_REST}"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "GPL-2.0": (_GNU.format(";", "General Public License", ";", "2"),),
    "GPL-3.0": (_GNU.format(":", "General Public License", ",", "3"),),
    "LGPL-2.1": (_GNU.format(";", "Lesser General Public License", ";", "2.1"),),
    "LGPL-3.0": (_GNU.format(":", "Lesser General Public License", ",", "3"),),
    "BSD-2-Clause": (f"{_BSD_TWO} {_BSD_REST}",),
    "BSD-3-Clause": (f"{_BSD_TWO} {_BSD_THIRD}", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_REST}"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
}
#: Licences in full, one file each.
TEXTS = Path(__file__).parent / "license_texts"
#: Words by which candidate passages are found, in order of preference.
PREFERRED = ("licens", "cc", "cc0", "gnu", "permission", "redistribution", "mozilla", "creative", "domain")
DICE_LEAST = 0.8


def _plain(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigram_list(text: str) -> list[str]:
    words = _plain(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def anchors(templates: dict[str, tuple[str, ...]], dice: float) -> list[str]:
    """Word beginnings of which every passage that reaches ``dice`` with some template has one.

    A passage needs at least dice / (2 - dice) of a template's bigrams. Words are added
    until each template has fewer bigrams without an anchor than that.
    """
    chosen: list[str] = []
    for text in (t for texts in templates.values() for t in texts):
        grams = bigram_list(text)
        need = dice / (2 - dice) * len(grams)
        own = _plain(text)
        spare = sorted((w for w in own if len(w) > 3), key=lambda w: (-len(w), w)) + sorted(own)
        for word in [p for p in PREFERRED if any(w.startswith(p) for w in own)] + spare:
            if sum(not any(f" {g}".find(f" {a}") >= 0 for a in chosen) for g in grams) < need:
                break
            if word not in chosen:
                chosen.append(word)
    return chosen


def window_anchors(texts: list[str], dice: float) -> list[str]:
    """Words as in ``anchors``; common ones of long texts come last."""
    chosen: list[str] = []
    for text in sorted(texts, key=len):
        grams = bigram_list(text)
        need = dice / (2 - dice) * len(grams)
        own = _plain(text)
        count = Counter(w for g in grams for w in g.split(" "))
        spare = sorted((w for w in count if len(w) > 6), key=lambda w: (-count[w], w)) + sorted(count)
        open_ = [g for g in grams if not any(f" {a}" in f" {g}" for a in chosen)]
        for word in [p for p in PREFERRED if any(w.startswith(p) for w in own)] + spare:
            if len(open_) < need:
                break
            rest = [g for g in open_ if f" {word}" not in f" {g}"]
            if len(rest) < len(open_):
                chosen.append(word)
                open_ = rest
    return chosen


def one_of(words: list[str]) -> str:
    """A pattern of words that branches at each letter; words that begin with another aren't needed."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    if "" in heads:
        return ""
    parts = [re.escape(head) + one_of(rests) for head, rests in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def normalised(text: Column) -> Column:
    """Lower case; runs of other characters than ASCII letters and digits are one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(text: Column) -> Column:
    words = F.split(normalised(text), " ")
    last = F.size(words)
    return F.when(last > 1, F.array_distinct(F.zip_with(F.slice(words, F.lit(1), last - 1), F.slice(words, F.lit(2), last - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, *, templates: dict[str, tuple[str, ...]] = TEMPLATES, notices: dict[str, tuple[str, ...]] | None = None, dice: float = DICE_LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences that the texts hold: one row for each id and licence.

    The whole text, each of its lines and each of its sentences are compared, as sets of
    word bigrams, with every template whose size allows the coefficient; a passage counts
    for the template it is most like (ties go to the first name). Runs of words of a
    template's length, over the ends of lines and sentences, are compared with the
    templates and with ``notices`` (standard notices and full licences, if the templates
    are ours); they count as passages of a licence that no other passage has. Columns: the id, ``license``, ``dice`` (the
    best) and ``n_passages`` (different passages that reach ``dice``).

    Null and empty texts hold none; repeated rows give one row; a null id stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    if notices is None:
        texts = full_texts()
        notices = {name: NOTICES.get(name, ()) + texts.get(name, ()) for name in [*NOTICES, *(n for n in texts if n not in NOTICES)]} if templates is TEMPLATES else {}
    words = anchors(templates, dice)
    gate = f"(?i)(?<![a-z0-9]){one_of(words)}"
    table = [(name, bigram_list(t)) for name, texts in templates.items() for t in texts]
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in table])
    least, most = dice / (2 - dice), (2 - dice) / dice

    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(gate))
    pieces = F.array_distinct(F.concat(F.array("text"), F.split("text", r"[\r\n]+"), F.flatten(F.transform(F.split("text", r"[\r\n]+"), lambda line: F.split(line, r"(?<=[.;!?])\s+")))))
    passages = held.select("id", F.explode(F.filter(pieces, lambda p: p.rlike(gate))).alias("passage"))
    sets = passages.select("id", normalised(F.col("passage")).alias("passage"), bigrams(F.col("passage")).alias("grams"))

    def near(t: Column) -> Column:
        sized = (F.size("grams") >= least * F.size(t["grams"]) - 1e-9) & (F.size("grams") <= most * F.size(t["grams"]) + 1e-9)
        return F.struct(F.when(sized, 2.0 * F.size(F.array_intersect("grams", t["grams"])) / (F.size("grams") + F.size(t["grams"]))).otherwise(0.0).alias("dice"), t["name"].alias("license"))

    # Exploding what reaches the bound keeps each comparison to one evaluation.
    close = sets.select("id", "passage", F.explode(F.filter(F.transform(known, near), lambda m: m["dice"] >= dice - 1e-12)).alias("m"))
    best = close.groupBy("id", "passage").agg(F.min(F.struct((-F.col("m.dice")).alias("less"), F.col("m.license").alias("license"))).alias("b"))
    whole = best.select("id", "b.license", (-F.col("b.less")).alias("dice"), F.lit(1).alias("pieces"), F.lit(None).cast("string").alias("window"))
    more = _windows(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), [(n, t) for table in (templates, notices) for n, ts in table.items() for t in ts], dice)
    found = whole.unionByName(more).groupBy("id", "license").agg(F.max("dice").alias("dice"), F.sum("pieces").alias("pieces"), F.count_distinct("window").alias("windows"))
    return found.select(F.col("id").alias(id_col), "license", F.round("dice", 9).alias("dice"), F.when(F.col("pieces") > 0, F.col("pieces")).otherwise(F.col("windows")).alias("n_passages"))


def full_texts() -> dict[str, tuple[str, ...]]:
    return {p.stem: (p.read_text(encoding="utf-8"),) for p in sorted(TEXTS.glob("*.txt"))}


def _windows(docs: DataFrame, templates: list[tuple[str, str]], dice: float) -> DataFrame:
    """Runs of words as long as a template that reach ``dice`` with it, over lines and sentences.

    Of windows that overlap, the one with the highest coefficient counts (then the longer
    one, then the first name). A shift by one word brings one more bigram of the template
    at most, so starts that can't reach the bound are left out.
    """
    least = dice / (2 - dice)
    rows = [(name, bigram_list(text), len(_plain(text)) - 1) for name, text in templates]

    def listed(grams: list[str]) -> Column:
        return F.split(F.lit("|".join(grams)), r"\|")

    known = F.array(*[F.struct(F.lit(name).alias("name"), listed(grams).alias("grams"), F.lit(size).alias("size"), F.lit(len(grams)).alias("kinds"), F.lit(math.ceil(least * len(grams) - 1e-9)).alias("need")) for name, grams, size in rows])
    union = listed(sorted({g for _, grams, _ in rows for g in grams}))
    gate = f"(?i)(?<![a-z0-9]){one_of(window_anchors([t for _, t in templates], dice))}"
    kind = "array<struct<dice:double,start:int,end:int,license:string>>"

    words = F.split(normalised(F.col("text")), " ")
    last = F.size(words)
    # Exploding one-element arrays keeps what is used again from being computed again.
    pairs = F.when(last > 1, F.zip_with(F.slice(words, F.lit(1), last - 1), F.slice(words, F.lit(2), last - 1), lambda a, b: F.concat_ws(" ", a, b)))
    grams = docs.where(F.col("text").rlike(gate)).select("id", F.explode(F.array(pairs)).alias("g")).where("g is not null")
    seen = grams.select("id", "g", F.explode(F.array(F.array_intersect("g", union))).alias("seen")).where(F.size("seen") >= min(math.ceil(least * len(g) - 1e-9) for _, g, _ in rows))
    chosen = seen.select("id", "g", F.explode(F.array(F.filter(known, lambda t: F.size(F.array_intersect("seen", t["grams"])) >= t["need"]))).alias("known")).where("size(known) > 0")

    def of(t: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            own = F.array_distinct(F.slice("g", i, t["size"]))

            def judged(x: Column) -> Column:
                d = 2.0 * x["shared"] / (x["kinds"] + t["kinds"])
                this = F.array(F.struct(d.alias("dice"), i.alias("start"), (i + t["size"]).alias("end"), t["name"].alias("license")))
                apart = (F.size(state["found"]) == 0) | (F.get(state["found"], F.size(state["found"]) - 1)["end"] <= i)
                better = F.get(state["found"], F.size(state["found"]) - 1)["dice"] < d
                found = F.when(d < dice - 1e-12, state["found"]).when(apart, F.concat(state["found"], this)).when(better, F.concat(F.slice(state["found"], F.lit(1), F.size(state["found"]) - 1), this)).otherwise(state["found"])
                return F.struct((i + F.greatest(F.lit(1), t["need"] - x["shared"])).cast("int").alias("next"), found.cast(kind).alias("found"))

            scored = F.transform(F.array(own), lambda o: F.struct(F.size(F.array_intersect(o, t["grams"])).alias("shared"), F.size(o).alias("kinds")))
            return F.when(i < state["next"], state).otherwise(F.get(F.transform(scored, judged), F.lit(0)))

        start = F.struct(F.lit(1).alias("next"), F.array().cast(kind).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.size("g")), start, step, lambda state: state["found"])

    spots = chosen.select("id", "g", F.explode(F.array(F.flatten(F.transform("known", of)))).alias("spots"))

    def beaten(x: Column) -> Column:
        def by(y: Column) -> Column:
            rank = lambda z: F.struct(-z["dice"], z["start"] - z["end"], z["license"], z["start"])
            return (y["start"] < x["end"]) & (x["start"] < y["end"]) & (rank(y) < rank(x))

        return F.exists("spots", by)

    left = spots.select("id", "g", F.explode(F.filter("spots", lambda x: ~beaten(x))).alias("s"))
    return left.select("id", "s.license", "s.dice", F.lit(0).alias("pieces"), F.md5(F.array_join(F.slice("g", F.col("s.start"), F.col("s.end") - F.col("s.start")), "|")).alias("window"))
