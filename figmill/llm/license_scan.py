"""Licence scan by the Dice coefficient over word bigrams. DataFrame operations only.

Normalised lines, and word windows of what lies between those that match, are compared
with licence templates. A line or window of n bigrams can only reach the threshold against
templates whose bigram count lies within bounds that follow from n; they choose the windows'
lengths, and texts without any bigram that a match must hold are dropped before.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.llm.common import ascii_lower

#: Licence notices, by name.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-Rights-Reserved": "All rights reserved.",
}
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Words of a normalised text: A-Z as a-z, all but letters a-z and digits apart."""
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Word bigrams in order; a single word is its own."""
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Bigram counts that can reach the threshold against ``n``: 2 * min / (min + max) is the most that Dice can be."""
    fits = [m for m in range(1, int(n * (2 - threshold) / threshold) + 2) if 2 * min(m, n) >= threshold * (m + n) - 1e-12]
    return min(fits), max(fits)


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def telling(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template, longest first, of which every hit holds one: all but one fewer than a hit needs."""
    needed = math.ceil(threshold * (bounds(len(grams), threshold)[0] + len(grams)) / 2 - 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - max(needed, 1) + 1]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices in every whole text of ``docs(doc_id, text)``: doc_id, n_hits, license, dice.

    Dice is twice the template's bigrams that a line or window holds over the bigrams of
    both (the line's with repeats; templates have distinct ones). A line that reaches the
    threshold against some template is a hit as a whole. What lies between such lines is
    one run of words whatever its line breaks, and any window of it may be a hit, so a
    notice inside a paragraph or wrapped over lines is found. ``n_hits`` counts the hit
    lines and the most hit windows that share no word; ``license`` and ``dice`` (rounded
    to 6 places) are those of the best line or window, ties to the template first in name
    order; null without a hit. Null and empty texts have no hits, repeated rows are
    scanned each, an empty table gives no rows; without templates nothing is a hit; other columns are
    ignored.
    """
    spark = docs.sparkSession
    parsed = spark.createDataFrame(sorted(templates.items()), "name string, body string").select("name", F.array_distinct(bigrams_of(words_of(F.col("body")))).alias("grams")).collect()
    known = [(r["name"], r["grams"], *bounds(len(r["grams"]), threshold)) for r in parsed if r["grams"]]
    if not known:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_hits"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"))
    least, most = min(k[2] for k in known), max(k[3] for k in known)
    listed = [F.array(*map(F.lit, k[1])) for k in known]

    def dice(grams: Column, i: int) -> Column:
        return F.round(F.size(F.array_intersect(grams, listed[i])) * 2.0 / (F.size(grams) + len(known[i][1])), 6)

    def of_line(w: Column) -> Column:
        # the best template, null if no size fits or none reaches the threshold
        fits = lambda g: [F.when((F.size(g) >= low) & (F.size(g) <= high), F.struct(dice(g, i).alias("dice"), F.lit(-i).alias("turn"))) for i, (_, _, low, high) in enumerate(known)]
        sized = (F.greatest(F.size(w) - 1, F.least(F.size(w), F.lit(1))) >= least) & (F.size(w) - 1 <= most)
        best = F.when(sized, _let(bigrams_of(w), lambda g: F.array_max(F.array(*fits(g)))))
        return _let(best, lambda b: F.when(b["dice"] >= threshold, b))

    def of_template(w: Column, g: Column, i: int) -> Column:
        # the best windows begin and end with a template's bigram, as others only lose by what they add
        _, own, low, high = known[i]
        hit = lambda last, first, d: F.struct(last.alias("last"), first.alias("first"), d.alias("dice"), F.lit(-i).alias("turn"))
        at = lambda x: F.filter(F.transform(x, lambda v, k: F.when(F.array_contains(listed[i], v), k)), lambda k: k.isNotNull())
        if " " not in own[0]:
            return F.transform(at(w), lambda k: hit(k, k, F.lit(1.0)))
        ends = lambda k: F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: F.array_contains(listed[i], F.get(g, k + n - 1)))
        found = F.flatten(F.transform(at(g), lambda k: F.transform(ends(k), lambda n: hit(k + n, k, dice(F.slice(g, k + 1, n), i)))))
        return F.filter(found, lambda x: x["dice"] >= threshold)

    def of_run(w: Column) -> Column:
        # hit windows of the words between hit lines; taken by their ends, most of them share no word
        pairs = F.transform(w, lambda x, k: F.concat(x, F.lit(" "), F.get(w, k + 1)))
        found = _let(pairs, lambda g: F.array_sort(F.flatten(F.array(*[of_template(w, g, i) for i in range(len(known))]))))
        step = lambda s, x: F.when(x["first"] > s["end"], F.struct(x["last"].alias("end"), (s["n"] + 1).alias("n"))).otherwise(s)
        apart = lambda f: F.aggregate(f, F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n")), step, lambda s: s["n"])
        return _let(found, lambda f: F.struct(apart(f).alias("n"), F.array_max(F.transform(f, lambda x: F.struct(x["dice"].alias("dice"), x["turn"].alias("turn")))).alias("top")))

    def of_text(lines: Column) -> Column:
        whole = F.transform(F.filter(lines, lambda x: x["hit"].isNotNull()), lambda x: F.struct(F.lit(1).alias("n"), x["hit"].alias("top")))
        joined = F.array_join(F.transform(lines, lambda x: F.when(x["hit"].isNotNull(), F.lit("\n")).otherwise(F.array_join(x["words"], " "))), " ")
        runs = F.transform(F.split(joined, "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
        return F.concat(whole, F.transform(runs, of_run))

    # few texts hold a telling bigram, and only those are cut into lines and words
    plain = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(F.col("text")), "[^a-z0-9]+", " "), F.lit(" "))
    signs = sorted({g for k in known for g in telling(k[1], threshold)})
    told = functools.reduce(lambda a, b: a | b, [F.contains(F.col("plain"), F.lit(f" {g} ")) for g in signs])
    words = F.transform(F.split(F.col("text"), "\n"), words_of)
    hits = F.when(F.col("told"), _let(F.transform(words, lambda w: F.struct(w.alias("words"), of_line(w).alias("hit"))), of_text))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", plain.alias("plain")).withColumn("told", told)
    sums = lambda h: F.struct(F.aggregate(h, F.lit(0), lambda s, x: s + x["n"]).alias("n"), F.array_max(F.transform(h, lambda x: x["top"])).alias("top"))
    found = found.select("doc_id", F.explode(F.array(_let(hits, sums))).alias("found"))
    top = F.col("found.top")
    names = F.array(*[F.lit(k[0]) for k in known])
    return found.select("doc_id", F.coalesce("found.n", F.lit(0)).cast("long").alias("n_hits"), F.get(names, -top["turn"]).alias("license"), top["dice"].alias("dice"))
