"""License scans: units of text against licence templates by the Dice coefficient of their word bigrams.

Columns only: no join, no shuffle, no Python. The templates are a small fixed table; it is turned into a literal map from a
unit's number of bigrams to the templates that can reach the threshold at that size, so a unit meets only templates of fitting
size. Before that, texts and units that hold none of a few words are dropped: `probes` chooses the words so that without them
too few bigrams of any template are left to share, so nothing that can match is lost.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Notices by which works state their licence, under the SPDX name of the licence.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text, normalised as in `scan`."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{x} {y}" for x, y in zip(w, w[1:])})


def size_bounds(n: int, dice: float) -> range:
    """Sizes of sets that can reach the coefficient with a set of n: at most the lesser size is shared."""
    return range(math.ceil(n * dice / (2 - dice) - 1e-9), math.floor(n * (2 - dice) / dice + 1e-9) + 1)


def probes(templates: list[tuple[str, str]], dice: float) -> list[tuple[str, ...]]:
    """Groups of strings: every text that reaches the coefficient with a template holds all strings of a group at least.

    A set that reaches it with a template of n bigrams shares at least `least` of them with it, so groups suffice for that
    template if fewer than `least` of its bigrams hold none. Long words that serve many bigrams are chosen first; where a
    template has only short ones left, a pair of words. Groups that turn out not to be needed are dropped.
    """
    needs = []
    for _, text in templates:
        if grams := [tuple(g.split()) for g in bigrams(text)]:
            needs.append((grams, math.ceil(dice * (size_bounds(len(grams), dice)[0] + len(grams)) / 2 - 1e-9)))

    def held(group: tuple[str, ...], gram: tuple[str, ...]) -> bool:
        return group == gram if len(group) > 1 else any(group[0] in w for w in gram)

    def unmet(chosen: list[tuple[str, ...]]) -> list[list[tuple[str, ...]]]:
        free = [([g for g in grams if not any(held(c, g) for c in chosen)], least) for grams, least in needs]
        return [grams for grams, least in free if len(grams) >= least]

    chosen: list[tuple[str, ...]] = []
    while left := unmet(chosen):
        uses = Counter((w,) for grams in left for g in grams for w in set(g) if len(w) > 4)
        uses = uses or Counter(g for grams in left for g in grams)
        chosen.append(max(uses, key=lambda c: (uses[c] * sum(map(len, c)) ** 2, c)))
    for c in list(chosen):
        if not unmet(others := [x for x in chosen if x != c]):
            chosen = others
    return chosen


def _candidates(templates: list[tuple[str, str]], dice: float) -> tuple[Column, int]:
    """Literal map: number of bigrams -> (license, bigrams) of the templates whose size fits; largest number in it."""
    fitting = defaultdict(list)
    for name, text in templates:
        grams = bigrams(text)
        for n in size_bounds(len(grams), dice):
            fitting[n].append(F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams")))
    return F.create_map(*[x for n in sorted(fitting) for x in (F.lit(n), F.array(*fitting[n]))]), max(fitting)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, unit (`line` or `block`), unit_no, license, dice of every unit that matches a template.

    Normalised: lower case, runs of characters other than a-z and 0-9 one blank. Units: every line of the whole text, and
    every block (lines between blank lines) of two lines or more; both count from 0. Dice coefficient: 2 * shared /
    (bigrams of the unit + bigrams of the template), on distinct bigrams. Of several templates the best one counts, then the
    licence that sorts last. Null and empty texts and units of fewer than two words match nothing; an empty table gives no
    rows; repeated rows are scanned each.
    """
    fitting, most = _candidates(TEMPLATES if templates is None else templates, dice)
    sought = probes(TEMPLATES if templates is None else templates, dice)

    def may_match(body: Column) -> Column:
        groups = (functools.reduce(operator.and_, (F.contains(body, F.lit(w)) for w in group)) for group in sought)
        return functools.reduce(operator.or_, groups, F.lit(False))

    # The array of one makes each text be lower-cased once and not once a word.
    docs = docs.filter(F.exists(F.array(F.lower("text")), may_match))
    text = F.regexp_replace(F.lower("text"), r"[^a-z0-9\n]+", " ")
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), x.alias("body")))
    whole = F.transform(F.split(text, r"\n(?: *\n)+", -1),
                        lambda x, i: F.struct(F.lit("block").alias("unit"), i.alias("unit_no"), F.replace(x, F.lit("\n"), F.lit(" ")).alias("body"), F.contains(x, F.lit("\n")).alias("many")))
    multi = F.transform(F.filter(whole, lambda b: b["many"]), lambda b: F.struct(b["unit"].alias("unit"), b["unit_no"].alias("unit_no"), b["body"].alias("body")))
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.filter(F.concat(lines, multi), lambda u: may_match(u["body"]))).alias("u"))
    # A unit of n words has n - 1 bigrams, some of them perhaps alike. Too many words are too many bigrams only where they
    # differ, so the bound on words drops nothing but units with too few.
    words = units.select("doc_id", "u.unit", "u.unit_no", F.split(F.trim("u.body"), " +").alias("w")).filter(F.size("w") >= 2)
    pairs = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.concat_ws(" ", x, y)))
    sized = words.select("doc_id", "unit", "unit_no", pairs.alias("grams")).filter(F.size("grams") <= most)
    scored = F.transform(fitting[F.size("grams")], lambda t: F.struct(
        (2.0 * F.size(F.array_intersect("grams", t["grams"])) / (F.size("grams") + F.size(t["grams"]))).alias("dice"), t["license"].alias("license")))
    best = sized.select("doc_id", "unit", "unit_no", F.array_max(scored).alias("best")).filter(F.col("best.dice") >= dice)
    return best.select("doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), "best.license", "best.dice")
