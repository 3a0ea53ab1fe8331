"""License scans: normalised text against license templates by Dice over word bigrams.

The units compared are the lines of a text and the text as a whole.  With n bigrams in a unit
(repeats included), b distinct ones in a template and s shared ones, Dice is 2 s / (n + b).
Only templates whose size lies within the bounds that the threshold puts on n are compared.
At least two thirds (for a threshold of 0.8) of a template's bigrams must be shared, so a
unit must hold one of any words that touch more than a third of them; texts and lines
without such an anchor word are ruled out exactly.  Everything is one
projection in DataFrame expressions, without a shuffle.

Whole licenses (``TEXTS``) are wrapped over many lines, often above other text.  Each is compared
with the windows of the text that begin at one of its bigrams and have as many bigrams as it has
itself; the window may be cut short by the end of the text.  Long texts repeat themselves, so
here Dice is that of the distinct bigrams of both.  Only windows that hold enough bigrams of the
license are compared, which leaves nothing out.  A text has one match at most for each license, told under unit 0; the
best of these goes before all notices, since licenses hold some of them.  Notices of
``WRAPPED`` bigrams or more are sought in windows, too, for they may be wrapped over lines; such
a match is told under unit 0, unless a line matches a notice much like it (Dice of ``ALIKE``).

Sizes are bounded first: by its length a text too short for two thirds of a license is never
compared with it.  Defined results: null and empty text has no unit; units of fewer than two words have no
bigram and match nothing; equal scores go to the template that comes first by name; texts of
any length are compared whole; an empty table gives no rows; other columns, whatever their
names, are passed over; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Bigrams from which a notice is long enough to be wrapped.
WRAPPED, ALIKE = 12, 0.6
# Short notices by which public licenses are declared, and two of their texts.
TEMPLATES = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "arr-notice": "All rights reserved.",
    "bsd-3-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}
#: Whole licenses and the blocks of lines that files carry, by name.
TEXTS = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal(text: str) -> list[str]:
    """Words of the normalised text."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip().split(" ")


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text, in order."""
    w = normal(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors(grams: list[str], low: float) -> list[str]:
    """Words, longest first, that touch more bigrams than a match can miss."""
    out: list[str] = []
    for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
        out.append(w)
        if sum(any(x in out for x in g.split(" ")) for g in grams) > (1 - low) * len(grams) + 1e-9:
            break
    return out


def common(grams: list[str], low: float, given: list[str]) -> list[str]:
    """Few words that with the given ones touch more bigrams than a match can miss; long words if they suffice."""
    out: list[str] = []
    left = [w for w in (set(g.split(" ")) for g in grams) if not any(x in w for x in given)]
    while len(grams) - len(left) <= (1 - low) * len(grams) + 1e-9:
        count: dict[str, int] = {}
        for g in left:
            for w in g:
                count[w] = count.get(w, 0) + 1
        out.append(max(count, key=lambda w: (len(w) >= 7, count[w], w)))
        left = [g for g in left if out[-1] not in g]
    return out


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", whole: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_units (matching units), license (best template or null), dice, matches (unit:template, in order).

    Units are numbered from 1 by line; the whole text is unit 0, and so are its windows that match whole licenses.
    """
    whole = (TEXTS if templates is None else {}) if whole is None else whole
    grams = {k: bigrams(t) for k, t in sorted((TEMPLATES if templates is None else templates).items())}
    grams = {k: g for k, g in grams.items() if g}
    # one pass makes ASCII letters lower; expressions below are evaluated line by line or license by license
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()).alias("text"))
    text = F.col("text")
    low = threshold / (2 - threshold)
    marks = sorted({w for g in grams.values() for w in anchors(g, low)})
    # a word that holds another one says nothing more
    marks = [w for w in marks if not any(x != w and x in w for x in marks)]

    def anchored(u: Column) -> Column:
        return reduce(lambda a, w: a | F.contains(u, F.lit(w)), marks, F.lit(False))

    def words(u: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")), " ")

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    def best(g: Column) -> Column:
        """The best (dice, name) of one unit's bigrams, null below the threshold."""
        scores = []
        for name, t in grams.items():
            n = F.size(g)
            inside = (n >= len(t) * low - 1e-9) & (n <= len(t) / low + 1e-9)
            dice = F.size(F.array_intersect(g, F.array(*map(F.lit, t)))) * 2.0 / (n + F.lit(len(t)))
            scores.append(F.when(inside, F.struct(dice.alias("dice"), F.lit(name).alias("name"))))
        scores = F.array(*scores) if scores else F.array().cast("array<struct<dice:double,name:string>>")
        return F.aggregate(scores, F.lit(None).cast("struct<dice:double,name:string>"), lambda a, s: F.when(s.isNotNull() & (s["dice"] >= threshold) & (a.isNull() | (s["dice"] > a["dice"])), s).otherwise(a))

    match = "struct<unit:int,b:struct<dice:double,name:string>>"

    def window(name: str, body: str, g: Column) -> Column:
        """The best window of a text's bigrams for one whole license, null below the threshold."""
        t, n = bigrams(body), len(normal(body)) - 1
        grams, need = F.split(F.lit(",".join(t)), ","), max(1, math.ceil(low * len(t) - 1e-9))

        def best_of(starts: Column) -> Column:
            dice = lambda v: F.size(F.array_intersect(v, grams)) * 2.0 / (F.size(v) + F.lit(len(t)))
            return F.array_max(F.transform(starts, lambda p: _let(F.array_distinct(F.slice(g, p + 1, F.lit(n))), dice)))

        hits = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(grams, x), i)), lambda p: p.isNotNull())
        starts = _let(hits, lambda h: F.filter(h, lambda p, j: F.coalesce(F.get(h, j + need - 1) - p < n, F.lit(False))))
        top = F.when((F.length(text) >= least_size[name]) & (F.size(F.array_intersect(g, grams)) >= need), _let(starts, best_of))
        return _let(top, lambda d: F.when(d >= threshold, F.struct(F.lit(0).alias("unit"), F.struct(d.alias("dice"), F.lit(name).alias("name")).alias("b"))))

    bodies = {k: v for k, v in sorted(whole.items()) if bigrams(v)}
    notices = {k: v for k, v in sorted((TEMPLATES if templates is None else templates).items()) if len(bigrams(v)) >= WRAPPED and k not in bodies}
    every = bodies | notices
    # a match holds so many code points at least: distinct bigrams begin at distinct words
    least_size = {k: sum(sorted(len(g.split(" ")[0]) + 1 for g in bigrams(v))[: math.ceil(low * len(bigrams(v)) - 1e-9)]) for k, v in every.items()}

    def windows(of: dict[str, str]) -> Column:
        """Matches of these licenses in windows; few texts come as far as words."""
        # from the least size up, each license adds the words that those before it lack
        signs: list[tuple[int, list[str]]] = []
        for k in sorted(of, key=lambda k: (least_size[k], k)):
            signs.append((least_size[k], common(bigrams(of[k]), low, [w for _, ws in signs for w in ws])))
        may = reduce(lambda a, x: a | ((F.length(text) >= x[0]) & reduce(lambda b, w: b | F.contains(text, F.lit(w)), x[1], F.lit(False))), [x for x in signs if x[1]], F.lit(False))
        found = _let(pairs(words(text)), lambda g: F.filter(F.array(*(window(k, v, g) for k, v in of.items())), lambda x: x.isNotNull()))
        return F.coalesce(F.when(may, found).cast(f"array<{match}>"), none) if of else none

    none = F.array().cast(f"array<{match}>")
    units = F.transform(F.concat(F.array(text), F.split(text, "\n", -1)), lambda u, i: F.struct(i.alias("unit"), u.alias("u")))
    units = F.filter(units, lambda x: anchored(x["u"]))
    units = F.transform(units, lambda x: F.struct(x["unit"].alias("unit"), pairs(words(x["u"])).alias("g")))
    scored = F.transform(units, lambda x: F.struct(x["unit"].alias("unit"), best(x["g"]).alias("b")))
    kept = F.when(anchored(text), F.filter(scored, lambda x: x["b"].isNotNull()))
    found = docs.select("doc_id", F.coalesce(kept, none).alias("small"), windows(bodies).alias("large"), windows(notices).alias("wrapped"))
    # a line says where it is; and what a license holds needs no notice of its own
    like = [f"{a}|{b}" for a in notices for b in grams if 2 * len(set(grams[a]) & set(grams[b])) >= ALIKE * (len(grams[a]) + len(grams[b]))]
    told = lambda x: F.exists("small", lambda y: F.array_contains(F.array(*map(F.lit, like)), F.concat_ws("|", x["b"]["name"], y["b"]["name"])))
    fresh = F.when((F.size("large") == 0) & (F.size("wrapped") > 0), F.filter("wrapped", lambda x: ~told(x)))
    found = found.withColumn("wrapped", F.coalesce(fresh, none))
    found = found.select("doc_id", F.concat("large", "wrapped", "small").alias("m"), F.when(F.size("large") > 0, F.col("large")).otherwise(F.concat("wrapped", "small")).alias("first"))
    top = F.aggregate("first", F.lit(None).cast("struct<dice:double,name:string>"), lambda a, x: F.when(a.isNull() | (x["b"]["dice"] > a["dice"]) | ((x["b"]["dice"] == a["dice"]) & (x["b"]["name"] < a["name"])), x["b"]).otherwise(a))
    found = found.select("doc_id", "m", top.alias("top"))
    return found.select(
        "doc_id", F.size("m").cast("bigint").alias("n_units"), F.col("top.name").alias("license"), F.col("top.dice").alias("dice"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["unit"].cast("string"), x["b"]["name"])), ",").alias("matches"),
    )
