"""Licence scans: lines and whole texts against licence templates.

A unit (a line, or the whole text) is lower-cased and cut into words of letters and
digits.  Its score against a template is the Dice coefficient of their word bigrams,
repeats counted: 2 * common / (unit's + template's).  A score of ``MIN_DICE`` or more
bounds the unit's number of bigrams on both sides, which prunes templates, and whole
units, before any bigram is made.

``find`` adds notices inside lines and over several lines: windows of words, also against
licence bodies and sibling versions.  A window of the best Dice starts and ends with a
bigram of the template, so only such windows are scored, which misses none.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.licence_texts import BODIES

MIN_DICE = 0.8
TOKEN = r"[\p{L}\p{N}]+"

# Notices of licences, by their SPDX names.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(notice: str) -> Counter:
    words = re.findall(r"[^\W_]+", notice.lower())
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def _bounds(size: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams that a unit must lie between to reach ``least`` against a template of ``size``."""
    return max(1, math.ceil(least * size / (2 - least) - 1e-9)), int((2 - least) * size / least + 1e-9)


def _templates(templates, least: float) -> tuple[Column, int, int]:
    rows = []
    for name, notice in templates:
        grams = template_bigrams(notice)
        size = sum(grams.values())
        low, high = _bounds(size, least)
        known = F.array(*[F.struct(F.lit(g).alias("gram"), F.lit(n).alias("n")) for g, n in sorted(grams.items())])
        rows.append((name, size, low, high, known))
    column = F.array(*[
        F.struct(F.lit(a).alias("licence"), F.lit(b).alias("size"), F.lit(c).alias("low"), F.lit(d).alias("high"), e.alias("grams"))
        for a, b, c, d, e in rows
    ])
    return column, min(r[2] for r in rows), max(r[3] for r in rows)


#: Words of templates that say little about a text being a licence; the last four are short words that other languages and numbers have too.
_COMMON = frozenset("a an and any are as at be been being by for from if in into is it its must no not of on or other out such that the their these they this to use was we when which will with without you your all may can make work works own one 0 1 2 3 4 5 mit nc nd sa".split())


def _need(size: int, least: float) -> int:
    """Bigrams in common, at least, of a window that reaches ``least`` against a template of ``size``."""
    return math.ceil(least * size / (2 - least) - 1e-9)


def anchors(templates, least: float = MIN_DICE) -> list[str]:
    """Words of which a text has one at least if a window in it reaches ``least`` against any template."""
    found: set[str] = set()
    for _, notice in templates:
        grams = template_bigrams(notice)
        while sum(n for g, n in grams.items() if found.isdisjoint(g.split())) >= _need(sum(grams.values()), least):
            open_ = Counter(w for g, n in grams.items() if found.isdisjoint(g.split()) for w in set(g.split()) for _ in range(n))
            found.add(min(open_, key=lambda w: (w in _COMMON, -open_[w], w)))
    return sorted(found)


def anchor_test(templates, least: float = MIN_DICE):
    """A test of texts that every text passes which any template matches."""
    words = "|".join(anchors(templates, least))
    return lambda text: text.rlike(r"(?iu)(?<![\p{L}\p{N}])(?:" + words + r")(?![\p{L}\p{N}])")


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, least: float = MIN_DICE) -> DataFrame:
    """``docs`` with ``matches``: array of (licence, dice, line, notice), best first.

    ``line`` counts from 0; -1 is the whole text, which is a unit of its own where the
    text has several lines.  Ties go to the earlier line, then to the licence's name.
    Null and empty texts match nothing.  All work stays in the row: repeated rows, null
    keys and other columns pass through; an input column ``matches`` is replaced.
    """
    whole = F.coalesce("text", F.lit(""))
    found = F.when(anchor_test(templates, least)(whole), _units(whole, templates, least)).otherwise(_no_matches())
    return _unpacked(_packed(docs, text).withColumn("matches", found), docs)


def _units(whole: Column, templates, least: float) -> Column:
    known, fewest, most = _templates(templates, least)
    lines = F.split(whole, "\n")
    holds = anchor_test(templates, least)
    # Few units hold an anchor.  Of these, words, not bigrams, bound the size: no string is made for a unit that is too short or too long.
    fits = lambda s: holds(s) & F.regexp_count(s, F.lit(TOKEN)).between(fewest + 1, most + 1)
    unit = lambda s, i: F.struct(i.cast("int").alias("line"), s.alias("notice"))
    units = F.filter(F.transform(lines, unit), lambda u: fits(u["notice"]))
    both = F.when(F.contains(whole, F.lit("\n")) & fits(whole), F.concat(F.array(unit(whole, F.lit(-1))), units)).otherwise(units)

    def bigrams(u: Column) -> Column:
        words = F.regexp_extract_all(F.lower(u["notice"]), F.lit(TOKEN), F.lit(0))
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.struct(u["line"].alias("line"), u["notice"].alias("notice"), pairs.alias("pairs"))

    def score(u: Column, t: Column) -> Column:
        times = lambda g: F.size(F.filter(u["pairs"], lambda p: p == g["gram"]))
        common = F.aggregate(t["grams"], F.lit(0), lambda total, g: total + F.least(g["n"], times(g)))
        dice = F.lit(2.0) * common / (F.size(u["pairs"]) + t["size"])
        return F.struct((-dice).alias("dice"), u["line"].alias("line"), t["licence"].alias("licence"), u["notice"].alias("notice"))

    def against(u: Column) -> Column:
        near = F.filter(known, lambda t: F.size(u["pairs"]).between(t["low"], t["high"]))
        return F.filter(F.transform(near, lambda t: score(u, t)), lambda m: m["dice"] <= -least)

    found = F.array_sort(F.flatten(F.transform(F.transform(both, bigrams), against)))
    as_match = lambda m: F.struct(m["licence"].alias("licence"), (-m["dice"]).alias("dice"), m["line"].alias("line"), m["notice"].alias("notice"))
    return F.transform(found, as_match)


def _no_matches() -> Column:
    return F.array().cast("array<struct<licence: string, dice: double, line: int, notice: string>>")


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """The rows as one column beside the text, so that no helper column can clash with theirs."""
    return docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "matches"), "matches")


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window_templates(templates, least: float) -> Column:
    rows = []
    for at, (name, notice) in enumerate(templates):
        grams = sorted(template_bigrams(notice).items())
        size = sum(n for _, n in grams)
        need = _need(size, least)
        rows.append(F.struct(
            F.lit(name).alias("licence"), F.lit(at).alias("at"), F.lit(size).alias("size"), F.lit(int((2 - least) * size / least + 1e-9)).alias("high"),
            F.lit(max(1, need - size + len(grams))).alias("need"),
            F.array(*[F.xxhash64(*map(F.lit, g.split())) for g, _ in grams]).alias("grams"),
            F.array(*[F.lit(n) for _, n in grams]).alias("n"),
        ))
    return F.array(*rows)


def _windows(pairs: Column, t: Column, least: float) -> Column:
    """For each bigram of the template in the text, the best window from there: (score, start, at, dice, end, licence), if good enough."""
    placed = F.transform(pairs, lambda h, i: F.struct(i.alias("i"), F.array_position(t["grams"], h).cast("int").alias("k")))

    def back(hits: Column) -> Column:
        # Where a window must start so that this hit is one too many of its bigram.
        def of(x: Column, i: Column) -> Column:
            before = F.filter(F.slice(hits, F.greatest(F.lit(1), i - t["high"] + 1), F.least(i, t["high"])), lambda y: y["k"] == x["k"])
            n = F.element_at(t["n"], x["k"])
            return F.struct(x["i"].alias("i"), F.coalesce(F.get(before, F.size(before) - n)["i"], F.lit(-1)).alias("back"))

        return F.transform(hits, of)

    def starts(hits: Column) -> Column:
        def best(x: Column, i: Column) -> Column:
            counted = F.filter(F.slice(hits, i + 1, t["high"]), lambda y: (y["i"] < x["i"] + t["high"]) & (y["back"] < x["i"]))

            def upto(y: Column, m: Column) -> Column:
                dice = F.lit(2.0) * (m + 1) / (y["i"] - x["i"] + 1 + t["size"])
                return F.struct(dice.alias("dice"), (m + 1).alias("m"), y["i"].alias("end"))

            top = F.array_max(F.transform(counted, upto))
            as_window = lambda b: F.struct(
                (-b["dice"] * b["m"]).alias("score"), x["i"].alias("start"), t["at"].alias("at"), b["dice"].alias("dice"), b["end"].alias("end"), t["licence"].alias("licence")
            )
            return _let(top, as_window)

        return F.filter(F.transform(hits, best), lambda w: w["dice"] >= least)

    return _let(_let(F.filter(placed, lambda x: x["k"] > 0), back), starts)


_WINDOW = "struct<licence: string, dice: double, line: int, last: int, notice: string>"


def _spans(text: Column, templates, least: float) -> Column:
    """Windows of ``text`` (licence, dice, line, last, notice) that no better window overlaps.

    Better is a higher Dice times bigrams in common, so a body goes before a notice in it.
    """
    known = _window_templates(templates, least)
    every_gram = sorted({g for _, notice in templates for g in template_bigrams(notice)})
    grams = F.array(*[F.xxhash64(*map(F.lit, g.split())) for g in every_gram])

    def spans(chunks: Column) -> Column:
        words = F.transform(chunks, lambda c: F.regexp_extract(F.lower(c), TOKEN, 0))
        pairs = _let(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b)))

        def found(p: Column) -> Column:
            # The text's bigrams meet those of all templates once; each template then sees these few.
            near = _let(F.array_intersect(p, grams), lambda hits: F.filter(known, lambda t: F.size(F.array_intersect(t["grams"], hits)) >= t["need"]))
            every = F.array_sort(F.flatten(F.transform(near, lambda t: _windows(p, t, least))))
            none = F.slice(every, F.lit(1), F.lit(0))
            apart = lambda kept, w: ~F.exists(kept, lambda k: (k["start"] <= w["end"] + 1) & (w["start"] <= k["end"] + 1))
            return _let(every, lambda e: F.aggregate(e, none, lambda kept, w: F.when(apart(kept, w), F.concat(kept, F.array(w))).otherwise(kept)))

        lead = F.regexp_extract(text, r"^[^\p{L}\p{N}]*", 0)
        breaks = lambda n: F.regexp_count(F.concat(lead, F.array_join(F.slice(chunks, F.lit(1), n), "")), F.lit("\n"))

        def shown(w: Column) -> Column:
            notice = F.array_join(F.slice(chunks, w["start"] + 1, w["end"] - w["start"] + 2), "")
            notice = F.regexp_replace(notice, r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+$", "")
            inside = F.regexp_count(notice, F.lit("\n"))
            return F.struct(w["licence"].alias("licence"), w["dice"].alias("dice"), breaks(w["start"]).alias("line"), (breaks(w["start"]) + inside).alias("last"), notice.alias("notice"))

        return F.transform(_let(pairs, found), shown)

    chunks = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+[^\p{L}\p{N}]*"), F.lit(0))
    several = lambda c: F.when(F.size(c) > 1, spans(c)).otherwise(F.array().cast(f"array<{_WINDOW}>"))
    return _let(chunks, several)


def find(docs: DataFrame, text: str = "text", templates=TEMPLATES, bodies=BODIES, least: float = MIN_DICE) -> DataFrame:
    """``scan`` with notices that are no unit of their own: inside a longer line, wrapped over lines, whole bodies.

    Such a match has the line that it begins in.  It is left out where a unit there names
    the same licence already; units that name other licences only give way to it.  Of windows
    that overlap, the one of the highest Dice times bigrams in common stays; ties go to the
    earlier, then to the earlier template.  ``bodies`` has licences of many pages by their
    opening passage and their notices only: a later section on its own is not found, unless the
    caller adds it as a template.  Nulls, repeated rows and other columns as in ``scan``.
    """
    every = (*templates, *bodies)
    given = F.coalesce("text", F.lit(""))
    touch = lambda m, w: (m["line"] == -1) | m["line"].between(w["line"], w["last"])

    def merged(units: Column, windows: Column) -> Column:
        named = lambda m, w: F.exists(units, lambda o: (o["line"] == m["line"]) & (o["licence"] == w["licence"]))
        stays = lambda m: _let(F.filter(windows, lambda w: touch(m, w)), lambda at: (F.size(at) == 0) | F.exists(at, lambda w: named(m, w)))

        def both(left: Column) -> Column:
            new = F.filter(windows, lambda w: ~F.exists(left, lambda m: touch(m, w) & (m["licence"] == w["licence"])))
            as_key = lambda m: F.struct((-m["dice"]).alias("dice"), m["line"].alias("line"), m["licence"].alias("licence"), m["notice"].alias("notice"))
            return F.array_sort(F.concat(F.transform(left, as_key), F.transform(new, as_key)))

        as_match = lambda m: F.struct(m["licence"].alias("licence"), (-m["dice"]).alias("dice"), m["line"].alias("line"), m["notice"].alias("notice"))
        return F.transform(_let(F.filter(units, stays), both), as_match)

    # A text without an anchor of any template has neither.
    likely = _packed(docs, text).withColumn("likely", anchor_test(every, least)(given))
    parts = likely.select("row", F.when(F.col("likely"), F.struct(_units(given, templates, least).alias("units"), _spans(given, every, least).alias("windows"))).alias("parts"))
    units, windows = F.col("parts.units"), F.col("parts.windows")
    whole = F.when(F.size(windows) > 0, _let(units, lambda u: merged(u, windows))).otherwise(F.coalesce(units, _no_matches()))
    return _unpacked(parts.withColumn("matches", whole), docs)
