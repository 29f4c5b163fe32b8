"""Licence matches against a plain version, on planted texts."""

import random
import re
import textwrap
from collections import Counter

from topicloom.llm import licence_texts, licences

WORD = re.compile(r"[^\W_]+")
LEAST = licences.MIN_DICE


def grams_of(words):
    return Counter(zip(words, words[1:]))


def dice_of(found, known):
    return 2.0 * sum((found & known).values()) / (sum(found.values()) + sum(known.values()))


def plain_units(text, templates):
    lines = text.split("\n")
    units = [(i, line) for i, line in enumerate(lines)] + ([(-1, text)] if len(lines) > 1 else [])
    found = []
    for line, unit in units:
        own = grams_of(WORD.findall(unit.lower()))
        for name, notice in templates:
            dice = dice_of(own, grams_of(WORD.findall(notice.lower()))) if own else 0
            if dice >= LEAST:
                found.append((name, dice, line, unit))
    return found


def plain_windows(text, templates):
    """Every window of words against every template; of those that overlap the best stays."""
    places = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    words = [w for _, _, w in places]
    pairs = list(zip(words, words[1:]))
    best = []
    for at, (name, notice) in enumerate(templates):
        known = grams_of(WORD.findall(notice.lower()))
        size = sum(known.values())
        for i, first in enumerate(pairs):
            if first not in known:
                continue
            seen, common, top = Counter(), 0, None
            for j in range(i, min(len(pairs), i + int((2 - LEAST) * size / LEAST + 1e-9))):
                seen[pairs[j]] += 1
                common += seen[pairs[j]] <= known[pairs[j]]
                top = max(top or (0.0, 0, 0), (2.0 * common / (j - i + 1 + size), common, j))
            if top[0] >= LEAST:
                best.append((-top[0] * top[1], i, at, top[0], top[2], name))
    kept = []
    for w in sorted(best):
        if all(w[1] > k[4] + 1 or k[1] > w[4] + 1 for k in kept):
            kept.append(w)
    out = []
    for _, i, _, dice, j, name in kept:
        start, end = places[i][0], places[j + 1][1]
        out.append((name, dice, text[:start].count("\n"), text[:end].count("\n"), text[start:end]))
    return out


def plain_find(text, templates, bodies):
    units, windows = plain_units(text, templates), plain_windows(text, (*templates, *bodies))

    def touch(unit, w):
        return unit[2] == -1 or w[2] <= unit[2] <= w[3]

    left = []
    for u in units:
        at = [w for w in windows if touch(u, w)]
        if not at or any(o[2] == u[2] and o[0] == w[0] for w in at for o in units):
            left.append(u)
    new = [(w[0], w[1], w[2], w[4]) for w in windows if not any(touch(u, w) and u[0] == w[0] for u in left)]
    return sorted((-round(d, 12), line, name, notice) for name, d, line, notice in (*left, *new))


def planted(n, seed):
    rng = random.Random(seed)
    every = [x for x in (*licences.TEMPLATES, *licence_texts.BODIES) if len(x[1]) < 500]
    prose = "Some words stand here under a tree and nothing else is said of any licence.".split()
    filler = lambda k: " ".join(rng.choice(prose) for _ in range(k))
    for _ in range(n):
        notice = rng.choice(every)[1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            at = rng.randrange(len(notice))
            edit = rng.random()
            if edit < 0.4:
                del notice[at : at + 1]
            elif edit < 0.7:
                notice.insert(at, rng.choice(prose))
            else:
                notice[at] = rng.choice(prose)
        middle = " ".join(notice)
        if rng.random() < 0.2:
            middle += " " + rng.choice(every)[1]
        if rng.random() < 0.3:
            middle = middle.upper()
        kind = rng.random()
        if kind < 0.3:
            text = filler(rng.randint(0, 12)) + " " + middle + " " + filler(rng.randint(0, 12))
        elif kind < 0.7:
            text = filler(8) + "\n" + textwrap.fill(middle, rng.choice((30, 50, 70))) + "\n\n" + filler(8)
        else:
            text = filler(5) + "\n* " + middle + "\n" + filler(5)
        yield text


def test_planted_texts_equal_plain_windows(spark):
    texts = [*planted(240, 11), "", "under the license", "license " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    seen = 0
    for r in licences.find(docs).collect():
        found = sorted((-round(m.dice, 12), m.line, m.licence, m.notice) for m in r.matches)
        assert found == plain_find(texts[r.i], licences.TEMPLATES, licence_texts.BODIES), texts[r.i]
        seen += len(found)
    assert seen > 150


def test_row_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 5, "a"), (2, None, 6, "b")], "id int, text string, row int, likely string")
    found = {r.id: r for r in licences.find(docs).collect()}
    assert found[1].matches[0].licence == "MIT" and found[1].row == 5 and found[2].matches == [] and found[2].likely == "b"
