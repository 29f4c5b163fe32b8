import random
import textwrap

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from check import compare
from tests_llm_cases import ODD_SQL
from topicloom.llm import bpe, catalogue, licence_texts, licences, quality_rules

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ODD_SQL)
def test_odd_rows_equal_sql(spark, odd_tables, name):
    folder, con = odd_tables
    ours = catalogue.QUERIES[name](spark, folder).toPandas()
    assert compare(ours, con.sql(catalogue.ORACLES[name]).df()).startswith("OK")


def test_ledger_keeps_rows_and_columns(odd, none):
    found = quality_rules.ledger(odd)
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].n_words == 0 and by[1].fail_bits & 1
    assert by[9].n_dup_lines == 2 and by[9].n_symbols == 8
    assert quality_rules.ledger(none).count() == 0 and quality_rules.keep(none).columns == odd.columns


def test_policies_and_ablations(odd):
    found = quality_rules.ledger(odd).persist()
    masks = [r.fail_bits for r in found.collect()]
    assert quality_rules.keep(odd, "base-1").count() == sum(m & 3 == 0 for m in masks)
    bits = {r.name: 1 << r.bit for r in quality_rules.RULES}
    for r in quality_rules.ablations(found).collect():
        mask = quality_rules.POLICIES[r.policy]
        assert r.rejected == sum(m & mask != 0 for m in masks)
        assert r.by_rule == sum(m & bits[r.rule] != 0 for m in masks)
        assert r.by_rule_alone == sum(m & mask == bits[r.rule] for m in masks)


def test_codec_equals_library():
    rng = random.Random(1)
    texts = ["", "a" * 3000, "don't we'll I'M x<|endoftext|>y <|startoftext|><|endoftext|", "ΟΔΟΣ İẞ ﬁ \x1c\x85 ½ 日本語 👍🏽"]
    texts += ["".join(rng.choice("abcdehistnor'. tTéß1́\U0001f600<|>") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    known, codec = Tokenizer.from_file(PATH), bpe.codec(PATH)
    for text in texts:
        ids = known.encode(text, add_special_tokens=False).ids
        own = codec.encode(text)
        assert np.frombuffer(own, "<u4").tolist() == ids, text
        assert bpe.decode_ids(own, PATH) == known.decode(ids, skip_special_tokens=False)


def test_codec_on_odd_rows(odd, none):
    known = Tokenizer.from_file(PATH)
    for r in bpe.decode(bpe.encode(odd, PATH), PATH).select("text", "ids", "decoded").collect():
        ids = known.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == known.decode(ids, skip_special_tokens=False)
    both = [bpe.decode(bpe.encode(odd, PATH), PATH), bpe.round_trip(odd, PATH)]
    assert sorted(map(str, both[0].select("ids", "decoded").collect())) == sorted(map(str, both[1].select("ids", "decoded").collect()))
    assert bpe.decode(bpe.encode(none, PATH), PATH).count() == 0 and bpe.round_trip(none, PATH).count() == 0


def test_licence_spans(odd, none):
    found = {r.doc_id: r.matches for r in licences.scan(odd).collect()}
    assert [(m.licence, m.line) for m in found[10]] == [("Apache-2.0", 0), ("MIT", 1)]
    assert all(m.dice == 1.0 for m in found[10]) and found[1] == [] and found[7] == []
    assert licences.scan(none).count() == 0


def test_licence_size_bounds_lose_nothing(spark):
    notice = licences.TEMPLATES[4][1]
    words = notice.split()
    texts = [" ".join(words[:n]) for n in range(len(words) + 1)] + [notice + " more" * n for n in range(9)]
    rows = licences.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    own = licences.template_bigrams(notice)
    for r in rows:
        grams = licences.template_bigrams(r.text)
        size = sum(grams.values())
        dice = 2 * sum((grams & own).values()) / max(1, size + sum(own.values()))
        assert (dice >= 0.8) == any(m.licence == "GPL-3.0" for m in r.matches)


def test_licences_inline_wrapped_bodies_and_versions(spark):
    prose = "Some words stand here and nothing else is said.\n"
    mit = licences.TEMPLATES[1][1]
    full = lambda name: next(t for n, t in licence_texts.BODIES if n == name)
    cases = [
        ("Copyright 2020 Foo Inc. All rights reserved. Released under the MIT License.", "MIT", 0),
        (prose + textwrap.fill(mit, 72) + "\n" + prose, "MIT", 1),
        (full("MIT"), "MIT", 0),
        (prose * 3 + textwrap.fill(full("MIT"), 80) + "\n" + prose, "MIT", 3),
        (textwrap.fill("Copyright Foo. " + full("BSD-2-Clause"), 76), "BSD-2-Clause", 0),
        (full("BSD-3-Clause").replace("met: ", "met:\n"), "BSD-3-Clause", None),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0", 0),
        ("We say: licensed under CC BY-NC 3.0. And so on, for ever and ever, in many more words.", "CC-BY-NC-3.0", 0),
        (prose * 9 + textwrap.fill(full("GPL-2.0"), 70), "GPL-2.0", 9),
        (prose * 5, None, None),
        ("", None, None),
        (None, None, None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, text string")
    found = {r.i: r.matches for r in licences.find(docs).collect()}
    for i, (_, name, line) in enumerate(cases):
        assert (found[i][0].licence if found[i] else None) == name, (i, found[i])
        assert line is None or found[i][0].line == line
    assert found[0][0].notice == "Released under the MIT License" and len(found[0]) == 1


def test_licence_anchors_cover_every_window():
    known = (*licences.TEMPLATES, *licence_texts.BODIES)
    words = set(licences.anchors(known))
    for _, notice in known:
        grams = licences.template_bigrams(notice)
        size = sum(grams.values())
        free = sum(n for g, n in grams.items() if words.isdisjoint(g.split()))
        assert 2 * free / (free + size) < licences.MIN_DICE
