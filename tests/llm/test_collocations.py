"""Collocations against counted lists of words; bitmaps against sets of places; tiny tables, bundles and shards."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import collocations
from llm.collocations import Bitmaps

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, n long"


def brute(rows, longest=5, least=100, top=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, of in count.items():
        of = {p: a for p, a in of.items() if a >= least}
        held = set()
        for p, a in of.items():
            for k in range(2, len(p)):
                held |= {p[i : i + k] for i in range(len(p) - k + 1) if a >= of[p[i : i + k]]}
        found = []
        for p, a in of.items():
            if len(p) > 1 and p not in held:
                score, k = min((1000 * a * total[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def spoken(seed, count, words="abcdefg"):
    rng, out = random.Random(seed), []
    phrases = [" ".join(rng.choices(words, k=rng.randint(2, 7))) for _ in range(5)]
    for _ in range(count):
        parts = [rng.choice(phrases) if rng.random() < 0.4 else rng.choice(words) + rng.choice(["", "", ".", ", ", "\n", "\t", "!x"]) for _ in range(rng.randint(0, 60))]
        out.append((" ".join(parts), rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return out


@pytest.mark.parametrize(("least", "longest", "top"), [(5, 5, 2000), (12, 4, 7), (1, 3, 50), (9, 2, 9), (60, 8, 2000)])
def test_collocations_equal_brute_force(spark, least, longest, top):
    rows = spoken(least, 150) + [(None, "en"), ("", "fr"), (" .,\n", None), ("The Élan THE Élan the élan", "fr"), ("a b c d e " * 3000, "en")]
    df = spark.createDataFrame([(i % 9, *r, "p", 1, 2) for i, r in enumerate(rows)], SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, longest, least, top, collocations.Sizes(20, 3000, 40)).collect())
    assert got == brute(rows, longest, least, top) and got


@pytest.mark.parametrize("cells", [6, 9])
def test_a_full_table_costs_rows_only(spark, cells):
    rows = spoken(2, 80, "abcdefghijklmnopqrstuvwxyz")
    df = spark.createDataFrame([(1, *r, "p", 1, 2) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in collocations.collocations(df, least=8, sizes=collocations.Sizes(cells)).collect()) == brute(rows, least=8)


def test_nothing_is_frequent(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b", "en", "", 1, 1)], SCHEMA)).count() == 0


def test_products_may_pass_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 7)], "lang string, phrase string, a long")
    row = collocations.scored(phrases, spark.createDataFrame([("en", 10**14)], "lang string, n long")).collect()
    assert [r["score"] for r in row] == [1000 * (big - 7) * 10**14 // (big * (big - 1))]


def test_bitmaps():
    rng = np.random.default_rng(5)
    places = np.sort(rng.choice(900, 500, replace=False))
    items = rng.integers(0, 6, 500)
    one = Bitmaps.of(places, items)
    sets = lambda b: {(int(i), int(k) * 16 + j) for k, i, v in zip(b.block, b.item, b.bits, strict=True) for j in range(16) if v >> j & 1}
    assert sets(one) == set(zip(items.tolist(), places.tolist(), strict=True)) and (one.bits > 0).all()
    assert sets(one.shifted()) == {(i, p + 1) for i, p in sets(one)}
    left, right, common = one.shifted().anded(one, one.begins(60))
    got = {(int(a), int(b), int(k) * 16 + j) for a, b, k, v in zip(left, right, common.block, common.bits, strict=True) for j in range(16) if v >> j & 1}
    assert got == {(a, b, p) for a, p in sets(one.shifted()) for b, q in sets(one) if p == q}
