"""Readings settled in order against the loops that say what order means, on chains of three and more."""

from __future__ import annotations

import random
import re

from docspark.operators import ordered


def parts(ref):
    number = ref.split(" ", 1)[1]
    body, _, year = number.rpartition("-")
    return re.sub(r"\D", "", body), year


def lacks_a_digit(a, b):
    long, short = (a, b) if len(a) > len(b) else (b, a)
    if abs(len(a) - len(b)) != 1 or long.startswith(short):
        return False
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def loop_of_numbers(refs):
    """refs: (kind, ref, votes) in order."""
    drop = set()
    for i, (ka, ra, va) in enumerate(refs):
        if i in drop:
            continue
        ba, ya = parts(ra)
        for j in range(i + 1, len(refs)):
            kb, rb, vb = refs[j]
            bb, yb = parts(rb)
            if j in drop or ka != kb or ya != yb:
                continue
            longer = len(ba) != len(bb) and 1 <= abs(len(ba) - len(bb)) <= 2 and (ba.startswith(bb) or bb.startswith(ba))
            one = len(ba) == len(bb) and sum(x != y for x, y in zip(ba, bb, strict=True)) == 1 and ka != "ОСТ"
            lost = ka == "ГОСТ" and lacks_a_digit(ba, bb)
            if lost and not longer and not one:
                drop.add(j if len(ba) > len(bb) else i)
            elif longer or one:
                if va != vb:
                    drop.add(j if va > vb else i)
                elif len(ba) != len(bb):
                    drop.add(i if len(bb) > len(ba) else j)
    return [r for n, r in enumerate(refs) if n not in drop]


def test_numbers_in_order(spark):
    rng, rows, want = random.Random(3), [], []
    for doc in range(150):
        seen, refs = set(), []
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice(["ГОСТ", "ГОСТ", "СТБ", "ОСТ"])
            ref = f"{kind} {''.join(rng.choices('12', k=rng.randint(4, 6)))}-{rng.choice(['75', '80'])}"
            if ref not in seen:
                seen.add(ref)
                refs.append((kind, ref, rng.randint(1, 3)))
        rows += [(doc, kind, ref, votes, n) for n, (kind, ref, votes) in enumerate(refs)]
        want += [(doc, *r) for r in loop_of_numbers(refs)]
    votes = spark.createDataFrame(rows, "doc_id long, kind string, ref string, votes long, first_source long")
    got = sorted(tuple(r) for r in ordered.number_readings(votes).collect())
    assert got == sorted(want) and len(got) < len(rows)


def test_a_chain_of_three(spark):
    """The first beats the second, which so no longer beats the third; at once, both would go."""
    rows = [(1, "ГОСТ", "ГОСТ 1111-75", 3, 1), (1, "ГОСТ", "ГОСТ 1112-75", 2, 2), (1, "ГОСТ", "ГОСТ 1122-75", 1, 3), (2, "ГОСТ", "ГОСТ 1111-75", 1, 1), (2, "ГОСТ", "ГОСТ 1112-75", 2, 2), (2, "ГОСТ", "ГОСТ 1121-75", 1, 3), (3, "ТУ", "ТУ", 1, 1)]
    votes = spark.createDataFrame(rows, "doc_id long, kind string, ref string, votes long, first_source long")
    got = sorted((r["doc_id"], r["ref"]) for r in ordered.number_readings(votes).collect())
    assert got == [(1, "ГОСТ 1111-75"), (1, "ГОСТ 1122-75"), (2, "ГОСТ 1112-75"), (2, "ГОСТ 1121-75"), (3, "ТУ")]


def loop_of_years(items):
    """items: (kind, ref, votes, first) of one number."""
    def rank(it):
        year = parts(it[1])[1]
        return (-(it[2] > 0), 0 if len(year) >= 4 else 1 if len(year) == 2 else 2, -it[2], it[1].count(".") if it[0] == "ГОСТ" else 0, -len(it[1]))

    def close(a, b):
        if a == b:
            return True
        if not a or not b:
            return False
        return (len(a) != len(b) and (a.endswith(b) or b.endswith(a))) or abs(int(a) - int(b)) <= 1

    if len(items) == 1:
        return items
    by_year: dict = {}
    for it in sorted(items, key=lambda it: (it[3], it[1])):
        by_year.setdefault(parts(it[1])[1], []).append(it)
    keep = sorted((min(g, key=rank) for g in by_year.values()), key=lambda it: (rank(it), it[3]))
    if len(keep) == 1:
        return keep
    some, out = any(it[2] > 0 for it in keep), []
    for it in keep:
        if some and it[2] == 0:
            continue
        y = parts(it[1])[1]
        if not any(close(y, parts(p[1])[1]) and (it[2] < p[2] or (it[2] == p[2] and rank(it) > rank(p))) for p in out):
            out.append(it)
    return out


def test_years_in_order(spark):
    rng, rows, want = random.Random(8), [], []
    for doc in range(200):
        years = rng.sample(["75", "76", "77", "79", "1975", "1976", "1978", "2011", "2012", "11"], rng.randint(1, 7))
        items = [("СТБ", f"СТБ 1234-{y}", rng.choice([0, 0, 1, 2, 3]), n) for n, y in enumerate(years)]
        rows += [(doc, *it) for it in items]
        want += [(doc, *it[:3]) for it in loop_of_years(items)]
    votes = spark.createDataFrame(rows, "doc_id long, kind string, ref string, votes long, first_source long")
    assert sorted(tuple(r) for r in ordered.year_readings(votes).collect()) == sorted(want)
