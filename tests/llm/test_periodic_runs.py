"""Periodic runs against loops over all periods, on texts of few words, on odd rows and on the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from llm import periodic_runs, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, whole string, runs int, start long, key_id long"


def brute(words, least_length=24, least_periods=3):
    """Every maximal stretch of each period, shortest first; a multiple of a period seen on the same words is none."""
    n, out = len(words), []
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least_length, least_periods * q) and not any(q % p == 0 and s <= i and s + m >= i + length for s, m, p in out):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def digests(words):
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def looped(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def texts_with_runs(seed, count):
    rng, out = random.Random(seed), []
    for _ in range(count):
        words = []
        while rng.random() < 0.8:
            kind = rng.random()
            if kind < 0.5:
                unit = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
                whole = unit * rng.randint(1, 8)
                words += whole[: max(1, len(whole) - rng.randint(0, 3))]
            elif kind < 0.6 and words:
                words += words[-rng.randint(1, len(words)) :]
            else:
                words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("length", "periods"), [(24, 3), (4, 2), (10, 2), (6, 3), (9, 4)])
def test_runs_equal_brute_force(length, periods):
    from llm.common import Words

    texts = texts_with_runs(length, 300) + ["", "a", "a " * 50, "a b " * 30 + "a"]
    data = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    got = periodic_runs.runs_of(words, length, periods)
    assert got == [brute(t.split(), length, periods) for t in texts]


def test_vocabulary_is_whole():
    """A start for each different square of a primitive half, and none twice."""
    for text in texts_with_runs(7, 200) + ["abababab", "aabaabaab", "mississippi"]:
        x = np.r_[[ord(c) for c in text.replace(" ", "")], 10**6].astype(np.int64)
        tree = periodic_runs.SuffixTree(x)
        got = [tuple(x[i : i + 2 * k].tolist()) for i, k in zip(*periodic_runs.vocabulary(tree), strict=True)]
        assert len(got) == len(set(got))
        n, want = len(x), set()
        for i in range(n):
            for k in range(1, (n - i) // 2 + 1):
                w = x[i : i + k].tolist()
                if w == x[i + k : i + 2 * k].tolist() and not any(k % d == 0 and w == w[:d] * (k // d) for d in range(1, k)):
                    want.add(tuple(w + w))
        assert set(got) == want


def test_blocks_are_the_parse():
    for text in texts_with_runs(3, 50):
        x = np.r_[[ord(c) for c in text.replace(" ", "")], 10**6].astype(np.int64)
        starts, raw = periodic_runs.blocks(periodic_runs.SuffixTree(x)).tolist(), "".join(chr(c % 1000) for c in x)
        for a, b in zip(starts, [*starts[1:], len(raw)], strict=True):
            assert b - a == 1 or raw.find(raw[a:b]) < a
            assert b == len(raw) or raw.find(raw[a : b + 1]) == a


def test_runs_of_odd_rows(spark):
    long = " ".join(f"x{i % 9000}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, "b\tc\x0b" * 12), (6, long), (7, "a " * 30_000), (8, ("u v w " * 9 + "z ") * 4), (9, "word")]
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = {(r["doc_id"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"])) for r in periodic_runs.periodic_runs(docs).collect()}
    want = {(i, tuple(brute(WORD.findall(t or "")))) for i, t in rows if i not in (6, 7)} | {(6, ((0, 30_000, 9000),)), (7, ((0, 30_000, 1),))}
    assert got == want and periodic_runs.run_digests(docs).count() == len(rows)
    out = [(r["doc_id"], r["text"], r["whole"], r["key_id"]) for r in periodic_runs.collapsed(docs).collect()]
    assert sorted(out, key=repr) == sorted(((i, {4: t, 5: "a", 7: "a", None: "b\tc"}.get(i, t), "w", 3) if i not in (6, 8) else (i, next(o[1] for o in out if o[0] == i), "w", 3) for i, t in rows), key=repr)
    assert next(o[1] for o in out if o[0] == 6).split() == [f"x{i}" for i in range(9000)]
    none = spark.createDataFrame([], SCHEMA)
    assert periodic_runs.run_digests(none).count() == periodic_runs.collapsed(none).count() == 0


def test_the_whole_query(spark, sf):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r["doc_id"]: digests(looped(r["doc_id"], r["text"])) for r in docs if len(r["text"]) < 12_000} | {r["doc_id"]: got[r["doc_id"]] for r in docs if len(r["text"]) >= 12_000}
    assert sum(r[0] for r in got.values()) >= 10
