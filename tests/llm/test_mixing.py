"""Mixing by systematic sampling: targets against a loop of resharing, the line against one over sorted rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, row string, target string, __part int"


def shares(sizes: dict, weights=(1, 2, 3), most=3):
    """Words by source: what is above the cap goes back and is dealt out again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > most * sizes[s]}
        if not over:
            got |= {s: left * weight[s] / whole for s in free}
            break
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over
    return got


def bits(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:8], 16)


def expected(rows):
    size = {s: 0 for _, _, s, *_ in rows}
    for _, text, s, *_ in rows:
        size[s] += len(WORD.findall(text or ""))
    want, out = shares(size), []
    for s in size:
        line = []
        for i, text, of, *_ in rows:
            if of == s:
                n, d = len(WORD.findall(text or "")), bits(mixing.SEED, "null" if i is None else str(i))
                line.append((d % 2, -n if d % 2 else n, d, -1 if i is None else i, n))
        at = bits(mixing.SEED, "" if s is None else "=" + s) % 10**6 * (mixing.UNITS // 10**6)
        step = int(min(3.0, want[s] / size[s]) * mixing.UNITS) if size[s] else 0
        for *_, i, n in sorted(line):
            copies = (at + step) // mixing.UNITS - at // mixing.UNITS
            at += step
            out.append((None if i == -1 else i, n, size[s], round(want[s], 6), copies * n))
    return Counter(out)


def rows_of(df):
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


@pytest.fixture(scope="module")
def odd(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    rows += [(1000, None, "hot"), (1001, "", None), (1002, " \t\n ", "blank"), (1003, words(20_000), "s1"), (None, "a b", None), (None, "a b", None), (7, words(9), "é"), (7, words(9), "é"), (8, "x", ""), (9, "one", "z"), (10, "two\x0bthree", "\U00010000")]
    return spark.createDataFrame([(*r, 5, "r", "t", 0) for r in rows], SCHEMA).repartition(5)


def test_mix_equals_a_loop(odd):
    got = mixing.copies(odd)
    assert rows_of(got) == expected([tuple(r) for r in odd.collect()])
    assert rows_of(got) == rows_of(mixing.copies(odd))  # reruns agree
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got.collect())


def test_mix_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(mixing.copies(docs)) == expected([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])


def test_targets_that_stop_at_their_cap(spark):
    """Tiny sources with large weights fill up one after the other; what is left goes to the rest by weight."""
    sizes = {"a": 1000, "b": 3, "c": 5, "d": 40, "e": 0, "f": 7, None: 300}
    rows = [(1, " ".join(["w"] * n), s) for s, n in sizes.items()]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["source"])
    want = shares(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got.collect()} == want
    assert sum(want.values()) == pytest.approx(sum(sizes.values())) and want["b"] == 9 and want["e"] == 0


def test_sources_come_near_their_targets(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 6).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") * 7919 % 200).cast("int")).alias("text"),
    )
    got = mixing.copies(docs, keep=["source"]).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.01 * r["target"] + 200 for r in got)


def test_mixture_holds_the_copies(odd):
    want = Counter()
    for r in mixing.copies(odd, keep=["source", "text"]).collect():
        want[(r["doc_id"], r["source"], r["text"])] += r["copies"]
    got = mixing.mixture(odd).collect()
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in got) == +want
    numbers = defaultdict(set)
    for r in got:
        numbers[(r["doc_id"], r["source"])].add(r["copy"])
    assert max(max(n) for n in numbers.values()) == 2


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.copies(empty).count() == 0 and mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "s")], "doc_id long, text string, source string")
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.copies(blank).collect()] == [(0, 0, 0.0, 0)] * 2
