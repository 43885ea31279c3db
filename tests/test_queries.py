"""Every registered reference query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from docspark.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    kind = type(v).__name__
    if kind in ("bool", "bool_"):
        return bool(v)
    if kind.startswith(("int", "uint", "float", "Decimal")):
        return round(float(v), 6)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf, duck, name):
    got = q.QUERIES[name](spark, sf).toPandas()
    if name in q.ORACLE_SQL:
        want = duck.sql(q.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_page_chunks_against_a_loop(spark, sf):
    pages = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = q.QUERIES["page_chunks"](spark, sf).toPandas().sort_values(["doc_id", "page_no"])
    for r in pages.itertuples():
        chunk = size = 0
        want = []
        for line in r.text.split("\n"):
            if size + len(line) > 4000 and want and size:
                chunk, size = chunk + 1, 0
            elif size + len(line) > 4000 and want:
                chunk += 1
            size += len(line)
            want.append(chunk)
        assert got[got.doc_id == r.doc_id].chunk.tolist() == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "bench.py"))


@pytest.mark.parametrize("name", ["registry_match_a", "registry_match_b", "registry_retry"])
def test_whole_registry_against_nested_loops(spark, tmp_path, name):
    """Every reference is asked, over 1,500 parts of random years."""
    pd.DataFrame({"p_partkey": range(1, 1501), "p_size": np.random.default_rng(3).integers(1, 51, 1500), "p_name": "name"}).to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    assert rows(q.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(q.ORACLE_SQL[name]).df())


def test_whole_digits_compatible(spark, tmp_path):
    pd.DataFrame({"p_partkey": range(1, 3001)}).to_parquet(tmp_path / "part.parquet")
    want = []
    for k in range(1, 3001):
        a, b = str(300000 + k), str(301000 + k - k % 50)
        cut = lambda s: (s[:-4], s[-4:]) if 1900 <= int(s[-4:]) <= 2039 else (s[:-2], s[-2:])
        (x, y), (u, v) = cut(a), cut(b)
        if a == b or (y == v and len(x) == len(u) and sum(c != d for c, d in zip(x, u, strict=True)) <= 1):
            want.append((k, a, b, True))
    got = [tuple(r) for r in q.QUERIES["digits_compatible"](spark, str(tmp_path)).collect()]
    assert max(k for k, *_ in want) > 850 and sorted(got) == want


def test_whole_texts_against_loops(spark, tmp_path):
    """Noise and mixed tokens that stand behind the first 500 characters count."""
    plain = "a plain line of words that is read well " * 20
    texts = [plain, plain + "| 12 bcdfgh aaaa", plain + "zzé", plain + "caé", "", "ab", "xé a", None]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")

    def score(t):
        t = re.sub(r"\s+", " ", t or "").strip()
        letters = re.findall("[A-Za-z]", t)
        if len(t) < 3 or len(letters) < 3:
            return -100.0 if len(t) < 3 else -50.0
        share = len(re.findall("(?i)[aeiouy]", t)) / len(letters)
        bad = 18 * (share < 0.18 or share > 0.62) + 4 * len(re.findall("[0-9]", t)) + 6 * len(re.findall(r"[|©\[\]_`]", t))
        bad += 12 * bool(re.search("(?i)[bcdfghjklmnpqrstvwxz]{5,}", t)) + 8 * bool(re.search(r"(?i)(.)\1{3,}", t))
        return round(share * 40 + min(len(letters), 80) * 0.15 - bad, 6)

    def mixed(t):
        one, other = "[a-m]", "[éèêçñóíáúäöüß]"
        t = (t or "").strip()
        if not re.search(one, t) or not re.search(other, t):
            return False
        n = len(re.findall(one, t))
        return any(re.search(one, x) and re.search(other, x) for x in t.split()) or (n >= 2 and n / len(t) > 0.06)

    got = {name: {r[0]: r[1] for r in q.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("text_quality", "mixed_script")}
    assert got["text_quality"] == pytest.approx({i: score(t) for i, t in enumerate(texts)})
    assert got["mixed_script"] == {i: mixed(t) for i, t in enumerate(texts)}


def test_folds_against_loops(spark, sf):
    """Notes and sections that absorb like ones in order, one by one."""
    from docspark.operators import blocks
    from docspark.plans import inputs as i
    from docspark.plans import sheet_queries as sq

    notes = i.frame(spark, sf, sq._NOTES).toPandas().sort_values(["doc_id", "ord"])
    want = []
    for doc, own in notes.groupby("doc_id"):
        kept: list[list] = []
        for r in own.itertuples():
            key = " ".join([w for w in re.sub(r"[^\w\s]", " ", r.note.lower()).split() if len(w) > 2][:8])
            for k in kept:
                a, b = set(k[1].split()), set(key.split())
                if key and k[1] and (k[1] == key or (min(len(k[1]), len(key)) >= 10 and (k[1] in key or key in k[1])) or len(a & b) >= min(3, len(a), len(b))):
                    if r.quality > k[2]:
                        k[:] = [r.note, key, r.quality]
                    break
            else:
                kept.append([r.note, key, r.quality])
        want += [(doc, n, k[0]) for n, k in enumerate(kept)]
    assert sorted(tuple(r) for r in blocks.merged_notes(i.frame(spark, sf, sq._NOTES)).collect()) == sorted(want) and len(want) < len(notes)

    told = [(1, "Опора 34.10 скользящая"), (2, "Труба 34.10 бесшовная"), (3, "---"), (4, "***"), (5, "Ось"), (6, "ось, на карте")]
    odd = spark.createDataFrame([(1, n, t, float(n)) for n, t in told], "doc_id long, ord long, note string, quality double")
    assert sorted((r["place"], r["note"]) for r in blocks.merged_notes(odd).collect()) == [(0, "Труба 34.10 бесшовная"), (1, "---"), (2, "***"), (3, "ось, на карте")]

    parts = [(1, 1, "legend", "", "", ["a", "b"]), (1, 2, "legend", "2", "Т", ["b", "c"]), (1, 3, "legend", "", "", ["x"]), (1, 4, "plan", "2", "У", ["q"]), (1, 5, "legend", "", "", ["a", "b", "c", "d"]), (2, 1, "plan", "", "", [])]
    got = blocks.merged_sections(spark.createDataFrame(parts, "doc_id long, ord long, kind string, table_number string, title string, keys array<string>"))
    assert sorted((r["doc_id"], r["first"], list(r["members"]), list(r["keys"]), r["title"], r["table_number"]) for r in got.collect()) == [
        (1, 1, [1, 2, 4, 5], ["a", "b", "c", "d", "q"], "Т", "2"), (1, 3, [3], ["x"], "", ""), (2, 1, [1], [], "", ""),
    ]
