"""The ten operators against brute force, on small tables and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm import byte_bpe, common, fm_index, greedy_tiling, jaccard_join, kneser_ney, language_id, quality_classifier, quality_rules, queries, substring_dedup, token_files, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tkey string, key_id string, spans int, component_id string, lang_pred string"
PASSAGE = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n ", None),
    (4, "One two", "en"),
    (5, "one TWO", "en"),
    (6, "one two three four five six seven eight", "en"),
    (7, "one two three four five six seven eight", "en"),
    (7, "one two three four five six seven eight", "en"),
    (None, "one two three four five six seven eight", None),
    (8, "before " + PASSAGE + " after", "fr"),
    (9, "other " + PASSAGE + " end", "fr"),
    (10, "a " * 90, "en"),
    (11, " ".join(f"x{i}" for i in range(30_000)), "de"),
    (12, "漢字 и кириллица <|endoftext|> ǅ İ ſ e\u0301\u00a0\u2003 'Ll don't", "en"),
    (13, "word\nline one\nline one\n\n\nline one ", "en"),
    (14, "#*$ %&| <> " * 20, "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, a very long text, and extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", 1, "k", "k", 0, "c", "p") for i, t, lang in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text or "")


# ---------------------------------------------------------------- 1


def brute_groups(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_equals_brute_force(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert got == brute_groups(texts(docs))


@pytest.mark.parametrize("light", [0, 3, 11])
def test_jaccard_of_small_and_long_lists(spark, light, monkeypatch):
    """Random edits around the threshold, with every split between light and heavy sets, and lists that count as long."""
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda sizes: light)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 2)
    rng = np.random.default_rng(light)
    rows = []
    for base in range(12):
        size = int(rng.integers(5, 60))
        text = [f"b{base}w{rng.integers(0, 40)}" for _ in range(size)]
        for _ in range(6):
            own = list(text)
            for _ in range(int(rng.integers(0, 1 + size // 25))):
                own[int(rng.integers(0, size))] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own[: size - int(rng.integers(0, 3))])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("light", [0, 7, 12])
def test_jaccard_of_small_sets(spark, light, monkeypatch):
    """Short texts over few words, so that sets of equal and of unequal sizes share some shingles, but often too few."""
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda sizes: light)
    rng = np.random.default_rng(20)
    rows = []
    for base in range(40):
        text = [f"b{base}w{k}" for k in range(int(rng.integers(5, 18)))]
        for _ in range(6):
            a, b = int(rng.integers(0, 3)), int(rng.integers(0, 3))
            rows.append((len(rows), " ".join([f"h{rng.integers(0, 3)}"] * int(rng.integers(0, 3)) + text[a : len(text) - b] + [f"t{rng.integers(0, 3)}"] * int(rng.integers(0, 3)))))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("sent", [True, False])
def test_jaccard_of_a_large_group(spark, sent, monkeypatch):
    """Many edited copies of one text, most linked through a few of them only, beside texts that share a passage with it; with
    small tables sent, and with all joined by shuffle and lists dealt as hot ones."""
    if not sent:
        monkeypatch.setattr(common, "MAX_SENT_BYTES", -1)
        monkeypatch.setattr(jaccard_join, "HOT_LEVEL", 2)
    rng = np.random.default_rng(11)
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(220)]
    rows = []
    for k in range(160):
        own = list(base)
        for _ in range(int(rng.integers(0, 12))):
            own[int(rng.integers(0, len(own)))] = f"e{rng.integers(0, 10**9)}"
        rows.append((1000 - k, " ".join(own)))
    for k in range(40):
        rows.append((2000 + k, " ".join([f"o{rng.integers(0, 10**9)}" for _ in range(150)] + base[:80])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(rows)
    assert got == want and 1 < len({c for i, (_, c) in want.items() if i <= 1000}) < 160


@pytest.mark.parametrize("sent", [64_000_000, -1])
def test_jaccard_of_repeated_ids(spark, sent, monkeypatch):
    """Rows that share a doc_id are one node: it joins the groups of all its texts, copies of other rows included."""
    monkeypatch.setattr(common, "MAX_SENT_BYTES", sent)
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = two.replace("b39", "b40")
    rows = [(5, one), (6, one), (7, one), (7, near), (7, near), (8, two), (9, two), (3, three), (4, three), (4, three), (2, "short"), (9, "short")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 2, 3: 3, 4: 3, 5: 2, 6: 2, 7: 2, 8: 2, 9: 2}


def test_jaccard_odd_rows(odd, empty):
    got = [tuple(r) for r in jaccard_join.jaccard_groups(odd).collect()]
    want = brute_groups([(i, t) for i, t, _ in ROWS if i is not None])
    assert Counter(g for g in got if g[0] is not None) == Counter((i, *want[i]) for i, _, _ in ROWS if i is not None)
    assert [g for g in got if g[0] is None] == [(None, 4, None)]
    assert jaccard_join.jaccard_groups(empty).count() == 0
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({w[1] for w in want.values()})
    assert jaccard_join.one_of_each(empty).count() == 0


# ---------------------------------------------------------------- 2


def test_url_filter(spark, sf, empty):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    more = [(900, None), (901, "no scheme"), (902, "HTTP://A.ORG/x"), (903, "x://a.org"), (904, "x://a.org?x/"), (905, "x://Www.Example.Org/en/12?q"), (906, "x://example.org/en/2"), (907, "x://notorg/"), (907, "x://notorg/"), (908, "")]
    both = pages.select("page_id", "url").unionAll(spark.createDataFrame(more, "page_id long, url string"))
    got = {r["page_id"]: r for r in url_filter.url_verdicts(both).collect()}
    for r in both.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(rule), rule, verdict) for rule, verdict in url_filter.RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        g = got[r["page_id"]]
        assert (g["host"], g["path"], g["rule"]) == (host, path, max(fit)[1] if fit else None)
        assert g["verdict"] in ("allow", "block")
        if fit:
            assert g["verdict"] == max(fit)[2]
    assert url_filter.url_verdicts(both).count() == both.count()
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(spark.createDataFrame([(1, "x"), (2, None)], "page_id long, url string")).collect()} == {"allow"}


def test_url_filter_learns_from_the_rules(spark):
    """Urls that no rule decides are judged by likeness; the shared and the sharded model agree."""
    rows = [(i, f"http://good{i}.example.org/fr/{i}") for i in range(200)] + [(1000 + i, f"http://bad{i}.pills.com/de/casino-{i}") for i in range(200)]
    rows += [(5000, "http://bad7.pills.net/de/casino-9"), (5001, "http://good3.example.net/fr/9")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_verdicts(pages).collect()}
    assert (got[5000]["rule"], got[5000]["verdict"], got[5001]["verdict"]) == (None, "block", "allow")
    url_filter.fits, kept = (lambda entries: False), url_filter.fits
    try:
        again = {r["page_id"]: r["ratio"] for r in url_filter.url_verdicts(pages).collect()}
    finally:
        url_filter.fits = kept
    assert all(abs(again[i] - got[i]["ratio"]) < 1e-5 for i in again)


# ---------------------------------------------------------------- 3 and 4


def test_toxicity_is_learnt_and_held_out(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        own = [f"w{rng.integers(0, 200)}" for _ in range(40)]
        if toxic:
            own[5] = f"insult{rng.integers(0, 5)}"
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.fit(docs, known.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, machine).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97


def test_machine_learns_pairs():
    """Either term alone is harmless, both together are not: linear weights cannot say that."""
    rng = np.random.default_rng(2)
    lists, labels = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        x = [100] * a + [200] * b + [300 + int(t) for t in rng.integers(0, 5, 3)]
        lists.append(np.unique(np.array(x)))
        labels.append(a & b)
    m = toxicity.Machine.fit(lists, np.array(labels), 0.25, epochs=60)
    score = lambda *t: m.scores(np.zeros(len(t), int), np.array(t), 1, m.table())[0]
    assert score(100, 200) > 0.5 > max(score(100), score(200))


def test_machine_learns_pairs_of_terms_that_tell_nothing_alone(monkeypatch):
    """Toxic where exactly both terms or neither stand: each term is as frequent in toxic texts as in others."""
    rng = np.random.default_rng(13)
    lists, labels = [], []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        lists.append(np.unique(np.array([100 + a, 200 + b] + [300 + int(t) for t in rng.integers(0, 30, 3)])))
        labels.append(int(a == b))
    monkeypatch.setattr(toxicity, "MAX_TERMS", 6)
    monkeypatch.setattr(toxicity, "FIRST_EPOCHS", 40)
    m = toxicity.Machine.fit_strongest(lists, np.array(labels), 0.5, epochs=80)
    score = lambda *t: m.scores(np.zeros(len(t), int), np.array(t), 1, m.table())[0]
    assert min(score(100, 200), score(101, 201)) > 0.7 > 0.3 > max(score(100, 201), score(101, 200))


def test_machine_sums_pairs():
    """The score against the sum over all pairs of distinct known terms."""
    rng = np.random.default_rng(14)
    m = toxicity.Machine(-0.3, np.arange(50, 90, 2), rng.normal(size=20).astype(np.float32), rng.normal(0, 0.4, (20, 8)).astype(np.float32))
    docs = [rng.integers(45, 95, rng.integers(0, 30)) for _ in range(20)]
    got = m.scores(np.repeat(np.arange(20), [len(x) for x in docs]), np.concatenate(docs), 20, m.table())
    for g, x in zip(got, docs, strict=True):
        own = [(t - 50) // 2 for t in sorted(set(x.tolist())) if t in set(m.buckets.tolist())]
        z = -0.3 + sum(m.weights[t] for t in own) + sum(float(m.factors[a] @ m.factors[b]) for a, b in combinations(own, 2))
        assert g == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_and_language_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    machine = toxicity.fit(odd, labels)
    out = toxicity.toxicity(odd, machine).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(empty, toxicity.fit(empty, labels.where("false"))).count() == 0
    network = language_id.fit(odd)
    out = language_id.languages(odd, network).collect()
    assert len(out) == len(ROWS)
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 14}
    assert language_id.languages(empty, language_id.fit(empty)).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(3)
    net = language_id.Network.fresh(["a", "b", "c"], rng)
    data, target = rng.integers(97, 110, (7, 5)), rng.integers(0, 3, 7)
    _, g = net.gradients(data, target)
    for k in net.NAMES:
        flat = g[k].ravel()
        at = int(np.argmax(np.abs(flat)))
        loss = []
        for e in (1e-2, -1e-2):
            net.params[k].ravel()[at] += e
            loss.append(net.gradients(data, target)[0])
            net.params[k].ravel()[at] -= e
        assert abs((loss[0] - loss[1]) / 2e-2 - flat[at]) < 0.03 * abs(flat[at]) + 1e-4


def test_every_position_is_labelled(spark, odd):
    """The pooled probabilities against a network that reads one byte after the other: all windows of short and long texts."""
    rng = np.random.default_rng(12)
    net = language_id.Network.fresh(["a", "b"], rng)
    p = net.params
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(data, d):
        h, out, n = np.zeros(8), [], 8
        for c in data:
            a, r = p["x" + d][c] + p["b" + d], h @ p["u" + d]
            z, reset = sig(a[:n] + r[:n]), sig(a[n : 2 * n] + r[n : 2 * n])
            new = np.tanh(a[2 * n :] + reset * r[2 * n :])
            h = new + z * (h - new)
            out.append(h)
        return out

    for i, text in [(r["doc_id"], r["text"]) for r in odd.collect() if r["text"] and len(r["text"]) < 900 and r["lang"]]:
        data = list(re.sub("[A-Z]", lambda m: m[0].lower(), text).encode())
        logs = []
        for at in range(0, len(data), 64):
            start = min(at, max(0, len(data) - 64))
            window = data[start : start + 64]
            for k, (f, b) in enumerate(zip(states(window, "f"), states(window[::-1], "b")[::-1], strict=True)):
                if start + k >= at:
                    x = np.r_[f, b] @ p["o"] + p["c"]
                    logs.append(x - np.log(np.exp(x).sum()))
        assert len(logs) == len(data)
        mean = np.mean(logs, axis=0)
        want = np.exp(mean - np.log(np.exp(mean).sum()))
        got = language_id.languages(odd.where(F.col("doc_id") == i), net).first()
        if got["lang_pred"] != "und":
            assert got["score"] == pytest.approx(want.max(), abs=1e-5) and got["lang_pred"] == "ab"[want.argmax()]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01")
    assert got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# ---------------------------------------------------------------- 5


def brute_tiles(text, item, least):
    """Longest common runs of free tokens, one at a time."""
    free_t, free_i, covered = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return covered
        for k in range(n):
            free_i[i + k] = free_t[t + k] = False
        covered += n


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item = rng.integers(1, 6, rng.integers(3, 25)).astype(np.uint64)
        text = np.concatenate([rng.integers(1, 6, 8).astype(np.uint64), *(item[a : a + rng.integers(2, 9)] for a in rng.integers(0, len(item), 4))])
        got = greedy_tiling.tiles(text, item, 3)
        assert all((text[t : t + n] == item[i : i + n]).all() for t, i, n in got)
        assert len({x for t, _, n in got for x in range(t, t + n)}) == sum(n for *_, n in got) == brute_tiles(list(text), list(item), min(3, len(item)))


def test_decontamination(spark, docs, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.orderBy("item_id").first()
    w = item["text"].split()
    half = len(w) // 2
    planted = spark.createDataFrame([(9001, "x y z " + " ".join(w[half:] + ["gap"] + w[:half]).upper()), (9002, " ".join(w[: len(w) // 3])), (9001, "x y z " + " ".join(w[half:] + ["gap"] + w[:half]).upper())], "doc_id long, text string")
    more = bench.select("item_id", "text").unionAll(spark.createDataFrame([(8000, None), (8001, ""), (None, item["text"]), (8002, "tiny item")], "item_id long, text string"))
    both = docs.select("doc_id", "text").unionAll(planted)
    got = greedy_tiling.contaminations(both, more)
    key = lambda df: sorted(tuple(r) for r in df.drop("tkey").collect())
    assert key(got) == key(greedy_tiling.contaminations(both, more, max_sent_tokens=0).unionAll(greedy_tiling.contaminations(both, more).limit(0)))
    want = Counter()
    tok = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    items = [(r["item_id"], tok(r["text"])) for r in more.where("item_id is not null").collect()]
    for i, t in texts(both):
        t = tok(t)
        for j, it in items:
            k = min(5, len(it))
            grams = {tuple(it[x : x + k]) for x in range(len(it) - k + 1)} if it else set()
            if any(tuple(t[x : x + k]) in grams for x in range(len(t) - k + 1)) and brute_tiles(t, it, k) >= 0.6 * len(it):
                want[i, j] += 1
    assert Counter((r["doc_id"], r["item_id"]) for r in got.collect()) == want and want[9001, item["item_id"]] == 2 and not want[9002, item["item_id"]]
    assert greedy_tiling.contaminations(odd, more).count() == 0 and greedy_tiling.contaminations(empty, more).count() == 0
    assert greedy_tiling.decontaminated(odd, more.limit(0)).count() == len(ROWS)
    clean = greedy_tiling.decontaminated(both, more)
    assert clean.columns == both.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in texts(both)} - {i for i, _ in want}


# ---------------------------------------------------------------- 6


def brute_removal(rows, window):
    count = Counter(tuple(w[k : k + window]) for _, t in rows for w in [words(t)] for k in range(len(w) - window + 1))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


@pytest.mark.parametrize("hot", [2, 1000])
def test_substring_dedup(docs, odd, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    for df in (docs, odd):
        assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == Counter(brute_removal(texts(df), 35))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_hot_windows_go_to_no_index(spark, monkeypatch):
    """A passage in many texts, with other words around it in each: its windows are counted, never held together."""
    import pyarrow as pa

    rows = [(i, " ".join([*(f"l{i}x{j}" for j in range(20)), PASSAGE, *(f"r{i}x{j}" for j in range(20))])) for i in range(30)] + [(99, "alone " * 60)]
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df).collect()) == Counter(brute_removal(rows, 35))
    wanted = [[{"anchor": 1, "first": 5, "count": 4, "single": True, "hot": True}, {"anchor": 2, "first": 30, "count": 2, "single": False, "hot": False}]]
    batch = pa.RecordBatch.from_pydict({"doc_id": [7], "tkey": [8], "text": [rows[0][1]], "wanted": wanted})
    (indexed,) = substring_dedup._passages(35)(iter([batch]))
    (counted,) = substring_dedup._hot_windows(35)(iter([batch]))
    assert indexed.column("first").to_pylist() == [30]
    assert counted.column("at").to_pylist() == [5, 6, 7, 8] and counted.column("single").to_pylist() == [True] * 4


def test_substring_dedup_of_repetitive_texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["a", "b"], rng.integers(10, 300), p=[0.97, 0.03]))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (12, 35):
        assert Counter(tuple(r) for r in substring_dedup.substring_dedup(df, window).collect()) == Counter(brute_removal(rows, window))


def test_removed_texts(odd):
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    want = {(i, d) for i, _, _, d in brute_removal(texts(odd), 35)}
    assert {(i, hashlib.sha256(" ".join(words(t)).encode()).hexdigest()) for i, t in texts(out)} == want
    assert dict(texts(out))[13] == dict(texts(odd))[13]


def test_fm_index():
    rng = np.random.default_rng(6)
    text = np.concatenate([np.r_[rng.integers(1, 5, rng.integers(5, 40)), 0] for _ in range(30)])
    index = fm_index.FMIndex(text, 12)
    ends = np.flatnonzero(text)
    got = index.matches(text, ends, 12)
    count = Counter(tuple(text[a : a + n]) for n in range(1, 13) for a in range(len(text) - n + 1) if 0 not in text[a : a + n])
    for e, n in zip(ends, got, strict=True):
        fits = [k for k in range(1, 13) if e - k + 1 >= 0 and count[tuple(text[e - k + 1 : e + 1])] >= 2]
        assert n == max(fits, default=0)


# ---------------------------------------------------------------- 7 and 10


def test_byte_bpe(docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df, chunk, overlap in ((docs, 300, 20), (odd, 5000, 100), (odd, 50, 3)):
        want = Counter()
        for i, t in texts(df):
            ids = own.encode_ordinary(t or "")
            want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in byte_bpe.token_digests(df, path, public_tokenizers.PATTERN, chunk, overlap).collect()) == want
    assert byte_bpe.token_digests(empty, path, public_tokenizers.PATTERN).count() == 0


def test_token_files(docs, odd, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5000)
    for df in (docs, odd):
        got = token_files.token_files(df, path).collect()
        ids = Counter()
        for i, t in texts(df):
            x = np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            ids[i, len(x), zlib.crc32(x.tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == ids
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
        assert order == sorted(order)
    assert token_files.token_files(empty, path).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(7)
    for n, top in ((1, 0), (1, 5), (3, 3), (200, 10), (1000, 10**6), (5000, 10**9)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = token_files.EliasFano.of(values)
        at = rng.permutation(n)
        assert (ef.select(at) == values[at]).all()
        assert len(ef.samples) == 4 * -(-n // 64) and not len(ef.select(at[:0]))
        assert 8 * (len(ef.low) + len(ef.high)) <= n * (2 + max(1, np.log2(max(top, 1) / n + 1))) + 256


def test_elias_fano_of_ids(spark):
    """Ids of any size, missing and repeated ones come back from the blocks, which hold no table of 64-bit numbers."""
    ids = [None, None, -(2**63) + 1, -5, -5, 0, 7, 2**40, 2**63 - 1]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == ids
    top = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert (token_files.EliasFano.of(top).select(np.arange(4)) == top).all()


def test_words_of_one_hash(monkeypatch):
    """Words that share a hash, in one slice and across slices, are told apart by their bytes."""
    monkeypatch.setattr(token_files, "_BYTE", np.ones(256, np.uint64))  # now the hash of a word is its length
    path = public_tokenizers.path("word_bpe_49k.json")
    code = token_files.WordCodec(path)
    for texts in (["aa bb"], ["cc"], ["dd"], ["ee ff gg", "hh"]):
        assert code.encode_all(texts) == [code.whole(t) for t in texts]


# ---------------------------------------------------------------- 8 and 9


def brute_model(rows, order):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    clean = [t if isinstance(t, bytes) else b" ".join(t.lower().encode().split()) for t in rows]
    counts = {order: Counter()}
    for t in clean:
        t = b" " * (order - 1) + t
        for i in range(len(t) - order + 1):
            counts[order][t[i : i + order]] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    after = {}
    for k, c in counts.items():
        for g, v in c.items():
            after.setdefault(g[:-1], {})[g] = v
    cuts = {}
    for k, c in counts.items():
        n = [0] + [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        cuts[k] = [0] + [max(0.1, min(i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] and y is not None else 0.5 * i)) for i in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        same = after.get(gram[:-1], {})
        total = sum(same.values())
        if not total:
            return p(gram[1:])
        spare = sum(cuts[k][min(v, 3)] for v in same.values())
        v = same.get(gram, 0)
        return (v - cuts[k][min(v, 3)]) / total + spare / total * p(gram[1:])

    return p


def test_kneser_ney(spark):
    rows = ["the cat sat on the mat", "the cat ate the rat", "a rat sat", "that cat that sat"]
    asked = ["the bat sat", "zzz", "a cat", ""]
    entries = kneser_ney.smoothed(kneser_ney.gram_counts(spark.createDataFrame([(t, "en") for t in rows], "text string, lang string"), 3), 3)
    p = brute_model(rows, 3)
    want = []
    for t in asked:
        b = b"  " + t.encode()
        want.append(sum(np.log(p(b[i : i + 3])) for i in range(len(b) - 2)))
    model = kneser_ney.model_of(kneser_ney.packed_models(entries)["en"], 3)
    import pyarrow as pa

    from llm.common import texts_of

    grams, places = kneser_ney.grams_of(*texts_of(pa.array(asked)), 3)
    assert np.allclose(kneser_ney.by_document(model.logs(grams), places), want, atol=1e-4)
    df = spark.createDataFrame([(i, i, "en", t) for i, t in enumerate(asked)], "doc_id long, tkey long, lang string, text string")
    got = {r["doc_id"]: r["log"] for r in kneser_ney.sharded_scores(df, entries, 3).collect()}
    assert all(abs(got[i] - w) < 1e-4 for i, w in enumerate(want) if asked[i])
    total = sum(np.exp(model.logs((np.frombuffer(b"th", np.uint8).astype(np.uint64) * np.array([65536, 256], np.uint64)).sum() + np.arange(256, dtype=np.uint64))))
    assert abs(total - 1) < 1e-3


def test_pack():
    rng = np.random.default_rng(8)
    for n in (0, 1, 50, 3000):
        x = (rng.integers(0, 2**62, n) >> rng.integers(0, 62, n)).astype(np.uint64)
        assert (kneser_ney.unpack(kneser_ney.pack(x)) == x).all()


def brute_base(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(docs, odd, empty):
    for df in (docs, odd):
        got = quality_rules.quality_rules(df)
        want = Counter((i, *brute_base(t)) for i, t in texts(df))
        assert Counter(tuple(r)[:6] for r in got.collect()) == want
        for r in got.collect():
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
        assert quality_rules.passing(df).columns == df.columns
        assert quality_rules.passing(df).count() == got.where("kept").count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_perplexity_bands(spark):
    """Noise among plain texts is rejected, plain texts are kept, and the sharded model gives the same verdicts."""
    rng = np.random.default_rng(9)
    syllables = ["the", "an", "re", "in", "ou", "ti", "st", "ed"]
    plain = lambda: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(120))
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 126, 6)) for _ in range(120))
    rows = [(i, plain(), "en") for i in range(150)] + [(999, noise, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    assert not got.pop(999) and all(got.values())
    kept, quality_rules.fits = quality_rules.fits, lambda entries: False
    try:
        again = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    finally:
        quality_rules.fits = kept
    assert not again.pop(999) and again == got


def test_bands_and_verdicts_equal_brute_force(spark, docs, monkeypatch):
    """Every level, band and verdict from the definition, over the short documents of a table; on both paths."""
    short = docs.where("length(text) < 900")
    rows = [(r["doc_id"], r["lang"], r["text"], r["half"]) for r in short.select("doc_id", "lang", "text", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")).collect()]
    passed = {i for i, _, t, _ in rows for n, _, _, _, again in [brute_base(t)] if n >= 50 and 100 * again <= 50 * n}
    flat = lambda t: re.sub(r"[\t-\r ]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).lstrip(" ").encode()
    models = {(lang, half): brute_model([flat(t) for i, x, t, h in rows if i in passed and (x, h) == (lang, half)], 5) for i, lang, _, half in rows if i in passed}
    level, size = {}, {}
    for i, lang, t, half in rows:
        p, b = models.get((lang, 1 - half)), b"    " + flat(t)
        size[i] = len(b) - 4 if p else 0
        level[i] = -sum(np.log(p(b[k : k + 5])) for k in range(size[i])) / size[i] if size[i] else None
    low, high = {}, {}
    for lang in {x for _, x, _, _ in rows}:
        own = sorted(level[i] for i, x, _, _ in rows if x == lang and i in passed and size[i])
        if len(own) >= 20:
            low[lang], high[lang] = own[int(np.ceil(0.05 * len(own))) - 1], own[int(np.ceil(0.95 * len(own))) - 1]
    monkeypatch.setattr(quality_rules, "TAIL", 0.05)
    monkeypatch.setattr(quality_rules, "SHORT", 0.1)
    want = {i: i in passed and (x not in low or not size[i] or low[x] - 0.1 / size[i] ** 0.5 <= level[i] <= high[x] + 0.1 / size[i] ** 0.5) for i, x, _, _ in rows}
    assert {x for i, x, _, _ in rows if i in passed and not want[i]} == set(low) != set()
    for most in (10**9, 0):
        monkeypatch.setattr(kneser_ney, "MAX_SENT_ENTRIES", most)
        got = quality_rules.quality_rules(short).collect()
        assert all(abs(r["log_perplexity"] - level[r["doc_id"]]) < 1e-3 if size[r["doc_id"]] else r["log_perplexity"] is None for r in got)
        assert {r["doc_id"]: r["kept"] for r in got} == want


@pytest.mark.parametrize("entries", [1, 40, 10**9])
def test_scores_do_not_depend_on_shards(spark, docs, monkeypatch, entries):
    """Many shards, one or few: the sums of the model that is sent whole."""
    some = docs.where("doc_id % 4 = 0").select("doc_id", F.xxhash64("text").alias("tkey"), "lang", "text")
    model = kneser_ney.smoothed(kneser_ney.gram_counts(docs.where("doc_id % 2 = 1 and length(text) < 600"), 4), 4)
    monkeypatch.setattr(kneser_ney, "SHARD_ENTRIES", max(entries, model.count() // 500))
    monkeypatch.setattr(kneser_ney, "ROW_ENTRIES", 50)
    sent = {r["doc_id"]: r for r in kneser_ney.sent_scores(some, model, 4).collect()}
    got = {r["doc_id"]: r for r in kneser_ney.sharded_scores(some, model, 4).collect()}
    assert set(got) == {i for i, r in sent.items() if r["log"] is not None}
    assert all(got[i]["n"] == sent[i]["n"] and got[i]["log"] == pytest.approx(sent[i]["log"], rel=1e-5) for i in got)


def test_quality_classifier(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.quality_scores(docs, labels.where("quality = 1"))
    both = got.select("doc_id", "good").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("good").cast("int")).alias("share"))
    share = {r["quality"]: r["share"] for r in both.collect()}
    assert share[1] > 0.97 and share[0] < 0.5
    out = quality_classifier.quality_scores(odd, spark.createDataFrame([(6,), (8,), (None,)], "doc_id long")).collect()
    assert len(out) == len(ROWS) and not any(r["good"] for r in out if r["doc_id"] in (1, 2))
    assert quality_classifier.quality_scores(empty, labels).count() == 0


@pytest.mark.parametrize("sent", [0, 10**9])
def test_quality_classifier_without_a_model(spark, odd, monkeypatch, sent):
    """No trusted text in a language: its texts are good. Repeated rows are judged as a single one."""
    monkeypatch.setattr(kneser_ney, "MAX_SENT_ENTRIES", sent)
    rows = [(i, f"plain words of text {i} and  some more", "en") for i in range(40)] + [(100, "  des mots\n\n é", None), (101, " \t ", None), (102, "des mots", "fr")]
    rows += [(200, "plain words", "en")] + [(201, "plain words", "en")] * 3 + [(202, "plain words", "en"), (202, "plain words", "xx")]
    got = quality_classifier.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(40).selectExpr("id as doc_id")).collect()
    assert len(got) == len(rows)
    of = lambda i: [r for r in got if r["doc_id"] == i]
    assert [(r["good"], r["n_bytes"], r["log_perplexity"]) for i in (100, 101, 102) for r in of(i)] == [(True, len("des mots é".encode()), None), (False, 0, None), (True, 8, None)]
    one = of(200)[0]
    en = [r for r in of(202) if r["lang"] == "en"]
    for r in of(201) + en:
        assert (r["n_bytes"], r["good"]) == (one["n_bytes"], one["good"])
        assert (r["threshold"], r["log_perplexity"]) == pytest.approx((one["threshold"], one["log_perplexity"]))
    assert [(r["good"], r["log_perplexity"]) for r in of(202) if r["lang"] == "xx"] == [(True, None)]


def test_quality_classifier_sees_whole_words(spark, monkeypatch):
    """Grams of four bytes: the trigrams of these texts are trusted ones, their four-letter words are not; on both paths."""
    trusted = [(i, "abcd bcda cdab dabc " * 20, "en") for i in range(60)]
    rows = trusted + [(100, "abcd bcda cdab dabc " * 20, "en"), (101, "abc bcd cda dab " * 20, "en"), (102, "bc da dcb", "xx")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(60).selectExpr("id as doc_id")
    seen = []
    for most in (10**9, 0):
        monkeypatch.setattr(kneser_ney, "MAX_SENT_ENTRIES", most)
        got = {r["doc_id"]: r for r in quality_classifier.quality_scores(docs, known).collect()}
        assert got[101]["log_perplexity"] > got[100]["log_perplexity"] and got[100]["good"] and got[102]["good"]
        seen.append({i: (r["n_bytes"], r["good"], r["log_perplexity"] and round(r["log_perplexity"], 4)) for i, r in got.items()})
    assert seen[0] == seen[1] and quality_classifier.ORDER >= 4
