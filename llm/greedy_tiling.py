"""Benchmark decontamination by greedy string tiling (Wise, 1993).

Tokens are runs of letters and digits of the lower-cased text. A document and a test item meet when they share a seed, a run of
``LEAST`` tokens (an item with fewer tokens is a seed of its own). For each pair that meets, the longest common runs of tokens that are not
marked yet are found by running Karp-Rabin hashes, marked in both texts, and sought again, until none of ``LEAST`` tokens
is left. The tiles may stand in any order, so reordered passages count. A document is contaminated when the tiles cover
``COVERAGE`` of an item's tokens.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Words, cut, id_name, joined, longs, marked, runs, slices, text_session, texts_of

LEAST = 5
COVERAGE = 0.6
#: Tokens of all items that are sent to the tasks; with more, seeds are joined by shuffle.
MAX_SENT_TOKENS = 2_000_000
_U = np.uint64
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(48, 58), *range(97, 123)]] = False


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a string column, and where each text's tokens begin."""
    words = Words(*texts_of(pc.utf8_lower(column)), separators=_BETWEEN)
    return words.hashes(), words.first


def tiles(text: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token arrays: (place in text, place in item, length), longest first.

    Among matches of one length the first in the item, then in the text, is taken.
    """
    least = max(1, min(least, len(item)))
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    while True:
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        places: dict[int, list[int]] = defaultdict(list)
        for t, h in _free_runs(text, free_text, size):
            places[h].append(t)
        longest = 0
        for i, h in _free_runs(item, free_item, size):
            for t in places.get(h, ()):
                n = 0
                while i + n < len(item) and t + n < len(text) and free_item[i + n] and free_text[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= size:
                    found[n].append((i, t))
                    longest = max(longest, n)
        for n in sorted(found, reverse=True):
            for i, t in found[n]:
                if free_item[i : i + n].all() and free_text[t : t + n].all():
                    free_item[i : i + n] = free_text[t : t + n] = False
                    out.append((t, i, n))
                else:  # cut short by a longer tile: what is left is found again in the next round
                    longest = max(longest, 1)
        if found:
            continue  # again at this length, until nothing is found
        if size == least:
            return out
        size = max(least, size // 2)


def _free_runs(tokens: np.ndarray, free: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    if len(tokens) < size:
        return
    whole = np.convolve(free, np.ones(size, int), "valid") == size
    at = np.flatnonzero(whole)
    yield from zip(at.tolist(), runs(tokens, size)[at].tolist(), strict=True)


class Items:
    """The test items with their seeds, as sent to the tasks."""

    def __init__(self, ids: list[int], texts: list[str]):
        tokens, first = tokens_of(pa.array(texts, pa.string()))
        self.ids, self.tokens = ids, [tokens[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        seeds = defaultdict(list)
        for row, t in enumerate(self.tokens):
            k = min(LEAST, len(t))
            if k:
                seeds[k].append((runs(t, k), np.full(len(t) - k + 1, row), np.arange(len(t) - k + 1)))
        self.seeds = {}
        for k, found in seeds.items():
            key, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[key >> _U(42)] = True
            self.seeds[k] = key[order], row[order], place[order], bits

    def meet(self, tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``tokens`` at which a seed of k tokens stands, with the seed's item and its place there."""
        key, row, place, bits = self.seeds[k]
        grams = runs(tokens, k)
        at = np.flatnonzero(bits[grams >> _U(42)])
        low, high = np.searchsorted(key, grams[at]), np.searchsorted(key, grams[at], "right")
        n = high - low
        which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), row[which], place[which]


def judged(text: np.ndarray, item: np.ndarray, places: np.ndarray) -> tuple[int, int]:
    """Tokens of the item covered by tiles, and tiles; ``places``: where its seeds stand in the text."""
    k = min(LEAST, len(item))
    near = np.unique((places[:, None] + np.arange(k)).ravel())
    # only these tokens can lie in a tile; a token of no item stands for each gap
    gap = np.r_[False, np.diff(near) > 1]
    short = np.insert(text[near], np.flatnonzero(gap), _U(0))
    got = tiles(short, item)
    return sum(n for _, _, n in got), len(got)


def _contaminated(sent, coverage: float):
    def contaminated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        sizes = np.array([len(t) for t in items.tokens])
        for batch in slices(batches):
            tokens, first = tokens_of(batch.column("text"))
            out: list[list] = [[] for _ in range(5)]
            for k in items.seeds:
                at, row, place = items.meet(tokens, k) if len(tokens) >= k else (np.zeros(0, int),) * 3
                doc = np.searchsorted(first, at, "right") - 1
                whole = at + k <= first[doc + 1] if len(at) else np.zeros(0, bool)
                at, row, place, doc = at[whole], row[whole], place[whole], doc[whole]
                order = np.lexsort((at, row, doc))
                at, row, place, doc = at[order], row[order], place[order], doc[order]
                new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]) if len(at) else np.zeros(0, int)
                for a, b in zip(new, np.r_[new, len(at)][1:], strict=True):
                    d, r = int(doc[a]), int(row[a])
                    reach = len(np.unique((place[a:b, None] + np.arange(k)).ravel()))  # tiles cannot cover more
                    if reach >= coverage * sizes[r]:
                        covered, n = judged(tokens[first[d] : first[d + 1]], items.tokens[r], at[a:b] - first[d])
                        if covered >= coverage * sizes[r]:
                            for column, v in zip(out, (d, items.ids[r], covered, int(sizes[r]), n), strict=True):
                                column.append(v)
            d, *rest = out
            d = pa.array(d, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(d), batch.column("tkey").take(d), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "tkey", "item_id", "covered_tokens", "item_tokens", "n_tiles"]
            )

    return contaminated


#: Bits of the table that tells which seeds no item has, as words of 64.
CELLS = 1 << 24


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every seed of each item; all seeds of an item have one length."""
    for batch in slices(batches):
        tokens, first = tokens_of(batch.column("text"))
        for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            k = min(LEAST, b - a)
            if k:
                seeds, row = runs(tokens[a:b], k), pa.array(np.full(b - a - k + 1, d))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seeds), k, np.int32)), longs(seeds), *(batch.column(c).take(row) for c in ("id", "tkey"))], ["k", "seed", "id", "tkey"])


def _text_seeds(sent, lengths: list[int]):
    """The seeds of each text, of the lengths that items have, that the table of the items' seeds does not rule out."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: np.ndarray = sent.value
        for batch in slices(batches):
            tokens, first = tokens_of(batch.column("text"))
            for k in lengths:
                found = runs(tokens, k)
                at = np.flatnonzero(cells[(found >> _U(46)).astype(np.int64)] >> (found >> _U(40) & _U(63)) & _U(1))
                doc = np.searchsorted(first, at, "right") - 1
                at, doc = (x[at + k <= first[doc + 1]] for x in (at, doc)) if len(at) else (at, doc)
                if len(at):
                    row = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), longs(found[at]), *(batch.column(c).take(row) for c in ("id", "tkey"))], ["k", "seed", "id", "tkey"])

    return seeds


def _paired(coverage: float):
    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, first = tokens_of(batch.column("text"))
            items, begin = tokens_of(batch.column("item"))
            rows = []
            for d in range(batch.num_rows):
                text, item = tokens[first[d] : first[d + 1]], items[begin[d] : begin[d + 1]]
                k = min(LEAST, len(item))
                covered, n = judged(text, item, np.flatnonzero(np.isin(runs(text, k), runs(item, k))))
                if covered >= coverage * len(item):
                    rows.append((d, covered, len(item), n))
            d, *rest = ([list(x) for x in zip(*rows, strict=True)]) if rows else ([], [], [], [])
            d = pa.array(d, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(d) for c in ("doc_id", "tkey", "item_id")), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "tkey", "item_id", "covered_tokens", "item_tokens", "n_tiles"])

    return paired


RESULT = "doc_id long, tkey long, item_id long, covered_tokens long, item_tokens long, n_tiles long"


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, max_sent_tokens: int = MAX_SENT_TOKENS) -> DataFrame:
    """doc_id, item_id, covered_tokens, item_tokens, n_tiles (and tkey) of each contaminated document and item.

    Texts and items without tokens, null ones included, meet nothing. Repeated rows of documents are each reported; a null
    doc_id is reported as null, items with a null item_id are left out. Other columns are not read. With a larger benchmark
    than ``max_sent_tokens`` the seeds are joined by shuffle, with equal results: only the texts' seeds that a table of ``CELLS``
    bits does not rule out. Very long texts are read whole; of equal matches the first in the item, then in the text, is taken.
    """
    spark = docs.sparkSession
    text_session(spark)
    texts = id_name(docs).withColumn("tkey", F.xxhash64("text"))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size <= 4 * max_sent_tokens:
        rows = items.orderBy("item_id", "text").collect()
        sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))
        return texts.mapInArrow(_contaminated(sent, coverage), RESULT)
    kind = "k int, seed long, id long, tkey long"
    of_items = cut(items.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("tkey"), "text").mapInArrow(_item_seeds, kind), "seeds", texts=True)
    lengths = sorted(r["k"] for r in of_items.select("k").distinct().collect())  # LEAST rows at most
    words = of_items.groupBy(F.shiftrightunsigned("seed", 46).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(seed, 40) & 63 as int)))").alias("bits"))
    cells = np.zeros(CELLS // 64, np.int64)
    for r in words.toLocalIterator():  # CELLS / 64 rows at most
        cells[r["word"]] = r["bits"]
    sent = spark.sparkContext.broadcast(cells.view(_U))
    of_docs = texts.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "tkey", "text").mapInArrow(_text_seeds(sent, lengths), kind)
    meet = of_docs.join(of_items.distinct().select("k", "seed", F.col("id").alias("item_id"), F.col("tkey").alias("ikey")), ["k", "seed"])
    meet = cut(meet.select(F.col("id").alias("key"), "tkey", "item_id", "ikey").distinct(), "meet")
    pairs = texts.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).join(meet, ["key", "tkey"])
    pairs = pairs.join(items.select("item_id", F.xxhash64("text").alias("ikey"), F.col("text").alias("item")).distinct(), ["item_id", "ikey"])
    return pairs.select("doc_id", "tkey", "item_id", "text", "item").mapInArrow(_paired(coverage), RESULT)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, all columns kept, that no item contaminates; rows with a null doc_id are judged by their text."""
    found = cut(contaminations(docs, benchmark, coverage).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key_id"), F.col("tkey").alias("key_text")).distinct(), "contaminated", texts=True)
    return joined(marked(docs), found, ["key_id", "key_text"], "left_anti").select("whole.*")
