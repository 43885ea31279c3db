"""Phrase collocation mining on position bitmaps, in the way of SPAM.

A shard is a run of documents read by a task. Its words are numbered place by place, with an empty place before each piece, and each word has
a bitmap of its places, held as those 16-place blocks that are not empty. A phrase's bitmap marks where it ends: shifted by
one place and ANDed with a word's bitmap it is that of the longer phrase, the empty places keep it from passing the end of a
piece, and its popcount is the phrase's count in the shard. Shards know nothing of each other; counts are summed by Spark.

Three passes read the texts: words; pairs of frequent words, by hash; all phrases, the pairs in which are frequent, depth first. What is frequent
goes to the tasks as a table of fixed size, whatever its number; a bit set by chance costs rows, never results, as all
sums are held against the least count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import Words, cut, longs, mix, slices, text_session, texts_of, _LOWER, _R

#: Words of the longest phrase, the least count, phrases told for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Places of a block.
BLOCK = 16
#: Unknown language.
UNKNOWN = "und"
_U = np.uint64
_SEPARATES, _ENDS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_SEPARATES[[32, 9]] = True
_SEPARATES |= _ENDS
COUNTS = "lang string, phrase string, a long"


class Sizes(NamedTuple):
    """Bits of the table of frequent words or pairs as a power of two (16 MB), bytes of text of a shard (a longer text is one by
    itself), and blocks that are extended at once on the way down. Results do not depend on them."""

    cells: int = 27
    shard_bytes: int = 2_000_000
    bundle: int = 200_000


def language_keys(langs: list[str]) -> np.ndarray:
    keys = {lang: int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") for lang in set(langs)}
    return np.array([keys[lang] for lang in langs], _U)


def word_keys(hashes: np.ndarray, language: np.ndarray) -> np.ndarray:
    return mix(hashes * _R + language)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _R + right)


class Shard:
    """The words of some documents: key (word and language), number of the distinct word, place, and how to spell them."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = texts_of(batch.column("text"))
        self.words = words = Words(data, offsets, _SEPARATES)
        self.langs = batch.column("lang").to_pylist()
        self.of = np.repeat(np.arange(len(self.langs)), np.diff(words.first))
        n = len(words.start)
        self.keys = word_keys(words.hashes(lower=True), language_keys(self.langs)[self.of])
        ends = np.r_[0, np.cumsum(_ENDS[data], dtype=np.int32)]
        opens = np.ones(n, bool)
        opens[1:] = (ends[words.start[1:]] > ends[words.end[:-1]]) | (self.of[1:] > self.of[:-1])
        self.places = np.arange(n) + np.cumsum(opens)
        self.lower = _LOWER[data].tobytes()

    def spelt(self, word: int) -> bytes:
        return self.lower[self.words.start[word] : self.words.end[word]]


class Bitmaps:
    """Blocks by place, then item: block number, item, and the bits of the item's places in it; a block is no row if it is empty."""

    def __init__(self, block: np.ndarray, item: np.ndarray, bits: np.ndarray):
        self.block, self.item, self.bits = block, item, bits

    @classmethod
    def of(cls, places: np.ndarray, item: np.ndarray) -> Bitmaps:
        block = places // BLOCK
        order = np.lexsort((item, block))
        block, item, bit = block[order], item[order], np.uint16(1) << (places[order] % BLOCK).astype(np.uint16)
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (item[1:] != item[:-1])][: len(block)])
        return cls(block[new], item[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit)

    def shifted(self) -> Bitmaps:
        """One place on; the last place of a block goes to the first of the next."""
        bits, carry = (self.bits << np.uint16(1)), np.flatnonzero(self.bits >> np.uint16(BLOCK - 1))
        stay = np.flatnonzero(bits)
        return Bitmaps(np.r_[self.block[stay], self.block[carry] + 1], np.r_[self.item[stay], self.item[carry]], np.r_[bits[stay], np.ones(len(carry), np.uint16)])

    def anded(self, other: Bitmaps, begins: np.ndarray, bundle: int = Sizes().bundle) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """All pairs of an item here and one of ``other`` that share a place: the two items, and the common places as the bitmap of
        the pair's row. ``begins``: where each block of ``other`` begins."""
        inside = self.block < len(begins) - 1
        block, item, bits = self.block[inside], self.item[inside], self.bits[inside]
        first = begins[block]
        count = begins[block + 1] - first
        left, right, row, common = [], [], [], []
        whole = np.r_[0, np.cumsum(count)]
        at = 0
        while at < len(block):  # so many rows at once that few pairs are looked at
            to = max(int(np.searchsorted(whole, whole[at] + 10 * bundle, "right")) - 1, at + 1)
            mine = np.repeat(np.arange(at, to), count[at:to])
            yours = np.arange(len(mine)) - np.repeat(whole[at:to] - whole[at], count[at:to]) + first[mine]
            both = bits[mine] & other.bits[yours]
            some = np.flatnonzero(both)
            left.append(item[mine[some]])
            right.append(other.item[yours[some]])
            row.append(block[mine[some]])
            common.append(both[some])
            at = to
        empty = np.zeros(0, np.int64)
        join = lambda parts, kind: np.concatenate(parts) if parts else empty.astype(kind)
        row = join(row, np.int64)
        return join(left, np.int64), join(right, np.int64), Bitmaps(row, row, join(common, np.uint16))

    def begins(self, blocks: int) -> np.ndarray:
        return np.searchsorted(self.block, np.arange(blocks + 1))


def grouped(left: np.ndarray, right: np.ndarray, width: int, bitmaps: Bitmaps) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bitmaps]:
    """Distinct pairs of items, their popcounts, and their bitmaps numbered by pair."""
    pair, number = np.unique(left * width + right, return_inverse=True)
    count = np.bincount(number, np.bitwise_count(bitmaps.bits), len(pair)).astype(np.int64)
    return pair // max(width, 1), pair % max(width, 1), count, Bitmaps(bitmaps.block, number, bitmaps.bits)


def is_set(cells: np.ndarray, keys: np.ndarray) -> np.ndarray:
    cell = keys >> _U(64 - 6 - (len(cells).bit_length() - 1))
    return (cells[(cell >> _U(6)).astype(np.int64)] >> (cell & _U(63)) & _U(1)).astype(bool)


class Pairs:
    """The bitmaps of the pairs of frequent words of a shard: first and second word, count, and where they end."""

    def __init__(self, shard: Shard, frequent: np.ndarray):
        at = np.flatnonzero(is_set(frequent, shard.keys))
        keys, example, number = np.unique(shard.keys[at], return_index=True, return_inverse=True)
        self.keys, self.example = keys, at[example]
        words = Bitmaps.of(shard.places[at], number.astype(np.int64))
        self.blocks = int(shard.places[-1]) // BLOCK + 1 if len(shard.places) else 0
        left, right, common = words.shifted().anded(words, words.begins(self.blocks))
        self.left, self.right, self.count, self.ends = grouped(left, right, len(keys), common)


def _rows(langs: list[str], phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "a"])


def _shards(count: Callable, shard_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=shard_bytes):
            yield from count(Shard(batch))

    return each


def _words(shard: Shard) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words of a language (null)."""
    _, example, count = np.unique(shard.keys, return_index=True, return_counts=True)
    yield _rows([shard.langs[d] for d in shard.of[example].tolist()], [shard.spelt(i) for i in example.tolist()], count)
    total = np.bincount(shard.of, minlength=len(shard.langs))
    yield _rows(shard.langs, [None] * len(shard.langs), total)


def _pairs(frequent) -> Callable:
    """Counts of pairs of frequent words by their key: it only rules pairs out, the next pass counts those that stay by their words."""

    def count(shard: Shard) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(shard, frequent.value)
        yield pa.RecordBatch.from_arrays([longs(pair_keys(pairs.keys[pairs.left], pairs.keys[pairs.right])), pa.array(pairs.count)], ["key", "a"])

    return count


def _longer(frequent, paired, longest: int, bundle: int) -> Callable:
    """Counts of phrases of two words and more: from each pair down the tree of phrases, a bundle of branches at a time."""

    def count(shard: Shard) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(shard, frequent.value)
        good = is_set(paired.value, pair_keys(pairs.keys[pairs.left], pairs.keys[pairs.right]))
        number = np.cumsum(good) - 1
        stay = good[pairs.ends.item]
        block, item, bits = pairs.ends.block[stay], number[pairs.ends.item[stay]], pairs.ends.bits[stay]
        order = np.argsort(block, kind="stable")
        steps = Bitmaps(block[order], item[order], bits[order])
        begins = steps.begins(pairs.blocks)
        second, width = pairs.right[good], int(good.sum())
        spelt = [shard.spelt(i) for i in pairs.example.tolist()]
        lang = [shard.langs[d] for d in shard.of[pairs.example].tolist()]

        def down(path: np.ndarray, ends: Bitmaps) -> Iterator[pa.RecordBatch]:
            """Rows of ``path`` are phrases by word number; ``ends`` their bitmaps. A pair that ends one place on begins with the
            phrase's last word, so the AND with pairs extends by frequent pairs only."""
            order = np.argsort(ends.item, kind="stable")
            ends = Bitmaps(ends.block[order], ends.item[order], ends.bits[order])
            at = 0
            while at < len(ends.item):
                to = len(ends.item)
                if to - at > bundle:  # whole phrases, so that each is counted once in a shard
                    to = int(np.searchsorted(ends.item, ends.item[at + bundle], "left"))
                    to = to if to > at else int(np.searchsorted(ends.item, ends.item[at], "right"))
                some = Bitmaps(ends.block[at:to], ends.item[at:to], ends.bits[at:to])
                parent, step, count, below = grouped(*_split(some.shifted().anded(steps, begins, bundle), width))
                if len(parent):
                    longer = np.c_[path[parent], second[step]]
                    yield _rows([lang[p] for p in longer[:, 0].tolist()], [b" ".join([spelt[w] for w in p]) for p in longer.tolist()], count)
                    if longer.shape[1] < longest:
                        yield from down(longer, below)
                at = to

        first = pairs.left[good]
        yield _rows([lang[v] for v in first.tolist()], [spelt[v] + b" " + spelt[w] for v, w in zip(first.tolist(), second.tolist(), strict=True)], pairs.count[good])
        if longest > 2 and width:
            yield from down(np.c_[pairs.left[good], second], steps)

    return count


def _split(found: tuple[np.ndarray, np.ndarray, Bitmaps], width: int) -> tuple:
    left, right, common = found
    return left, right, width, common


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of words (lang, phrase)."""
    for batch in slices(batches, "phrase"):
        words = Words(*texts_of(batch.column("phrase")), _SEPARATES)
        yield pa.RecordBatch.from_arrays([longs(word_keys(words.hashes(), language_keys(batch.column("lang").to_pylist())))], ["key"])


def table_of_bits(keys: DataFrame, size: int):
    """A table of 2**size bits with those of the keys set; at most 2**size / 64 numbers on the driver."""
    bit = f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int)))"
    rows = keys.groupBy(F.shiftrightunsigned(F.shiftrightunsigned("key", 64 - size), 6).alias("word")).agg(F.expr(bit).alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out.view(_U))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, sizes: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a): all phrases of one to ``longest`` words met ``least`` times or more; and (lang, n), all words counted."""
    text_session(docs.sparkSession)
    texts = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs["text"].cast("string").alias("text")).where("text is not null")

    def summed(count: Callable, by: list[str], kind: str, label: str) -> DataFrame:
        counts = texts.mapInArrow(_shards(count, sizes.shard_bytes), kind).groupBy(*by).agg(F.sum("a").alias("a"))
        return cut(counts.where(f"a >= {least}" + " or phrase is null" * (label == "words")), label, texts=True)

    words = summed(_words, ["lang", "phrase"], COUNTS, "words")
    totals, words = words.where("phrase is null").select("lang", F.col("a").alias("n")), words.where("phrase is not null")
    if longest < 2:
        return words, totals
    frequent = table_of_bits(words.select("lang", "phrase").mapInArrow(_keys, "key long"), sizes.cells)
    paired = table_of_bits(summed(_pairs(frequent), ["key"], "key long, a long", "pairs").select("key"), sizes.cells)
    return words.unionAll(summed(_longer(frequent, paired, longest, sizes.bundle), ["lang", "phrase"], COUNTS, "phrases")), totals


def scored(phrases: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase of two words and more that no longer one holds in ``share`` percent of its places.

    The cut of the lowest score counts, then the one after the fewest words. Products are decimals of 38 digits.
    """
    words = F.split("phrase", " ")
    sized = phrases.select("lang", "phrase", "a", words.alias("words"), F.size(words).alias("k"))
    whole = sized.where("k >= 2")
    cuts = whole.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "at", part(F.lit(1), F.col("at")).alias("head"), part(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    known = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    cuts = cuts.join(known, ["lang", "head"]).join(known.select("lang", F.col("head").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    score = "cast(1000BD * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0))) as long)"
    cuts = cuts.withColumn("score", F.expr(score))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("one")).select("lang", "phrase", "one.*")
    # contiguous parts of two words and more of each longer phrase, with the phrase's count
    inner = whole.where("k >= 3").select("lang", "words", "k", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "words", "longer", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("begin"))
    inner = inner.select("lang", part(F.col("begin"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = (F.lit(100) * F.col("longer") >= F.lit(share) * F.col("a")) & F.col("longer").isNotNull()
    return best.join(inner, ["lang", "phrase"], "left").where(~held).select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, count, and phrase in byte order.

    Null and empty texts and texts of marks only hold no words; a null language is ``und``. Repeated rows and rows with a null doc_id all
    count; very long texts are read whole, in a shard of their own; other columns are not read. No frequent phrase gives no rows.
    """
    found = scored(*frequent_phrases(docs, longest, least, sizes))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
