"""Periodic runs: stretches of words that repeat with a period, found as Gusfield and Stoye find tandem repeats.

A text's words that may lie in a long run are told first: within such a run every gram of words comes again a period away.
What is left is put in one array of numbers, and its suffix tree is held as suffix array, common prefixes and the ranks of all stretches
of 2, 4, 8 ... words. Blocks of the Lempel-Ziv parse give pairs (start, period) that cover the leftmost place of each
square; from these, walks along suffix links - drop the first word, append it at the end, as long as the tree has such a path -
complete the vocabulary of squares. The leaves below a square are its places, and places next to each other merge into
runs. Squares whose half is a power itself are left out, so the period of a run is its least one.

All of it runs inside tasks, a few hundred KB of text at a time; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import Words, id_name, marked, runs, slices, text_session, texts_of

#: A run has at least so many words, and at least so many periods.
LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Pairs of places that are compared at once.
AT_ONCE = 1_000_000


# ---------------------------------------------------------------- words that may lie in a run


def suspects(hashes: np.ndarray, first: np.ndarray, least_length: int, least_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words outside which no run can lie.

    With k = least_length - 2 * least_length // least_periods, each gram of k words inside a run comes again in it one period away,
    and a period is at most the run's length over least_periods. Stretches of grams that come again so near are
    kept if they are long enough; as they shrink, "so near" does.
    """
    k = max(least_length - 2 * least_length // least_periods, 1)
    grams = runs(hashes, k) if k > 1 else hashes
    doc = np.searchsorted(first, np.arange(len(grams)), "right") - 1
    at = np.flatnonzero(np.arange(len(grams)) + k <= first[doc + 1]) if len(grams) else np.zeros(0, np.int64)
    order = at[np.lexsort((grams[at], doc[at]))]
    same = (grams[order[1:]] == grams[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    far = np.iinfo(np.int64).max
    step = np.where(same, order[1:] - order[:-1], far)
    near = np.full(len(grams) + 1, far)
    near[order[1:]] = step
    near[order[:-1]] = np.minimum(near[order[:-1]], step)
    live, opens = near[:-1] < far, np.zeros(len(grams) + 1, bool)
    opens[first[first <= len(grams)]] = True
    while True:
        alone = opens | ~np.r_[False, live]
        begin, end = np.flatnonzero(live & alone[:-1]), np.flatnonzero(live & (opens[1:] | ~np.r_[live[1:], False])) + k
        keep = end - begin >= least_length
        begin, end = begin[keep], end[keep]
        bound = np.zeros(len(near), np.int64)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            bound[a : b - k + 1] = (b - a) // least_periods
        now = near[:-1] <= bound[:-1]
        if (now == live).all():
            return begin, end
        live = now


# ---------------------------------------------------------------- the suffix tree of an array of numbers


class SuffixTree:
    """Suffix array, common prefixes and the names of all stretches of 2**l numbers; the last number must stand once.

    A place in the tree is a pair (i, n): the path of the n numbers from i on. Its suffix link is (i + 1, n - 1); the leaves below
    it are a range of the suffix array.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x, self.n = x, n
        name = np.unique(x, return_inverse=True)[1].astype(np.int32)
        self.names = [name]
        span = 1
        while n and int(name.max()) < n - 1:
            after = np.zeros(n, np.int64)
            after[: n - span] = name[span:] + 1 if span < n else 0
            name = np.unique(name.astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32)
            self.names.append(name)
            span *= 2
        self.rank = name
        self.suffix = np.empty(n, np.int64)
        self.suffix[name] = np.arange(n)
        prefix = np.zeros(n, np.int32)
        if n > 1:
            prefix[1:] = self.forward(self.suffix[:-1], self.suffix[1:])
        #: least common prefix of 2**l neighbours, ending at each rank
        self.low = [prefix]
        while 2 << len(self.low) - 1 <= n:
            last, half = self.low[-1], 1 << len(self.low) - 1
            wide = last.copy()
            wide[half:] = np.minimum(last[half:], last[:-half])
            self.low.append(wide)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers are equal from i and j on (i and j differ)."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            step = (name[i] == name[j]).astype(np.int64) << level
            i += step
            j += step
            total += step
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers are equal up to and with i and j; 0 before the first."""
        i, j, total = i + 1, j + 1, np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            a, b = i - width, j - width
            step = ((a >= 0) & (b >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << level
            i -= step
            j -= step
            total += step
        return total

    def leaves(self, i: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that start with the n numbers from i on."""
        low, high = self.rank[i].astype(np.int64), self.rank[i].astype(np.int64)
        for level in range(len(self.low) - 1, -1, -1):
            least, width = self.low[level], 1 << level
            low -= ((low - width >= 0) & (least[low] >= n)).astype(np.int64) << level
            to = high + width
            high += ((to < self.n) & (least[np.minimum(to, self.n - 1)] >= n)).astype(np.int64) << level
        return low, high

    def child(self, i: int, n: int, value: int) -> int:
        """A start of the path (i, n) followed by value, or -1."""
        low, high = (int(v[0]) for v in self.leaves(np.array([i]), np.array([n])))
        ranks = range(low, high + 1)
        at = bisect_left(ranks, value, key=lambda r: self.x[self.suffix[r] + n])
        found = int(self.suffix[ranks[at]]) if at < len(ranks) else -1
        return found if found >= 0 and self.x[found + n] == value else -1

    def earlier(self) -> np.ndarray:
        """For each place the length of the longest stretch from it on that also starts before it."""
        before, after = np.full(self.n, -1, np.int64), np.full(self.n, -1, np.int64)
        stack: list[int] = []
        for i in self.suffix.tolist():
            while stack and stack[-1] > i:
                after[stack.pop()] = i
            if stack:
                before[i] = stack[-1]
            stack.append(i)
        longest = np.zeros(self.n, np.int64)
        for other in (before, after):
            at = np.flatnonzero(other >= 0)
            longest[at] = np.maximum(longest[at], self.forward(other[at], at))
        return longest


def blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest stretch that starts before it too, or one new number."""
    longest, starts, at = tree.earlier().tolist(), [], 0
    while at < tree.n:
        starts.append(at)
        at += max(longest[at], 1)
    return np.array(starts, np.int64)


def leftmost_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) pairs from which rotations to the right reach the leftmost place of every square.

    The last word of a leftmost square lies in a block that begins after the square does, at h. Where h is in the first half or
    the middle, the period is at most that block's length; where h is in the second half, at most this block's and the last one's.
    """
    start = blocks(tree)
    size = np.diff(np.r_[start, tree.n])
    found = []
    for second_half, most in ((False, size), (True, size + np.r_[0, size[:-1]])):
        whole = np.r_[0, np.cumsum(most)]
        for a in range(0, int(whole[-1]), AT_ONCE):
            at = np.arange(a, min(a + AT_ONCE, int(whole[-1])))
            block = np.searchsorted(whole, at, "right") - 1
            h, k = start[block], at - whole[block] + 1
            inside = (h - k >= 0) & (h > 0) if second_half else (h + k < tree.n) & (h > 0)
            h, k = h[inside], k[inside]
            i = h - k if second_half else h
            right, left = tree.forward(i, i + k), tree.backward(i - 1, i + k - 1)
            # starts of squares of period k around this place, and those that the case allows
            low, high = np.maximum(i - left, h - 2 * k + 1 if second_half else h - k), np.minimum(i + right - k, h - k - 1 if second_half else h - 1)
            good = (low <= high) & (low >= 0)
            found.append((low[good], k[good]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def primitive(tree: SuffixTree, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k numbers from i on, first half of a square, are no power of something shorter."""
    good, rest, prime = np.ones(len(i), bool), k.copy(), 2
    while len(rest) and int(rest.max()) > 1:
        if prime * prime > int(rest.max()):
            divides, by = rest > 1, rest  # what is left is prime itself
        else:
            divides, by = rest % prime == 0, np.full(len(rest), prime)
        at = np.flatnonzero(divides)
        part = k[at] // by[at]
        good[at] &= tree.forward(i[at], i[at] + part) < k[at] - part
        if by is rest:
            break
        while (again := (rest % prime == 0) & (rest > 0)).any():
            rest[again] //= prime
        prime += 1 if prime == 2 else 2
    return good


def vocabulary(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """One (start, period) for each different square of a word that is no power, by walks along suffix links."""
    i, k = leftmost_squares(tree)
    good = primitive(tree, i, k)
    seen, starts, periods = set(), [], []
    x = tree.x.tolist()
    names, n = tree.names, tree.n
    for at, period in sorted(zip(i[good].tolist(), k[good].tolist(), strict=True)):
        length = 2 * period
        level = length.bit_length() - 1
        name, back = names[level] if level < len(names) else None, length - (1 << level)
        while at >= 0:
            # two stretches of 2**level numbers name the square; where no such stretch comes again, its place does
            key = (length, int(name[at]), int(name[at + back])) if name is not None else (length, at)
            if key in seen:
                break
            seen.add(key)
            starts.append(at)
            periods.append(period)
            # along the suffix link, then down the branch of the word that was dropped
            at = at + 1 if at + length < n and x[at + length] == x[at] else tree.child(at + 1, length - 1, x[at])
    return np.array(starts, np.int64), np.array(periods, np.int64)


def repetitions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and least period of every maximal stretch of at least two periods; the last number must stand once."""
    tree = SuffixTree(x)
    i, k = vocabulary(tree)
    if not len(i):
        return i, i, k
    low, high = tree.leaves(i, 2 * k)
    count = high - low + 1
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place, period = tree.suffix[np.repeat(low, count) + inside], np.repeat(k, count)
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.r_[True, (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)]
    begin, end = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(place)] - 1
    return place[begin], place[end] - place[begin] + 2 * period[begin], period[begin]


def runs_of(words: Words, least_length: int, least_periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text of a slice, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    hashes = words.hashes()
    begin, end = suspects(hashes, words.first, least_length, least_periods)
    if not len(begin):
        return found
    size = end - begin
    offset = np.cumsum(size + 1) - size - 1
    # each stretch is followed by a number of its own, so nothing repeats across stretches
    x = np.empty(int((size + 1).sum()), np.int64)
    at = np.repeat(begin - offset, size) + (inside := np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size))
    numbers = np.unique(hashes[at], return_inverse=True)[1]
    x[inside] = numbers
    x[offset + size] = len(at) + np.arange(len(size))
    start, length, period = repetitions(x)
    keep = length >= np.maximum(least_length, least_periods * period)
    start, length, period = start[keep], length[keep], period[keep]
    stretch = np.searchsorted(offset, start, "right") - 1
    place = start - offset[stretch] + begin[stretch]
    doc = np.searchsorted(words.first, place, "right") - 1
    for j in np.lexsort((period, place)).tolist():
        d = int(doc[j])
        found[d].append((int(place[j] - words.first[d]), int(length[j]), int(period[j])))
    return found


# ---------------------------------------------------------------- operators


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run is cut to its first period."""
    gone = np.zeros(n + 1, np.int32)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def most_periods(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones the first, then that of the least period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _slices(read: Callable, least_length: int, least_periods: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*texts_of(batch.column("text")))
            yield read(batch, words, runs_of(words, least_length, least_periods))

    return each


def _digests(batch: pa.RecordBatch, words: Words, found: list) -> pa.RecordBatch:
    raw, first, rows = words.texts(), words.first.tolist(), []
    for a, b, mine in zip(first[:-1], first[1:], found, strict=True):
        kept = raw[a:b] if not mine else [raw[i] for i in (np.flatnonzero(kept_words(b - a, mine)) + a).tolist()]
        start, length, period = most_periods(mine) or (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in mine)
        milli = 1000 * length // period if mine else None
        rows.append((len(mine), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], DIGEST_NAMES)


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
DIGEST_NAMES = [c.split()[0] for c in DIGESTS.split(", ")]
RUNS = "doc_id long, runs array<struct<start:long, length:long, period:long>>"


def _lists(batch: pa.RecordBatch, words: Words, found: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in mine] for mine in found], kind)], ["doc_id", "runs"])


def _texts(batch: pa.RecordBatch, words: Words, found: list) -> pa.RecordBatch:
    texts, data = batch.column("text").to_pylist(), words.data.tobytes()
    for d, mine in enumerate(found):
        if mine:
            a, b = int(words.first[d]), int(words.first[d + 1])
            kept, out = kept_words(b - a, mine), []
            edge = np.flatnonzero(np.diff(np.r_[False, kept, False])).reshape(-1, 2) + a
            for x, y in edge.tolist():  # what stands between kept words stays as it was
                out.append(data[words.start[x] : words.end[y - 1]])
            texts[d] = b" ".join(out).decode()
    return pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(texts, pa.string())], ["whole", "text"])


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id and the runs of every row: start (word number), length and least period, by start, then period.

    Null, empty and short texts have none. Repeated rows and rows with a null doc_id are each judged by their text; other columns are not
    read; an empty table gives an empty one. Very long texts are read whole, in one task each: the tables of the suffix tree take
    about 8 bytes times the logarithm of their length for every word that may lie in a run. ``least_periods`` is 2 at least.
    """
    text_session(docs.sparkSession)
    return id_name(docs).mapInArrow(_slices(_lists, least_length, least_periods), RUNS)


def run_digests(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_runs, the run of most periods and its exponent, and digests of all runs and of the text cut to first periods.

    Rows as in ``periodic_runs``; without runs four columns are null and the text's digest is that of its words.
    """
    text_session(docs.sparkSession)
    return id_name(docs).mapInArrow(_slices(_digests, least_length, least_periods), DIGESTS)


def collapsed(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``docs``, all columns kept, with each run in ``text`` cut to its first period; texts without runs stay byte for byte."""
    text_session(docs.sparkSession)
    rows = marked(docs).selectExpr("whole", "cast(whole.text as string) as text")
    kind = T.StructType([T.StructField("whole", docs.schema), T.StructField("text", T.StringType())])
    out = rows.mapInArrow(_slices(_texts, least_length, least_periods), kind)
    return out.select(F.col("whole").withField("text", F.col("text").cast(docs.schema["text"].dataType)).alias("whole")).select("whole.*")
