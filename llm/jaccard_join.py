"""N-gram Jaccard join: exact near-duplicate groups over sets of five-word shingles.

A size-aware heavy-light join. Documents with equal sets are folded first. Two sets of sizes s and t have a Jaccard
similarity of at least 0.8 exactly when they share o(s, t) = ceil(4 (s + t) / 9) shingles.

* Light sets (size up to a boundary chosen by cost) enumerate their subsets of o(s, t) shingles for each partner size t.
  Two sets of these sizes that meet in one subset are linked, so each subset's list is a star and no pair is checked.
* Heavy sets are found by scanning inverted lists of the rarest fifth of their shingles, which any linked pair shares.
  "Rare" is a global order: bucketed corpus frequency of the frequent shingles, then the hash. Short lists give all their
  pairs, long lists one leader for each member; the pairs are checked against the whole sets. Links found so far make
  components, and long lists are then searched again for pairs that are still in different components only. So a list
  within one group of copies costs its length, and no link that joins two groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import Words, cut, drop, id_name, joined, longs, marked, mix, runs, slices, texts_of
from llm.components import components

SHINGLE = 5
#: At most so many shingles are ranked as frequent and sent to the tasks (8 bytes each); rarer ones rank by hash alone.
#: Any order gives the same links, a shorter table only longer lists.
MAX_FREQUENT = 1 << 19
#: Lists of at most so many sets give all their pairs at once.
SHORT_LIST = 8
#: Cost of checking one candidate set, in list entries; the light boundary is the cheapest size for the whole corpus.
CHECK_COST = 12
#: Rounds that link the members of long lists to hubs before the exact search of what is left.
HUB_ROUNDS = 2
LARGEST_LIGHT = 24
#: Lists of shingles met 2**HOT_LEVEL times or more are dealt to several tasks, each of about so many entries.
HOT_LEVEL = 16
_U = np.uint64


def part_of(level: int) -> str:
    """SQL of the part of a list that an entry belongs to: the level stands in a token's first bits, and a hot list has about as
    many parts as its entries need."""
    return f"pmod(xxhash64(doc), shiftleft(1, greatest(cast(shiftrightunsigned(token, 58) as int) - {level - 1}, 0)))"


def needed(s: int, t: int) -> int:
    return (4 * (s + t) + 8) // 9


def partner_sizes(s: int) -> range:
    return range((4 * s + 4) // 5, 5 * s // 4 + 1)


def shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    data, offsets = texts_of(batch.column("text"))
    words = Words(data, offsets)
    hashes = words.hashes(lower=True)
    grams = runs(hashes, SHINGLE)
    first = words.first.tolist()
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:  # the whole sequence is the one shingle; its length keeps it apart from longer ones
            yield mix(runs(hashes[a:b], b - a) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: shingles met in two documents or more of the same stretch of input, and small set sizes."""
    held: list[np.ndarray] = []
    sizes = np.zeros(64, np.int64)

    def flush():
        keys, counts = np.unique(np.concatenate(held or [np.zeros(0, _U)]), return_counts=True)
        held.clear()
        more = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(more.sum(), np.int32)), longs(keys[more]), pa.array(counts[more])], ["kind", "key", "n"])

    waiting = 0
    for batch in slices(batches):
        for s in shingle_sets(batch):
            held.append(s)
            waiting += len(s)
            if 0 < len(s) < 64:
                sizes[len(s)] += 1
        if waiting > 1_200_000:
            yield flush()
            waiting = 0
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(64, np.int32)), pa.array(np.arange(64)), pa.array(sizes)], ["kind", "key", "n"])


def survey(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The frequent shingles in hash order with their rank buckets, and the largest light size."""
    counts = cut(docs.mapInArrow(_survey, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 1 or kind = 1"), "survey", texts=True)
    levels = {r["level"]: r["count"] for r in counts.where("kind = 0").groupBy(F.floor(F.log2("n")).alias("level")).count().collect()}
    least, total = 63, 0
    while least > 1 and total + levels.get(least - 1, 0) <= MAX_FREQUENT:
        least -= 1
        total += levels.get(least, 0)
    kept = counts.where(f"kind = 0 and n >= {2**least}").select("key", F.floor(F.log2("n")).cast("int").alias("level")).toArrow()
    sizes = {r["key"]: r["n"] for r in counts.where("kind = 1").collect()}
    drop(counts)
    keys = kept["key"].to_numpy().view(_U)
    order = np.argsort(keys)
    return keys[order], kept["level"].to_numpy().astype(np.uint8)[order], light_boundary(sizes)


def light_boundary(sizes: dict[int, int]) -> int:
    """The size up to which enumerating subsets is cheaper than scanning lists and checking, over all sets.

    ``sizes``: how many sets there are of each size below 64. A boundary makes sets of up to a quarter more enumerate too,
    for their partners at or below it.
    """

    def cost(boundary: int) -> int:
        total = 0
        for s, n in sizes.items():
            total += n * sum(comb(s, needed(s, t)) for t in partner_sizes(s) if min(s, t) <= boundary)
            if s > boundary:
                total += n * (s - (4 * s + 4) // 5 + 1 + CHECK_COST)
        return total

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def subset_keys(s: np.ndarray, light: int) -> np.ndarray:
    """One key for each subset of o(s, t) shingles and partner size t, where the smaller of both sizes is light.

    The two lowest bits tell the set's part in the pair of sizes: 0 of equal ones, 1 the larger, 2 the smaller. Sets of one
    size that meet under a pair of different sizes share too little to be linked by that.
    """
    n, out = len(s), []
    total = s.sum(dtype=_U)
    for t in partner_sizes(n):
        if min(n, t) > light:
            continue
        gone = n - needed(n, t)
        sums = np.array([sum(map(int, c)) % 2**64 for c in combinations(s.tolist(), gone)], _U)
        pair = _U(max(n, t) * 4096 + min(n, t))
        keys = mix(mix(total - sums) + mix(np.full(1, pair)))
        out.append(keys & ~_U(3) | _U(0 if n == t else 1 if n > t else 2))
    return np.concatenate(out) if out else np.zeros(0, _U)


def light_links(subsets: DataFrame) -> DataFrame:
    """Edges of ``subsets(doc_id, key)``: sets of one size are a star, others hang on the least set of the other size."""
    rows = subsets.select("doc_id", F.shiftright("key", 2).alias("list"), F.col("key").bitwiseAND(3).alias("part"))
    own = lambda k: F.when(F.col("part") == k, F.col("doc_id"))
    least = rows.groupBy("list").agg(*(F.min(own(k)).alias(f"least{k}") for k in range(3)), F.max(own(0)).alias("top"))
    least = least.where("least0 < top or least1 is not null and least2 is not null")
    hub = F.when(F.col("part") == 0, F.col("least0")).when(F.col("part") == 1, F.col("least2")).otherwise(F.col("least1"))
    return rows.join(least, "list").select(F.col("doc_id").alias("a"), hub.alias("b")).where("b is not null and a <> b").distinct()


def _profiles(sent, light: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, level = sent.value
        bits = np.zeros(1 << 22, bool)  # a quick no for most shingles
        bits[frequent >> _U(42)] = True
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for s in shingle_sets(batch):
                n = len(s)
                ranked, keys = np.zeros(0, _U), np.zeros(0, _U)
                if n > light:
                    rank = s >> _U(6)
                    maybe = np.flatnonzero(bits[s >> _U(42)])
                    if len(maybe):
                        at = np.minimum(np.searchsorted(frequent, s[maybe]), len(frequent) - 1)
                        hit = frequent[at] == s[maybe]
                        rank[maybe[hit]] |= level[at[hit]].astype(_U) << _U(58)
                    p = n - (4 * n + 4) // 5 + 1
                    ranked = np.sort(np.partition(rank, p - 1)[:p] if p < n else rank)
                if 0 < n <= 5 * light // 4:
                    keys = subset_keys(s, light)
                for out, v in zip(rows, (n, int(s.sum(dtype=_U).view(np.int64)), int(mix(s).sum(dtype=_U).view(np.int64)), ranked, keys), strict=True):
                    out.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())]
                + [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), longs(np.concatenate(x))) for x in rows[3:]],
                ["doc_id", "n", "d1", "d2", "ranked", "subsets"],
            )

    return profile


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inverted lists, in order of (token, n, doc): pairs of short lists and leader pairs of long ones.

    kind 0: a pair, how many short lists of this batch it shares, and both sizes; kind 2: the same of a long list's leader and
    members; kind 1: an entry of a long list, for the second search. A list that spans batches or
    tasks is continued by its parts: every part has leaders of its own, and all its entries go to the second search.
    """
    for batch in batches:
        token, doc, n, last = (batch.column(c).to_numpy() for c in ("token", "doc", "n", "last"))
        if not len(token):
            continue
        new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[new, len(token)])
        edge = np.zeros(len(new), bool)
        edge[[0, -1]] = True  # may go on in the neighbouring batch
        long = (size > SHORT_LIST) | edge | (token[new].view(_U) >> _U(58) >= HOT_LEVEL)  # a hot list has parts elsewhere
        short = []
        for m in range(2, SHORT_LIST + 1):
            at = new[(size == m) & ~long]
            for i in range(m if len(at) else 0):
                short += [(at + i, at + j) for j in range(i + 1, m)]
        inside = np.repeat(long, size)
        group = np.repeat(np.arange(len(new)), size)
        leaders = []
        if inside.any():
            where = np.flatnonzero(inside)
            order = where[np.lexsort((doc[where], group[where]))]
            leaders.append((order[np.searchsorted(group[order], group[order])], order))
        for kind, found in ((0, short), (2, leaders)):
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            ok = (doc[i] != doc[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            swap = doc[i] > doc[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                order = np.lexsort((doc[j], doc[i]))
                i, j = i[order], j[order]
                at = np.flatnonzero(np.r_[True, (doc[i][1:] != doc[i][:-1]) | (doc[j][1:] != doc[j][:-1])])
                yield _rows(kind, doc[i][at], doc[j][at], np.diff(np.r_[at, len(i)]), n[i][at] << 31 | n[j][at])
        if inside.any():
            yield _rows(1, token[inside], doc[inside], n[inside], last[inside])


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c.astype(np.int64)) for c in columns)], ["kind", "x", "y", "p", "q"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = list(shingle_sets(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), longs(np.concatenate(found)))], ["doc_id", "shingles"]
        )


def verified(docs: DataFrame, pairs: DataFrame, once: bool) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; ``once``: no two rows of ``docs`` share a doc_id."""
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), "ids")
    sets = joined(docs, ids, ["doc_id"], "left_semi").mapInArrow(_sets, "doc_id long, shingles array<long>")
    if not once:  # repeated rows give one set, other texts of one doc_id sets of their own
        sets = sets.groupBy("doc_id", F.xxhash64("shingles").alias("text")).agg(F.first("shingles").alias("shingles")).drop("text")
    sets = cut(sets, "sets", texts=True)
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    links = pairs.select("a", "b").join(b, "b").join(a, "a").where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")
    out = cut(links if once else links.distinct(), "links")
    drop(sets)
    drop(ids)
    return out


def mixed_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of long lists that hold sets of more than one component, with their components."""
    long = joined(lists, found.withColumnRenamed("node", "doc"), ["doc"], "left").withColumn("component", F.coalesce("component", "doc"))
    # sums of hot lists begin in the tasks, and the join has exchanges of its own in which they can be split
    mixed = cut(long.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token"), "mixed")
    out = cut(joined(long, mixed, ["token"], "left_semi"), "long")
    drop(mixed)
    return out


def hub_pairs(long: DataFrame) -> DataFrame:
    """For each set the likeliest hub of another component: of each list the set that stands in most long lists, which in a
    group of edited copies is the one with the fewest edits of its own; of all hubs the one met most often. One pair a set."""
    hubs = cut(long.groupBy("doc").agg(F.count("*").alias("lists")), "hubs")
    ranked = joined(long, hubs, ["doc"]).select("token", "doc", "n", "component", "lists")
    leader = cut(ranked.groupBy("token").agg(F.max_by(F.struct("doc", "component", "n"), F.struct("lists", -F.col("doc"))).alias("hub")), "leaders")
    met = joined(long, leader, ["token"]).where("component <> hub.component and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    # dealt once by doc, whose entries are no more than its shingles, for both sums
    met = met.select("doc", "n", F.col("hub.doc").alias("hub")).repartition("doc").groupBy("doc", "n", "hub").agg(F.count("*").alias("shared")).where("15 * shared >= n")  # less is hardly a link
    best = met.groupBy("doc").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    out = cut(best.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")), "spokes")
    drop(hubs)
    drop(leader)
    return out


#: What two linked sets may share beyond the shared part of their prefixes, at most; na and nb are their sizes.
BEYOND = "(greatest((4 * na + 4) div 5, (4 * nb + 4) div 5) - 1)"


def across_lists(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components in long lists that may be linked.

    Linked sets share at least ``need`` tokens of their prefixes: the needed overlap, less what may lie beyond the prefix that
    ends first. Of these the short lists hold ``short`` at most, so at least need - short stand in long lists, and then
    the sets share one of the first |T| - (need - short) + 1 of their tokens T in long lists. Only those are joined, sets
    with fewer tokens drop out, and pairs that meet are counted over all of T.
    """
    sides = pairs.select(F.col("a").alias("doc"), "short").unionAll(pairs.select(F.col("b").alias("doc"), "short"))
    short = sides.groupBy("doc").agg(F.max("short").alias("short"))
    sizes = long.groupBy("token").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    near = long.join(sizes, "token").groupBy("doc", "n", "last", "component").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.min("low").alias("low"), F.max("high").alias("high"))
    # what a partner of t tokens needs rises up to the own size and falls beyond it, but for rounding by one
    need = lambda t: F.expr(f"(4 * (n + {t}) + 8) div 9 - (greatest((4 * n + 4) div 5, (4 * {t} + 4) div 5) - 1)")
    near = near.join(short, "doc", "left").withColumns({"low": F.expr("greatest(low, (4 * n + 4) div 5)"), "high": F.expr("least(high, 5 * n div 4)")})
    near = near.withColumn("least", F.greatest(F.lit(1), F.least(need("low"), need("high") - 1) - F.coalesce("short", F.lit(0))))
    near = cut(near.where("size(tokens) >= least").select("doc", "n", "last", "component", "tokens", "least", F.coalesce("short", F.lit(0)).alias("short")), "near")
    slots = F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least").cast("int") + 1)).alias("pos", "token")
    first = near.select("doc", "n", "last", "component", "short", F.size("tokens").alias("size"), slots)
    left, right = (first.select("token", *(F.col(c).alias(f"{c}_{side}") for c in first.columns if c != "token")) for side in "ab")
    # once both sets are known, the same holds with their own sizes, and with the place in each set's tokens
    beyond = "case when last_a <= last_b then (4 * n_a + 4) div 5 - 1 else (4 * n_b + 4) div 5 - 1 end"
    least = F.greatest(F.lit(1), F.expr(f"(4 * (n_a + n_b) + 8) div 9 - ({beyond})") - F.least("short_a", "short_b"))
    room = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= least
    met = left.join(right, "token").where(room & F.expr("doc_a < doc_b and component_a <> component_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"))
    met = met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
    for side in ("a", "b"):
        met = joined(met, near.select(F.col("doc").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "last", "tokens", "short"))), [side])
    shared = F.size(F.array_intersect("tokens_a", "tokens_b")) + F.least("short_a", "short_b")
    return met.where(9 * (shared + F.expr(beyond)) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs(doc_id, text)``.

    Null, empty and blank texts: n_shingles 0 and a component of their own. Repeated rows: each is returned; rows that
    share a doc_id are one node. Null doc_id: the row is returned with a null component. Other columns are not read.
    Ties do not arise: the component's id is its least doc_id. An empty table gives an empty result.
    """
    docs = id_name(docs)
    frequent, level, light = survey(docs)
    if not len(frequent):
        frequent, level = np.zeros(1, _U), np.zeros(1, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast((frequent, level))  # MAX_FREQUENT entries at most
    profiles = cut(docs.mapInArrow(_profiles(sent, light), "doc_id long, n long, d1 long, d2 long, ranked array<long>, subsets array<long>"), "profiles", texts=True)
    sent.unpersist()

    # equal sets: one class, its least doc_id stands for it
    filled = profiles.where("n > 0 and doc_id is not null")
    repeated = cut(filled.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    once = not repeated.head(1)
    copies = cut(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    twins = joined(filled.select("doc_id", "n", "d1", "d2"), copies, ["n", "d1", "d2"]).where("doc_id <> rep")
    twins = cut(twins.distinct() if not once else twins, "twins")
    folded = joined(filled, twins.select("doc_id", "n", "d1", "d2"), ["doc_id", "n", "d1", "d2"], "left_anti")

    # light sets: every subset's list is a star
    subsets = folded.where(F.size("subsets") > 0).select("doc_id", F.explode("subsets").alias("key"))
    light_edges = light_links(subsets)

    # heavy sets: inverted lists
    entries = folded.where(F.size("ranked") > 0).select(F.col("doc_id").alias("doc"), "n", F.element_at("ranked", -1).alias("last"), F.explode("ranked").alias("token"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = entries.repartition(parts, "token", F.expr(part_of(HOT_LEVEL))).sortWithinPartitions("token", "n", "doc")
    scanned = cut(dealt.mapInArrow(_scan, "kind int, x long, y long, p long, q long"), "lists")
    pairs = scanned.where("kind <> 1").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("p").alias("shared"), F.sum(F.when(F.col("kind") == 0, F.col("p")).otherwise(0)).alias("short"), F.max("q").alias("sizes"))
    pairs = cut(pairs.select("a", "b", "shared", "short", F.shiftright("sizes", 31).alias("na"), F.col("sizes").bitwiseAND(2**31 - 1).alias("nb")), "pairs")
    # first the most promising partner of each set, then whatever may still join two components
    best = pairs.where("6 * shared >= least(na, nb) / 5").groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    best = cut(best, "best")
    links = light_edges.unionAll(verified(docs, best, once))
    if not once:  # a doc_id with several texts joins their classes; the copies of others only hang on theirs
        links = links.unionAll(joined(twins, repeated, ["doc_id"], "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links)

    def parts_of(some: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            some = joined(some, found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part")), [side], "left")
        return some.withColumns({f"{side}_part": F.coalesce(f"{side}_part", side) for side in "ab"}).where("a_part <> b_part")

    def grown(more: DataFrame) -> DataFrame:
        """The components with further links, found among those that the links join: roots only are linked and move."""
        roots = components(parts_of(more).select(F.col("a_part").alias("a"), F.col("b_part").alias("b")))
        moved = joined(found, roots.select(F.col("node").alias("component"), F.col("component").alias("top")), ["component"], "left")
        return cut(moved.select("node", F.coalesce("top", "component").alias("component")).unionAll(roots), "components")

    lists = scanned.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("doc"), F.col("p").alias("n"), F.col("q").alias("last"))
    for left_rounds in range(HUB_ROUNDS, -1, -1):
        long = mixed_lists(lists, found)
        lists = long.drop("component")  # components only grow, so lists that were of one stay so
        if not left_rounds:
            break
        more = verified(docs, hub_pairs(long), once)
        if not more.head(1):
            break
        found = grown(more)
    rest = parts_of(pairs).where(f"9 * (shared + {BEYOND}) >= 4 * (na + nb)").select("a", "b")
    rest = rest.unionAll(across_lists(long, pairs)).distinct()
    rest = cut(rest.join(best, ["a", "b"], "left_anti"), "rest")
    found = grown(verified(docs, rest, once))
    for done in (scanned, pairs, best, rest, long, copies):
        drop(done)
    # a copy is in the component of the set that stands for it
    hung = twins.select("doc_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    named = found.select(F.col("node").alias("doc_id"), "component")
    named = named.unionAll(hung) if once else named.unionAll(hung.join(named, "doc_id", "left_anti")).distinct()
    out = profiles.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that stand for their group: the least doc_id of each component.

    Of rows that share a doc_id one stays. Texts without words and rows with a null doc_id are in no group and stay.
    """
    groups = jaccard_groups(docs)
    gone = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("key_id")).distinct(), "gone")
    rows = marked(docs)
    repeated = cut(rows.groupBy("key_id").agg(F.count("*").alias("n")).where(f"n > 1 and key_id <> {-(2**63)}").select("key_id"), "repeated")
    kept = joined(rows, gone, ["key_id"], "left_anti")
    again = joined(kept, repeated, ["key_id"], "left_semi").withColumn("row", F.row_number().over(Window.partitionBy("key_id").orderBy("key_text")))
    return joined(kept, repeated, ["key_id"], "left_anti").select("whole.*").unionAll(again.where("row = 1").select("whole.*"))
