"""Byte-level BPE by overlapping chunks.

Long texts are cut into chunks that overlap. Each chunk is split into pre-tokens by itself, in parallel. The pattern looks
ahead only, so two splits that have one boundary in common have all later ones in common: where the boundaries of a chunk
and of the one before it first meet, the chunk takes over. The pieces between those places are then encoded, again in
parallel, and their ids are put together in order. A text in which two chunks never meet is encoded as one piece.
Short texts are one piece from the start. Decoding looks up the bytes of each id and concatenates them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, id_name, slices, text_session

#: Characters of a chunk, and of its overlap with the next one.
CHUNK = 32_000
OVERLAP = 500
#: Pre-tokens whose ids each task remembers.
REMEMBERED = 400_000


class Codec(dict):
    """Encoder and decoder of a rank file; as a dict it holds the ids of pre-tokens, as text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.bounds = regex.compile(pattern).finditer
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self.plain = regex.compile(r"[\x00-ɏ]*").fullmatch
        self.settled = regex.compile(r"[\x21-\x7e]|[¡-ɏ]").fullmatch

    def __missing__(self, token: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = ids = " ".join(map(str, self.encoding.encode_ordinary(token)))
        return ids

    def encode(self, text: str) -> str:
        """Decimal ids joined by spaces."""
        if self.plain(text):  # letters whose classes no two Unicode versions disagree on
            return " ".join(map(self.__getitem__, self.split(text)))
        return " ".join(map(str, self.encoding.encode_ordinary(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """Read once in each Python worker."""
    return Codec(path, pattern)


def _encoded(path: str, pattern: str):
    """Pieces to ids; what ``part`` says is passed on."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in slices(batches):
            ids = [code.encode(t or "") for t in batch.column("text").to_pylist()]
            yield batch.select(["doc_id", "tkey", "part"]).append_column("ids", pa.array(ids, pa.string()))

    return encoded


def _digests(path: str, pattern: str):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in slices(batches):
            rows: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                ids = code.encode(text or "")
                rows[0].append(ids.count(" ") + 1 if ids else 0)
                rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[2].append(hashlib.sha256(code.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _boundaries(path: str, pattern: str, overlap: int):
    """Where pre-tokens begin in the overlaps of each chunk with its neighbours, counted in the document's characters."""

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in slices(batches):
            heads, tails = [], []
            for text, begin, last in zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "last")), strict=True):
                found = [m.start() for m in code.bounds(text)]
                if not last:
                    found = found[:-2]  # the end of the chunk may have cut these short
                if not code.plain(text):  # only spaces between characters of known classes are boundaries for the library, too
                    found = [i for i in found if text[i] == " " and 0 < i < len(text) - 1 and code.settled(text[i - 1]) and code.settled(text[i + 1])]
                heads.append([begin + i for i in found if i <= 2 * overlap])
                tails.append([begin + i for i in found if i >= len(text) - 2 * overlap])
            kind = pa.list_(pa.int64())
            yield batch.select(["doc_id", "tkey", "part", "begin", "text"]).append_column("heads", pa.array(heads, kind)).append_column("tails", pa.array(tails, kind))

    return boundaries


def stitched(long: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, tkey, ids) of long texts, each made of pieces that were split and encoded apart from each other."""
    size = F.length("text")
    begins = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")), lambda i: i)
    chunks = long.select("doc_id", "tkey", "text", size.alias("size"), F.explode(begins).alias("part"))
    begin = F.greatest(F.lit(0), F.col("part") * chunk - overlap).cast("long")
    chunks = chunks.select("doc_id", "tkey", "part", begin.alias("begin"), F.expr(f"substring(text, greatest(0, part * {chunk} - {overlap}) + 1, {chunk + overlap} + least(part * {chunk}, {overlap}))").alias("text"), (begin + chunk + 2 * overlap >= F.col("size")).alias("last"))
    parts = max(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks = chunks.repartition(parts, "doc_id", "tkey", "part")
    kind = "doc_id long, tkey long, part int, begin long, text string, heads array<long>, tails array<long>"
    known = cut(chunks.mapInArrow(_boundaries(path, pattern, overlap), kind), "chunks", texts=True)
    # only the boundaries move to find the cuts; the texts stay in their chunks
    order = F.col("part")
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "tkey").orderBy(order)
    edges = known.select("doc_id", "tkey", "part", F.when(order == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(w)))).alias("cut"))
    edges = edges.select("*", F.lead("cut").over(w).alias("next"), F.lead("part").over(w).alias("more"))
    edges = edges.withColumn("whole", F.min(F.col("cut").isNotNull()).over(Window.partitionBy("doc_id", "tkey")))
    met = known.drop("heads", "tails").join(edges.where("whole"), ["doc_id", "tkey", "part"])
    pieces = met.select("doc_id", "tkey", "part", F.expr("substring(text, int(cut - begin) + 1, case when more is null then length(text) else int(next - cut) end)").alias("text"))
    apart = long.join(edges.where("not whole").select("doc_id", "tkey").distinct(), ["doc_id", "tkey"]).select("doc_id", "tkey", F.lit(0).alias("part"), "text")
    ids = pieces.unionAll(apart).where("text <> ''").mapInArrow(_encoded(path, pattern), "doc_id long, tkey long, part int, ids string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda x: x["ids"]), " ")
    return ids.groupBy("doc_id", "tkey").agg(joined.alias("ids"))


def _decoded(path: str, pattern: str):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern)
        for batch in slices(batches, column="ids"):
            rows = [(ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()) for ids in batch.column("ids").to_pylist()]
            n, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: of the decimal ids joined by spaces and of the bytes decoded.

    Null and empty texts have no ids; their digests are of the empty string. Repeated rows are each returned, whatever
    doc_id they share; a null doc_id is returned as null. Other columns are not read.
    """
    text_session(docs.sparkSession)
    docs = id_name(docs)
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).mapInArrow(_digests(path, pattern), DIGEST)
    long = docs.where(F.length("text") > chunk).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    once = long.groupBy("doc_id", "tkey").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    once = cut(once, "long")
    ids = stitched(once.drop("rows"), path, pattern, chunk, overlap)
    again = ids.join(once.select("doc_id", "tkey", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy")), ["doc_id", "tkey"])
    found = again.select("doc_id", "ids").mapInArrow(_decoded(path, pattern), DIGEST)
    return short.unionAll(found.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))))
