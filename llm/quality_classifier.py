"""Quality classifier: perplexity under a model of trusted text.

A modified Kneser-Ney byte model for each language is counted over the trusted documents; a share of them is kept out. Entries
that pass a size check go to the tasks; beyond that they and the documents' grams are dealt to shards and joined there
(``llm.kneser_ney.sharded_scores``), so no task needs the whole model. A document passes when its log perplexity is at most
its language's threshold: a high quantile of the trusted documents that were kept out, and an allowance that falls with the
root of the text's length. There is no lower threshold: trusted documents in the counts, and their copies, are likelier
than any kept out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, joined
from llm.kneser_ney import fits, gram_counts, sent_scores, sharded_scores, smoothed

ORDER = 5
#: Share of the trusted documents of a language that lie below its threshold.
QUANTILE = 0.95
#: Nats allowed for a text of one byte; the allowance falls with the root of the length.
SHORT = 1.0
HELD_OUT = 4
MISSING = -(2**63)


def quality_scores(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, log_perplexity, threshold, good (and n_bytes) of every row of ``docs(doc_id, text, lang)``.

    ``trusted(doc_id)`` names the trusted documents. Null, empty and blank texts have no perplexity and are not good. A language without
    trusted text has no threshold and its texts are good. A null language is one of its own, ``und``. Repeated rows are
    each returned; a null doc_id is returned as null and is never trusted. Very long texts are scored whole. Other columns are not read;
    an empty table gives an empty one.
    """
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(MISSING)).alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("tkey", F.xxhash64("text"))
    ids = cut(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    learned = joined(rows, cut(ids.where(~held), "learned"), ["doc_id"], "left_semi")
    entries = smoothed(gram_counts(learned, order), order)
    if fits(entries):
        scored = sent_scores(rows, entries, order).withColumn("level", -F.col("log") / F.col("n"))
    else:
        scores = sharded_scores(rows, entries, order).select("doc_id", "tkey", "lang", (-F.col("log") / F.col("n")).alias("level"))
        # as in grams_of: no white space at the beginning, one for a run of it
        counted = F.regexp_replace("text", r"^[\t-\r ]+|([\t-\r ])[\t-\r ]+", "$1")
        keys = rows.select("doc_id", "tkey", "lang", F.coalesce(F.octet_length(counted), F.lit(0)).cast("long").alias("n"))
        scored = keys.join(scores, ["doc_id", "tkey", "lang"], "left")
    scored = cut(scored, "levels", texts=True)
    known = joined(scored, cut(ids.where(held), "held"), ["doc_id"], "left_semi")
    limits = known.groupBy("lang").agg(F.percentile_approx("level", QUANTILE, 10_000).alias("limit"))
    out = scored.join(F.broadcast(limits), "lang", "left")  # one row for each language
    threshold = F.col("limit") + SHORT / F.sqrt(F.nullif(F.col("n"), F.lit(0)))
    good = (F.col("n") > 0) & F.coalesce(F.col("level") <= threshold, F.lit(True))
    return out.select(F.when(F.col("doc_id") != MISSING, F.col("doc_id")).alias("doc_id"), "lang", F.col("level").alias("log_perplexity"), threshold.alias("threshold"), good.alias("good"), F.col("n").alias("n_bytes"))
