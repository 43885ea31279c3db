"""URL filter: allow and block rules first, then a ratio of character language models.

Two variable-order Markov models, smoothed by interpolated modified Kneser-Ney (``llm.kneser_ney``), are counted over the
distinct urls that the rules allow and those that they block, without the parts of host and path that rules name: those say which
rule fits, not what such urls are like. A url no rule decides gets the difference of its log likelihoods, blocked less
allowed, divided by its length. Hosts fall into two halves, and each url is scored by the models of the half its host is not in, so
that known hosts have no say. A url is blocked above a threshold that is calibrated on the urls that rules decide, scored
the same way: halfway between a high quantile of the allowed ones and a low quantile of the blocked ones, but never below the former.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, slices, texts_of
from llm.kneser_ney import by_document, fits, gram_counts, grams_of, model_of, packed_models, sharded_scores, smoothed

ORDER = 6
#: Share of allowed urls that the calibrated threshold lets be blocked.
FALSE_BLOCKS = 0.01
#: Share of blocked urls that may fall below the threshold.
MISSED_BLOCKS = 0.1
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES):
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def likeness(text, host, path, rule, rules=RULES):
    """What the models see of a url: not the host and the beginning of the path that its rule names, and so that urls with and without
    a rule are told alike, neither the last label of the host nor the first segment of the path."""
    label, segment = F.length(F.regexp_extract(host, r"([^.]*)$", 1)), F.length(F.regexp_extract(path, r"^(/[^/]*/?)", 1))
    size = lambda part: F.coalesce(F.create_map(*(F.lit(x) for r, _ in rules for x in (r, part(r))))[rule], F.lit(0)) if rules else F.lit(0)
    named, begun = size(lambda r: r.index("/")), size(lambda r: len(r) - r.index("/"))
    scheme = F.regexp_extract(text, r"(?s)^(.*?://)", 1)
    rest = F.substr(text, F.length(scheme) + F.length(host) + F.length(path) + 1)
    return F.when(scheme != "", F.concat(scheme, F.left(host, F.length(host) - F.greatest(label, named)), F.substr(path, F.greatest(segment, begun) + 1), rest)).otherwise(text)


def _ratios(sent, order: int):
    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: model_of(data, order) for name, data in sent.value.items()}
        for batch in slices(batches):
            grams, places = grams_of(*texts_of(batch.column("text")), order)
            n = np.diff(places)
            log = {name: by_document(model.logs(grams), places) for name, model in held.items()}
            half = batch.column("half").to_numpy()
            ratio = np.zeros(len(n))
            for own, other in ((0, "1"), (1, "0")):
                if f"block{other}" in log and f"allow{other}" in log:
                    ratio = np.where((half == own) & (n > 0), (log[f"block{other}"] - log[f"allow{other}"]) / np.maximum(n, 1), ratio)
            yield batch.append_column("ratio", pa.array(ratio))

    return ratios


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (and ratio) of every row.

    A null url and one without ``://`` have an empty host and path, no rule and a ratio like any other text; a null or empty
    text has ratio 0. Without both allowed and blocked urls to learn from, the method allows. Repeated rows are each
    returned; they count once in the models. Very long urls are scored whole. Other columns are not read, whatever their names.
    """
    spark = pages.sparkSession
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("text"))
    rows = rows.withColumns({"host": host_of(F.col("text")), "path": path_of(F.col("text"))}).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.create_map(*(F.lit(x) for r in rules for x in r))[F.col("rule")] if rules else F.lit(None).cast("string")
    rows = rows.withColumn("ruled", F.when(F.col("rule").isNotNull(), ruled)).withColumn("text", likeness(F.col("text"), F.col("host"), F.col("path"), F.col("rule"), rules))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("host"), F.lit(2)).cast("int"))
    urls = rows.where("ruled is not null").select("text", F.concat("ruled", F.col("half").cast("string")).alias("lang")).distinct()
    entries = smoothed(gram_counts(urls, ORDER), ORDER)
    if fits(entries):
        sent = spark.sparkContext.broadcast(packed_models(entries))
        scored = rows.mapInArrow(_ratios(sent, ORDER), "page_id long, text string, host string, path string, rule string, ruled string, half int, ratio double")
    else:
        scored = rows.withColumn("tkey", F.xxhash64("text", "half"))
        texts = scored.select("tkey", "text", "half").where("text is not null").distinct()
        for name in ("allow", "block"):
            other = F.concat(F.lit(name), (1 - F.col("half")).cast("string"))
            logs = sharded_scores(texts.select(F.lit(0).cast("long").alias("doc_id"), "tkey", "text", other.alias("lang")), entries, ORDER)
            scored = scored.join(logs.select("tkey", (F.col("log") / F.col("n")).alias(name)), "tkey", "left")
        scored = scored.withColumn("ratio", F.coalesce(F.col("block") - F.col("allow"), F.lit(0.0)))
    scored = cut(scored.select("page_id", "text", "host", "path", "rule", "ruled", "ratio"), "urls")
    known = scored.where("ruled is not null")
    allowed, blocked = (F.percentile_approx(F.when(F.col("ruled") == name, F.col("ratio")), q, 10_000) for name, q in (("allow", 1 - FALSE_BLOCKS), ("block", MISSED_BLOCKS)))
    low, high = (x or 0.0 for x in known.agg(allowed, blocked).first())
    limit = max(low, (low + high) / 2)
    method = F.when(F.col("ratio") > F.lit(limit), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "ratio")
