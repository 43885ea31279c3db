"""Conversations: history after the last summary, token budgets, page chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import scalar as s


def with_attachments(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    return messages.join(attachments, ["conv_id", "turn"], "left")


def after_summary(messages: DataFrame) -> DataFrame:
    """Messages later than their conversation's last summary; all where there is none. Summaries themselves go."""
    last = F.max(F.when(F.col("role") == "summary", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return messages.withColumn("since", last).where("role <> 'summary' and (since is null or turn > since)").drop("since")


def latest_summary(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'summary'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def token_sums(messages: DataFrame) -> DataFrame:
    return messages.where("role <> 'summary'").groupBy("conv_id").agg(F.coalesce(F.sum(s.token_estimate(F.col("text"))), F.lit(0)).alias("tokens"), F.count_if(F.col("role") == "user").alias("user_messages"))


def in_budget(messages: DataFrame, budget: int, reserve: int = 100) -> DataFrame:
    """The newest messages of each conversation that fit: from the end, until one would leave less than the reserve."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    used = F.sum(s.token_estimate(F.col("text"))).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return messages.withColumn("used", used).where(F.lit(budget) - F.col("used") >= reserve)


def kept_messages(messages: DataFrame, budget: int, reserve: int = 100, few: int = 4) -> DataFrame:
    """What goes to the model, with ``anchor``: all of a conversation that fits or has ``few`` messages; else its last document and
    the answer right after it whatever they take, and of the others the newest that leave the reserve of what is left.
    Summaries go; ``extracted`` is the text of an upload."""
    own, back = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    tokens = s.token_estimate(F.col("text"))
    has = (F.col("role") == "user") & (F.coalesce(F.col("extracted"), F.lit("")) != "")
    m = messages.where("role <> 'summary'").withColumns({"last": F.max(F.when(has, F.col("turn"))).over(own), "prior": F.lag("turn").over(own.orderBy("turn")), "total": F.sum(tokens).over(own), "n": F.count("*").over(own)})
    m = m.withColumn("anchor", F.coalesce((F.col("turn") == F.col("last")) | ((F.col("prior") == F.col("last")) & (F.col("role") == "assistant")), F.lit(False)))
    m = m.withColumns({"held": F.sum(F.when(F.col("anchor"), tokens).otherwise(0)).over(own), "used": F.sum(F.when(F.col("anchor"), 0).otherwise(tokens)).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    fits = (F.col("total") <= budget) | (F.col("n") <= few)
    return m.where(F.col("anchor") | fits | (F.lit(budget) - F.col("held") - F.col("used") >= reserve)).drop("last", "prior", "total", "n", "held", "used")


def to_summarise(messages: DataFrame, context: int, keep: int = 4, least: int = 6) -> DataFrame:
    """Conversations at 65 % of the context and six messages: all messages but the last four."""
    own = Window.partitionBy("conv_id")
    marked = messages.where("role <> 'summary'").withColumns({"sum": F.sum(s.token_estimate(F.col("text"))).over(own), "n": F.count("*").over(own), "back": F.row_number().over(own.orderBy(F.desc("turn")))})
    return marked.where((F.col("sum") >= int(context * 0.65)) & (F.col("n") >= least) & (F.col("back") > keep)).drop("sum", "n", "back")


def last_document_only(messages: DataFrame) -> DataFrame:
    """Content to send: the last document of a conversation in full, earlier ones by name; ``extracted`` and ``name`` may be null."""
    has = (F.col("role") == "user") & (F.coalesce(F.col("extracted"), F.lit("")) != "")
    last = F.max(F.when(has, F.col("turn"))).over(Window.partitionBy("conv_id"))
    full = F.concat(F.lit('<document name="'), "name", F.lit('">\n'), "extracted", F.lit("\n</document>\n\nВопрос: "), "text")
    short = F.concat(F.lit("[Ранее загружен документ: "), "name", F.lit("]\n\nВопрос: "), "text")
    return messages.withColumn("last", last).withColumn("content", F.when(has & (F.col("turn") == F.col("last")), full).when(has, short).otherwise(F.col("text"))).drop("last")


def chunk_starts(sizes: Column, budget: int) -> Column:
    """Places, from 1 on, of the items that begin a chunk when sizes are filled in greedily: a chunk ends before the item that
    would overflow it."""
    start = F.struct(F.lit(0).alias("place"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, size: Column) -> Column:
        new = (state["place"] == 0) | (state["size"] + size > budget)
        place = state["place"] + 1
        return F.struct(place.alias("place"), (F.when(new, F.lit(0)).otherwise(state["size"]) + size).cast("long").alias("size"), F.when(new, F.concat(state["starts"], F.array(place))).otherwise(state["starts"]).alias("starts"))

    return F.aggregate(sizes, start, step, lambda state: state["starts"])


def pack(sizes: Column, budget: int) -> Column:
    """Chunk number, from 0 on, of each of a short list of sizes."""
    starts = chunk_starts(sizes, budget)
    return F.transform(sizes, lambda _, i: F.size(F.filter(starts, lambda at: at <= i + 1)) - 1)


def page_chunks(pages: DataFrame, budget: int) -> DataFrame:
    """doc_id, page_no, chunk of ``pages(doc_id, page_no, text)``."""
    lists = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.length("text").cast("long").alias("size")))).alias("p"))
    starts = lists.withColumn("starts", chunk_starts(F.transform("p", lambda x: x["size"]), budget))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("p") + 1))
    runs = F.zip_with("starts", ends, lambda a, b: F.slice("p", a, b - a))
    chunked = starts.select("doc_id", F.posexplode(runs).alias("chunk", "run"))
    return chunked.select("doc_id", "chunk", F.explode("run").alias("x")).select("doc_id", "x.page_no", "chunk")
