"""Operators over messages: (session_id, msg_idx, role, raw_type, text_content, tool_names, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions import text as X

#: Fixed: line types that are not conversation.
METADATA_TYPES = ("progress", "file-history-snapshot", "queue-operation", "pr-link")
MAX_TEXT = 500
MAX_MESSAGES = 150
HEAD, MIDDLE, TAIL = 10, 10, 10
PROMPT_OVERHEAD, MESSAGE_OVERHEAD, CHARS_PER_TOKEN = 3000, 20, 4


def role_of(line_type: Column, message_role: Column) -> Column:
    is_role = lambda r: F.coalesce(line_type == r, F.lit(False)) | F.coalesce(message_role == r, F.lit(False))
    return F.when(is_role("user"), "user").when(is_role("assistant"), "assistant").when(is_role("system"), "system").otherwise("unknown")


def conversation_only(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin("user", "assistant") & ~F.coalesce(F.col("raw_type").isin(*METADATA_TYPES), F.lit(False)))


def prepare(messages: DataFrame, max_text: int = MAX_TEXT) -> DataFrame:
    """Conversation messages with text cut, numbered before empty ones are dropped."""
    order = Window.partitionBy("session_id").orderBy("msg_idx")
    numbered = conversation_only(messages).select(
        "session_id", "role", X.truncate(F.coalesce("text_content", F.lit("")), max_text).alias("text"), "tool_names",
        (F.row_number().over(order) - 1).alias("original_index"),
    )
    return numbered.where((F.length("text") > 0) | (F.size("tool_names") > 0))


def exchanges(prepared: DataFrame, session: str = "session_id", order: str = "original_index") -> DataFrame:
    """Adds ``exchange``: a new one starts with a user message after an assistant one."""
    w = Window.partitionBy(session).orderBy(order)
    starts = F.coalesce((F.col("role") == "user") & (F.lag("role").over(w) == "assistant"), F.lit(False)).cast("int")
    # the window function must be a column of its own before it is summed
    return prepared.withColumn("__starts", starts).withColumn(
        "exchange", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("__starts")


def choose_exchanges(grouped: DataFrame, key: Column, head: int = HEAD, middle: int = MIDDLE, tail: int = TAIL, session: str = "session_id") -> DataFrame:
    """One row per (session, exchange) that sampling keeps: the first, the last, and of the middle those with
    the smallest ``key``; all, if there are no more than head + middle + tail. ``part`` says why."""
    per = Window.partitionBy(session)
    ranked = grouped.select(session, "exchange").distinct().withColumns(
        {"__n": F.count(F.lit(1)).over(per), "__at": F.row_number().over(per.orderBy("exchange")), "__key": key}
    )
    part = (
        F.when(F.col("__n") <= head + middle + tail, "all").when(F.col("__at") <= head, "head").when(F.col("__at") > F.col("__n") - tail, "tail").otherwise("middle")
    )
    ranked = ranked.withColumn("part", part)
    within = Window.partitionBy(session, "part").orderBy("__key", "exchange")
    ranked = ranked.withColumn("__rank", F.row_number().over(within))
    return ranked.where((F.col("part") != "middle") | (F.col("__rank") <= middle)).select(session, "exchange", "part")


def sample(prepared: DataFrame, seed: int = 0, max_messages: int = MAX_MESSAGES, head: int = HEAD, middle: int = MIDDLE, tail: int = TAIL) -> DataFrame:
    """Long sessions keep some exchanges; two equal markers (original_index -1) stand for what was skipped. ``sort``
    orders the result; ``was_sampled`` is true for every session over ``max_messages``."""
    sized = exchanges(prepared).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    short = sized.where(F.col("__m") <= max_messages)
    long = sized.where(F.col("__m") > max_messages)
    kept = choose_exchanges(long, F.xxhash64("session_id", "exchange", F.lit(seed)), head, middle, tail)
    rows = long.join(kept, ["session_id", "exchange"])
    totals = long.groupBy("session_id").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("exchange").alias("x"))
    got = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("km"), F.count_distinct("exchange").alias("kx"), F.min(F.when(F.col("part") == "tail", F.col("original_index"))).alias("tail_at"), F.max(F.when(F.col("part") == "head", F.col("original_index"))).alias("head_at"))
    marks = totals.join(got, "session_id").where("x > kx").select(
        "session_id", F.lit("assistant").alias("role"),
        F.format_string("[...skipped %d messages from %d exchanges...]", F.col("m") - F.col("km"), F.col("x") - F.col("kx")).alias("text"),
        F.array().cast("array<string>").alias("tool_names"), F.lit(-1).alias("original_index"),
        F.explode(F.array(F.col("head_at") + 0.5, F.col("tail_at") - 0.5)).alias("sort"), F.lit(True).alias("was_sampled"),
    )
    own = lambda df, flag: df.select("session_id", "role", "text", "tool_names", "original_index", F.col("original_index").cast("double").alias("sort"), F.lit(flag).alias("was_sampled"))
    return own(short, False).unionByName(own(rows, True)).unionByName(marks)


def render(prepared: DataFrame, session: str = "session_id", order: str = "original_index") -> DataFrame:
    """One text per session: ``[ROLE] [tools: a, b]`` and the text, messages separated by a blank line."""
    tools = F.when(F.size("tool_names") > 0, F.concat(F.lit(" [tools: "), F.array_join("tool_names", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("["), F.upper("role"), F.lit("]"), tools, F.lit("\n"), F.col("text"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return prepared.groupBy(session).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n\n").alias("rendered"))


def token_estimate(prepared: DataFrame, summary_json: Column | None = None, session: str = "session_id") -> DataFrame:
    """Tokens that a prompt of the session will take, from its characters."""
    chars = F.length("text") + F.length(F.array_join("tool_names", ", ")) + MESSAGE_OVERHEAD
    extra = F.lit(0) if summary_json is None else F.length(F.first(summary_json))
    return prepared.groupBy(session).agg(F.ceil((F.lit(PROMPT_OVERHEAD) + extra + F.sum(chars)) / CHARS_PER_TOKEN).cast("long").alias("token_estimate"))
