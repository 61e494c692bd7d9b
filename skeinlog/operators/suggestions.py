"""Suggestions: normalisation, provenance, confidence, statistics, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators.insights import _text

#: The enumerations of a suggestion.
TYPES = ["add", "update", "remove", "consolidate", "split"]
PRIORITIES = ["high", "medium", "low"]
DEFAULT_TARGET, SKIP_REASON = "CLAUDE.md", "already covered"


def _texts(v: Column, path: str) -> Column:
    """A string or a list of strings at a path, as a list; empty if there is neither."""
    many = F.try_variant_get(v, path, "array<string>")
    one = _text(v, path)
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.coalesce(many, F.array().cast("array<string>")))


def from_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item with a title of answers(keys..., value); items the model skipped are flagged with its reason."""
    items = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.try_variant_get("value", "$.suggestions", "array<variant>"), F.array().cast("array<variant>"))
    rows = answers.select(*keys, F.posexplode(items).alias("ord", "v"))
    v = F.col("v")
    rows = rows.where(_text(v, "$.title").isNotNull())
    kind = X.normalize_enum(F.coalesce(_text(v, "$.type"), F.lit("")), TYPES, TYPES[0])
    adds = _texts(v, "$.content.add")
    skipped = F.coalesce(F.try_variant_get(v, "$.skipped", "boolean"), F.lit(False))
    return rows.select(
        *keys, F.col("ord").cast("long").alias("ord"), X.digest(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("ord").cast("string"), _text(v, "$.title")), 32).alias("id"),
        kind.alias("type"), X.normalize_enum(F.coalesce(_text(v, "$.priority"), F.lit("")), PRIORITIES, "medium").alias("priority"),
        _text(v, "$.title").alias("title"), F.coalesce(_text(v, "$.rationale"), F.lit("")).alias("rationale"),
        F.coalesce(_text(v, "$.targetFile"), F.lit(DEFAULT_TARGET)).alias("target_file"), _text(v, "$.targetSection").alias("target_section"),
        F.when(F.size(adds) > 0, F.array_join(adds, "\n")).alias("add_text"), _texts(v, "$.content.remove").alias("remove_texts"),
        F.coalesce(F.try_variant_get(v, "$.sourceInsightIds", "array<string>"), F.array().cast("array<string>")).alias("source_insight_ids"),
        F.when(kind == "split", F.get(adds, 0)).alias("split_target"), skipped.alias("skipped"),
        F.when(skipped, F.coalesce(_text(v, "$.skipReason"), F.lit(SKIP_REASON))).alias("skip_reason"), F.lit("pending").alias("status"),
    )


def with_provenance(suggestions: DataFrame, insight_sessions: DataFrame) -> DataFrame:
    """Adds the sessions behind each suggestion's insights (unknown ids add none) and the confidence they give.

    ``insight_sessions(insight_id, session_id)`` holds insights and the occurrences of patterns.
    """
    links = suggestions.select("id", F.explode("source_insight_ids").alias("insight_id")).join(insight_sessions, "insight_id")
    per = links.groupBy("id").agg(F.array_sort(F.collect_set("session_id")).alias("source_session_ids"))
    joined = suggestions.join(per, "id", "left").withColumn("source_session_ids", F.coalesce("source_session_ids", F.array().cast("array<string>")))
    n = F.size("source_session_ids")
    score = F.when(F.col("type") == "split", 0.85).when(F.size("source_insight_ids") == 0, 0.6).when(n >= 3, 0.95).when(n >= 2, 0.85).otherwise(0.7)
    return joined.withColumn("confidence", score)


def stats(suggestions: DataFrame, total_rules: int = 0) -> DataFrame:
    """One row: counts by type and priority, zeros included, and the number of rules after applying all."""
    by = lambda c, values: F.create_map(*[x for v in values for x in (F.lit(v), F.count_if(F.col(c) == v))])
    return suggestions.agg(
        F.count(F.lit(1)).alias("total"), by("type", TYPES).alias("by_type"), by("priority", PRIORITIES).alias("by_priority"),
        (F.lit(total_rules) + F.count_if(F.col("type") == "add")).alias("estimated_rules_after"),
    )


LEAF = 64


def set_digest(items: DataFrame, column: str = "item", leaf: int = LEAF) -> DataFrame:
    """One row, ``digest``: of a set of texts, as the root of a tree of hashes.

    Items are hashed, and gathered by the first digits of their hashes, as many as leave about ``leaf`` to a group; a group's digest is that of its
    sorted hashes. Groups are then joined digit by digit, sixteen at most to one. So no group holds more than a few dozen
    hashes, and the digest depends on the items alone, not on partitions. Repeated items count once; without any it is that of an empty text.
    """
    hashed = items.select(F.sha2(F.col(column).cast("binary"), 256).alias("h")).distinct()
    n, digits = hashed.count(), 0
    while n > leaf * 16**digits:
        digits += 1
    level = hashed.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("t"))
    level = level.select("p", F.sha2(F.col("t").cast("binary"), 256).alias("d"))
    for k in range(digits - 1, -1, -1):
        told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat(x["p"], F.lit(":"), x["d"])), ",")
        level = level.groupBy(F.substring("p", 1, k).alias("q")).agg(told.alias("t")).select(F.col("q").alias("p"), F.sha2(F.col("t").cast("binary"), 256).alias("d"))
    return level.agg(F.coalesce(F.max("d"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


def cache_key(ids: DataFrame, files: DataFrame, prompt_version: str) -> DataFrame:
    """One row, ``key``: a digest of the ids, of each file's place, path and text, and of the prompt version."""
    nul = F.chr(F.lit(0))
    one = F.concat(F.col("ord").cast("string"), nul, "relative_path", nul, F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    left, right = set_digest(ids.select(F.col("id").alias("item"))), set_digest(files.select(one.alias("item")))
    whole = F.concat("ids", nul, "files", nul, F.lit(f"prompt:{prompt_version}"))
    return left.toDF("ids").join(F.broadcast(right.toDF("files"))).select(X.digest(whole, 16).alias("key"))


def pending(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "pending")
