"""Insights and patterns: normalisation of model answers, filters, lineage, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators.ranking import numbered

#: The enumerations of an insight.
CATEGORIES = [
    "missing_project_knowledge", "repeated_correction", "rejected_approach", "intent_clarification", "convention_establishment", "tool_command_correction",
    "tool_usage_pattern",
]
ACTION_HINTS = ["add_to_rules", "update_rules", "add_to_global_rules", "prompt_improvement", "unclear"]
CORRECTIONS = ("repeated_correction", "rejected_approach")
SINGLE_CONFIDENCE, CROSS_CONFIDENCE = 0.5, 0.6
LEAST_CONFIDENCE = 0.5
MAX_EVIDENCE, EVIDENCE_CHARS = 3, 300
BATCH = 15


def _text(v: Column, path: str) -> Column:
    """The string at a path of a variant; null if it is anything else."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, path, "string"))


def confidence(v: Column, default: float) -> Column:
    value = F.try_variant_get(v, "$.confidence", "variant")
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)"), F.try_variant_get(v, "$.confidence", "double"))
    return F.when(number.between(0, 1), number).otherwise(F.lit(default))


def evidence(v: Column) -> Column:
    """The first three objects of the evidence list, normalised."""
    items = F.coalesce(F.try_variant_get(v, "$.evidence", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)))

    def one(e: Column) -> Column:
        return F.struct(
            F.when(_text(e, "$.role") == "user", "user").otherwise("assistant").alias("role"),
            F.substring(F.coalesce(_text(e, "$.text"), F.lit("")), 1, EVIDENCE_CHARS).alias("text"),
            F.lit(None).cast("string").alias("timestamp"),
            F.coalesce(F.try_variant_get(e, "$.messageIndex", "int"), F.lit(0)).alias("message_index"),
        )

    return F.slice(F.transform(objects, one), 1, MAX_EVIDENCE)


def from_answers(answers: DataFrame, keys: list[str], cross: bool = False, keep_raw: bool = False) -> DataFrame:
    """Insights (or, with ``cross``, patterns) of answers(keys..., value variant): one row per valid item; ``keep_raw`` adds the
    item itself (``v``), of which :func:`occurrences` are read.

    Ids are digests of key, place and title, so that a repeated run gives the same ones.
    """
    items = F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = answers.select(*keys, F.posexplode(items).alias("pos", "v"))
    v = F.col("v")
    rows = rows.where(_text(v, "$.title").isNotNull() & ((_text(v, "$.category").isNotNull()) | F.lit(cross)))
    return rows.select(
        *keys, "pos", X.digest(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("pos").cast("string"), _text(v, "$.title")), 32).alias("id"),
        X.normalize_enum(F.coalesce(_text(v, "$.category"), F.lit("")), CATEGORIES, CATEGORIES[0]).alias("category"),
        confidence(v, CROSS_CONFIDENCE if cross else SINGLE_CONFIDENCE).alias("confidence"),
        _text(v, "$.title").alias("title"), F.coalesce(_text(v, "$.description"), F.lit("")).alias("description"), evidence(v).alias("evidence"),
        _text(v, "$.suggestedRule").alias("suggested_rule"),
        X.normalize_enum(F.coalesce(_text(v, "$.actionHint"), F.lit("")), ACTION_HINTS, "unclear").alias("action_hint"), *(["v"] if keep_raw else []),
    )


def occurrences(patterns_raw: DataFrame) -> DataFrame:
    """Bridge rows pattern -> (session, insight) of patterns(id, v)."""
    items = F.coalesce(F.try_variant_get("v", "$.occurrences", "array<variant>"), F.array().cast("array<variant>"))
    o = patterns_raw.select("id", F.explode(items).alias("o"))
    return o.select("id", F.coalesce(_text(F.col("o"), "$.sessionId"), F.lit("")).alias("session_id"), F.coalesce(_text(F.col("o"), "$.insightId"), F.lit("")).alias("insight_id"), _text(F.col("o"), "$.timestamp").alias("timestamp"))


def confident(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return rows.where(F.col("confidence") >= least)


def filtered_out(rows: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return rows.agg(F.count_if(F.col("confidence") < least).alias("filtered_out"))


def actionable(rows: DataFrame) -> DataFrame:
    return rows.where(~((F.coalesce("suggested_rule", F.lit("")) == "") & (F.col("action_hint") == "prompt_improvement")))


def corrections(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").agg(F.count_if(F.col("category").isin(*CORRECTIONS)).alias("corrections_detected"))


def payload(insights: DataFrame, patterns: DataFrame, pattern_sessions: DataFrame) -> DataFrame:
    """Insights and patterns as one set for a prompt, tagged with their source and number of sessions."""
    counts = pattern_sessions.groupBy("id").agg(F.count_distinct("session_id").alias("session_count"))
    columns = ["id", "category", "confidence", "title", "description", "suggested_rule", "action_hint"]
    single = insights.select(*columns, F.lit("single").alias("source"), F.lit(1).cast("long").alias("session_count"))
    cross = patterns.join(counts, "id", "left").select(*columns, F.lit("cross").alias("source"), F.coalesce("session_count", F.lit(0)).cast("long").alias("session_count"))
    return actionable(single.unionByName(cross))


def batches(rows: DataFrame, group: Sequence[str] = (), order: str = "id", size: int = BATCH) -> DataFrame:
    """Adds ``batch``, from 1: the most confident first, ``size`` at a time, within each group or the whole table."""
    by = [F.col("confidence").desc(), F.col(order).asc()]
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))) if group else numbered(rows, by, "__rank")
    return ranked.withColumn("batch", F.ceil(F.col("__rank") / size).cast("int")).drop("__rank")


def by_category(rows: DataFrame) -> DataFrame:
    """Insights and sessions of each category."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("insights"), F.count_distinct("session_id").alias("sessions"))


def in_scope(rows: DataFrame, scope: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows whose key is one of the scope's."""
    return rows.join(scope.select(key), key, "left_semi")
