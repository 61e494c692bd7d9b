"""Session facts from messages, listing filters, and the time estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_USER_MESSAGES = 2


def duration_minutes(first: Column, last: Column) -> Column:
    """Whole minutes between two timestamps, halves rounded up; null if either is missing."""
    seconds = F.timestamp_diff("MILLISECOND", first, last)
    return F.floor(seconds / 60000 + 0.5).cast("int")


def session_facts(messages: DataFrame) -> DataFrame:
    """Counts and time span of each session; timestamps compare as text."""
    first, last = F.min("timestamp"), F.max("timestamp")
    return messages.groupBy("session_id").agg(
        F.count_if(F.col("role") == "user").cast("int").alias("user_message_count"),
        F.count_if(F.col("role") == "assistant").cast("int").alias("assistant_message_count"),
        F.sum(F.size("tool_uses")).cast("int").alias("tool_use_count"),
        first.alias("first_timestamp"),
        last.alias("last_timestamp"),
        duration_minutes(F.try_to_timestamp(first), F.try_to_timestamp(last)).alias("duration_minutes"),
    )


def analyzable(sessions: DataFrame, least: int = MIN_USER_MESSAGES) -> DataFrame:
    return sessions.where(F.col("user_message_count") >= least)


def for_project(sessions: DataFrame, project: str, path_col: str = "project_path", encoded_col: str = "project_path_encoded") -> DataFrame:
    plain = project.rstrip("/")
    stripped = F.regexp_replace(path_col, "/+$", "")
    return sessions.where((stripped == plain) | (F.col(encoded_col) == plain) | (F.col(encoded_col) == plain.replace("/", "-")))


def find_session(sessions: DataFrame, wanted: str) -> DataFrame:
    """The session of that id, or the first whose id starts with it, in listing order (newest first)."""
    hit = sessions.where(F.col("session_id").startswith(wanted))
    return hit.orderBy(F.coalesce("created_at", "modified_at").desc(), "session_id").limit(1)


def modified_since(sessions: DataFrame, cutoff: Column, at: str = "modified_at") -> DataFrame:
    return sessions.where(F.col(at) >= cutoff)


def newest_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; the rank is limited before the shuffle by the planner."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def latest_batch(rows: DataFrame, batch: str) -> DataFrame:
    latest = rows.agg(F.max(batch).alias("__latest"))
    return rows.join(F.broadcast(latest), F.col(batch) == F.col("__latest")).drop("__latest")


def listing_totals(sessions: DataFrame) -> DataFrame:
    minutes = F.sum(F.coalesce("duration_minutes", F.lit(0)))
    return sessions.agg(
        F.count_distinct("project_path").alias("projects"), F.count(F.lit(1)).alias("sessions"), minutes.alias("minutes"), F.round(minutes / 60, 1).alias("hours")
    )


def eta_seconds(user_messages: Column) -> Column:
    """Seconds that a session's analysis is expected to take."""
    return 10 + F.least(user_messages, F.lit(300)) * 0.12


def eta_minutes(sessions: DataFrame) -> DataFrame:
    total = F.sum(eta_seconds(F.col("user_message_count"))) + F.greatest(F.lit(0), F.count(F.lit(1)) - 1)
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.ceil(total / 60).cast("long").alias("eta_minutes"))


def change_status(sessions: DataFrame, audit: DataFrame, prompt_version: str) -> DataFrame:
    """Adds ``needs_analysis``: no record, never analysed, another prompt, or another modification time."""
    joined = sessions.join(audit.select("session_id", "analyzed_at", "analysis_prompt_version", "session_mtime"), "session_id", "left")
    same = F.col("analysis_prompt_version").eqNullSafe(F.lit(prompt_version)) & F.col("session_mtime").eqNullSafe(F.col("mtime"))
    return joined.withColumn("needs_analysis", F.col("analyzed_at").isNull() | ~same).drop("analyzed_at", "analysis_prompt_version", "session_mtime")


def skipped_short(sessions: DataFrame, least: int = MIN_USER_MESSAGES) -> DataFrame:
    """One row: how many sessions are too short to be analysed, and how many are not."""
    short = F.col("user_message_count") < least
    return sessions.agg(F.count_if(short).alias("skipped_short"), F.count_if(~short).alias("analyzable"))


def with_results(sessions: DataFrame, audit: DataFrame, results: DataFrame) -> DataFrame:
    """Sessions that the audit knows as analysed and that have stored results."""
    done = audit.where("analyzed_at is not null").select("session_id")
    return sessions.join(done, "session_id", "left_semi").join(results.select("session_id"), "session_id", "left_semi")


def listed(sessions: DataFrame) -> DataFrame:
    """What a listing shows: sessions with a first timestamp."""
    return sessions.where(F.col("first_timestamp").isNotNull())


def date_range(first: Column, last: Column) -> Column:
    """``2024-01-31 09:05 - 10:20`` of two timestamps, in the session's time zone."""
    time = lambda c: F.date_format(c, "HH:mm")
    start = F.concat(F.date_format(first, "yyyy-MM-dd "), time(first))
    return F.when(first.isNull(), "Unknown date").when(last.isNull(), start).otherwise(F.concat(start, F.lit(" - "), time(last)))


def short_path(path: Column, home: str) -> Column:
    """A path with the home folder as ``~``."""
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path) if home else path
