"""The review of suggestions as one flow: decide, edit, back up and write, and keep what was decided.

Edits are worked out by Spark, a file's in order; rule files are the user's own and few, so their new texts are written by the
driver, one file at a time as they arrive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.operators import edits
from skeinlog.sources.rule_writer import RuleWriter
from skeinlog.sources.scratch import written
from skeinlog.sources.store import Store


@dataclass
class Review:
    #: One row for each suggestion that was pending: its file, action, error, and what it looked like (``preview``).
    outcomes: DataFrame
    paths: list[str]
    counts: dict[str, int]


def preview(diff, lines: int = 6):
    """What goes and what comes, marked with - and +, at most so many lines of each, and how many more there are."""

    def side(rows, mark: str):
        shown = F.transform(F.slice(rows, 1, lines), lambda x: F.concat(F.lit(mark), x["content"]))
        more = F.when(F.size(rows) > lines, F.array(F.concat(F.lit(f"{mark}... "), (F.size(rows) - lines).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
        return F.coalesce(F.concat(shown, more), F.array().cast("array<string>"))

    parts = F.coalesce(F.flatten(F.transform(diff["parts"], lambda p: F.concat(side(p["removed_lines"], "- "), side(p["added_lines"], "+ ")))), F.array().cast("array<string>"))
    return F.array_join(F.concat(side(diff["removed_lines"], "- "), side(diff["added_lines"], "+ "), parts), "\n")


def review(
    store: Store,
    writer: RuleWriter,
    suggestions: DataFrame,
    files: DataFrame,
    batch: str,
    dry_run: bool = False,
    yes: bool = False,
    least: float | None = None,
    choices: DataFrame | None = None,
) -> Review:
    """Decide on the pending suggestions, apply what is accepted, and write it. ``choices`` (id, choice) are a reviewer's. Decisions on the same
    batch replace each other; a dry run writes nothing, and says what would become of the files."""
    reviewed = store.read("reviews", "id string, status string, batch_id string")
    open_ = suggestions.where(F.col("status") == "pending").join(reviewed.where(F.col("batch_id") != batch).select("id"), "id", "left_anti")
    if choices is not None:
        open_ = open_.join(choices.select("id", F.col("choice").alias("__choice")), "id", "left")
    decision = edits.decide(F.col("confidence"), False, yes or dry_run, least, F.col("__choice") if choices is not None else None)
    text = files.select(F.col("path").alias("file_path"), F.col("content").alias("file_content"))
    matched = open_.drop("file_path", "file_content").transform(lambda s: edits.match_files(s, files)) if "file_path" not in open_.columns else open_.drop("file_content").join(text, "file_path", "left")
    removed = F.transform("diff.removed_lines", lambda x: x["content"])
    gone = F.transform(F.filter("diff.parts", lambda p: F.size(p["removed_lines"]) > 0), lambda p: F.array_join(F.transform(p["removed_lines"], lambda x: x["content"]), "\n"))
    rows = matched.select(
        F.coalesce("file_path", "target_file").alias("target_file"), F.col("rank").cast("long").alias("ord"), "id", "type", decision.alias("decision"), "target_section",
        edits.added_text(F.col("diff")).alias("added"), F.when(F.size(removed) > 0, F.array_join(removed, "\n")).alias("removed"), gone.alias("part_removes"), "split_target", "file_content",
    )
    shown = open_.select("id", "title", preview(F.col("diff")).alias("preview"))
    outcomes = written(edits.apply_all(rows).join(shown, "id"), "outcomes")
    counts = edits.review_counts(outcomes).first().asDict()
    if dry_run:
        return Review(outcomes, [], counts)
    accepted = outcomes.where("action <> 'skipped' and error is null").select("target_file", "ord", "action", "error", "content", "created_file", "created_content")
    paths = writer.write_outcomes(list(accepted.toLocalIterator()))
    status = F.when(F.col("action") == "skipped", "skipped").when(F.col("error").isNotNull(), "failed").otherwise("applied")
    decided = outcomes.select("id", "target_file", "title", status.alias("status"), "error", F.lit(batch).alias("review"))
    store.append_history(decided)
    # what failed may be tried again, and what was skipped be looked at again
    store.append_batch("reviews", decided.where("status = 'applied'").select("id", "status"), batch)
    return Review(outcomes, paths, counts)
