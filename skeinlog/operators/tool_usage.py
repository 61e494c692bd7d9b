"""Tool calls and their failures, file access, and the failure rate of shell calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions import text as X

REPEATED = 5
#: Fixed: what marks a failed result, in this case.
FAILURE_MARKS = ("exit code", "Error", "error:")
READS, WRITES, SHELL = ("Read",), ("Write", "Edit"), "Bash"


def is_failure(content: Column) -> Column:
    out = content.contains(FAILURE_MARKS[0])
    for mark in FAILURE_MARKS[1:]:
        out = out | content.contains(mark)
    return F.coalesce(out, F.lit(False))


def calls(messages: DataFrame, scope: str = "message") -> DataFrame:
    """One row per tool call: session_id, msg_idx, pos, name, input, failures.

    A failed result counts for the first call of its id in the same message (``scope='message'``), or in the
    session (``scope='session'``).
    """
    if scope == "message":  # calls and results stand in one row
        failed_ids = F.transform(F.filter("tool_results", lambda r: is_failure(r["content"])), lambda r: r["tool_use_id"])
        rows = messages.select("session_id", "msg_idx", F.posexplode("tool_uses").alias("pos", "u"), F.transform("tool_uses", lambda u: u["id"]).alias("ids"), failed_ids.alias("failed"))
        n = F.size(F.filter("failed", lambda i: i == F.col("u.id")))
        first = F.array_position("ids", F.col("u.id")) == F.col("pos") + 1
        return rows.select("session_id", "msg_idx", "pos", F.col("u.name").alias("name"), F.col("u.input").alias("input"), F.when(first, n).otherwise(0).cast("int").alias("failures"))
    uses = messages.select("session_id", "msg_idx", F.posexplode("tool_uses").alias("pos", "u"))
    uses = uses.select("session_id", "msg_idx", "pos", F.col("u.id").alias("id"), F.col("u.name").alias("name"), F.col("u.input").alias("input"))
    keys = ["session_id", "id"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("msg_idx", "pos")) == 1
    results = messages.select("session_id", F.explode("tool_results").alias("r")).where(is_failure(F.col("r.content")))
    failed = results.select("session_id", F.col("r.tool_use_id").alias("id")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = uses.withColumn("__first", first).join(failed, keys, "left")
    return joined.select("session_id", "msg_idx", "pos", "name", "input", F.when(F.col("__first"), F.coalesce("n", F.lit(0))).otherwise(0).cast("int").alias("failures"))


def by_tool(tool_calls: DataFrame) -> DataFrame:
    return tool_calls.groupBy("session_id", "name").agg(F.count(F.lit(1)).cast("int").alias("count"), F.sum("failures").cast("int").alias("failures"))


def repeated_files(tool_calls: DataFrame, least: int = REPEATED) -> DataFrame:
    path = F.get_json_object("input", "$.file_path")
    seen = tool_calls.where(F.col("name").isin(*READS, *WRITES)).withColumn("file_path", path).where(F.coalesce(F.col("file_path"), F.lit("")) != "")
    counted = seen.groupBy("session_id", "file_path").agg(
        F.count_if(F.col("name").isin(*READS)).cast("int").alias("read_count"), F.count_if(F.col("name").isin(*WRITES)).cast("int").alias("write_count")
    )
    return counted.where(F.col("read_count") + F.col("write_count") >= least)


def shell_failure_rate(tool_calls: DataFrame) -> DataFrame:
    """Failures over calls whose input is an object; 0 without any."""
    shell = F.col("name") == SHELL
    has_input = shell & F.coalesce(F.ltrim(F.col("input")).startswith("{"), F.lit(False))
    rate = F.try_divide(F.sum(F.when(shell, F.col("failures")).otherwise(0)), F.count_if(has_input))
    return tool_calls.groupBy("session_id").agg(F.coalesce(rate, F.lit(0.0)).alias("bash_failure_rate"))


def summary(messages: DataFrame, scope: str = "message") -> DataFrame:
    """One row per session: total_tool_calls, by_tool (a map), repeated_file_access (most used first), bash_failure_rate."""
    one = calls(messages, scope)
    tools = by_tool(one).groupBy("session_id").agg(
        F.sum("count").cast("int").alias("total_tool_calls"),
        F.map_from_entries(F.collect_list(F.struct("name", F.struct("count", "failures").alias("v")))).alias("by_tool"),
    )
    entry = F.struct((-(F.col("read_count") + F.col("write_count"))).alias("o"), "file_path", "read_count", "write_count")
    files = repeated_files(one).groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("f"))
    files = files.select("session_id", F.transform("f", lambda x: F.struct(x["file_path"].alias("file_path"), x["read_count"].alias("read_count"), x["write_count"].alias("write_count"))).alias("repeated_file_access"))
    return tools.join(files, "session_id", "left").join(shell_failure_rate(one), "session_id", "left")


def render(usage: DataFrame) -> DataFrame:
    """The summary as text: total, tools by calls with their failures where there are any, shell failure rate, much used files."""
    entries = F.array_sort(F.transform(F.map_entries("by_tool"), lambda e: F.struct((-e["value"]["count"]).alias("o"), e["key"].alias("k"), e["value"]["failures"].alias("f"))))
    total = F.array(F.concat(F.lit("Total tool calls: "), F.col("total_tool_calls").cast("string")))
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), e["k"], F.lit(": "), (-e["o"]).cast("string"), F.when(e["f"] > 0, F.concat(F.lit(" ("), e["f"].cast("string"), F.lit(" failures)"))).otherwise("")))
    none = F.array().cast("array<string>")
    rate = F.when(F.col("bash_failure_rate") > 0, F.array(F.format_string("Bash failure rate: %.0f%%", F.col("bash_failure_rate") * 100))).otherwise(none)
    used = F.coalesce("repeated_file_access", F.array().cast("array<struct<file_path:string,read_count:int,write_count:int>>"))
    files = F.transform(used, lambda x: F.concat(F.lit("  "), x["file_path"], F.lit(": "), x["read_count"].cast("string"), F.lit(" reads, "), x["write_count"].cast("string"), F.lit(" writes")))
    heading = F.when(F.size(used) > 0, F.array(F.lit(""), F.lit("Frequently accessed files:"))).otherwise(none)
    return usage.select("session_id", F.array_join(F.concat(total, lines, rate, heading, files), "\n").alias("rendered"))


PREVIEW_CHARS = 80


def preview(name: Column, given: Column) -> Column:
    """What a call's input comes down to, by the tool's name; empty for others."""
    at = lambda key: F.get_json_object(given, f"$.{key}")
    shown = (
        F.when(name == SHELL, X.truncate(at("command"), PREVIEW_CHARS)).when(name.isin(*READS, *WRITES), at("file_path"))
        .when(name == "Grep", F.concat(F.lit("/"), at("pattern"), F.lit("/"))).when(name == "Glob", at("pattern")).when(name == "Task", at("description"))
    )
    return F.coalesce(shown, F.lit(""))
