"""Transcript files: one JSON object per line, one file per session, one folder per project."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators import messages as M
from skeinlog.operators import sessions as S

MIN_BYTES = 100
LOOKAHEAD = 5
MAX_RESULT = 500
_BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


def _from_path(path: Column, suffix: str = ".jsonl") -> dict[str, Column]:
    name = F.url_decode(F.regexp_extract(path, rf"([^/]+){re.escape(suffix)}$", 1))
    folder = F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return {"session_id": name, "project_path_encoded": folder, "project_path": X.decode_project(folder)}


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each line's place in its split, from 1. A split's lines stand together and in order; holds one batch."""
    last, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start = batch.column("file_path"), batch.column("start").to_numpy()
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            other = pc.not_equal(path.slice(1), path.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[1:] = other | (start[1:] != start[:-1])
        new[0] = last != (path[0].as_py(), int(start[0]))
        at = np.arange(batch.num_rows)
        head = np.maximum.accumulate(np.where(new, at, 0))
        place = at - head + 1 + np.where(new[head], 0, before)
        last, before = (path[-1].as_py(), int(start[-1])), int(place[-1])
        yield batch.append_column("place", pa.array(place, pa.int64()))


def lines(spark: SparkSession, root: str, min_bytes: int = MIN_BYTES, suffix: str = ".jsonl") -> DataFrame:
    """One row per physical line: session_id, project columns, file columns, line_no from 1, line.

    A file of any size is read in splits by as many tasks. A line's number is its place in its split plus the lines of the
    file's splits before it; these are counted for files of several splits only, of which a row each is joined (about one for
    each ``spark.sql.files.maxPartitionBytes``). Small files are left out by their metadata.
    """
    folders = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*")
    found = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folders)
    if found is None or not any(f.isDirectory() for f in found):  # no folder, or an empty one: no rows
        return spark.createDataFrame([], "session_id string, project_path_encoded string, project_path string, file_path string, file_size long, modified_at timestamp, line string, line_no int")
    raw = spark.read.option("pathGlobFilter", f"*{suffix}").text(f"{root.rstrip('/')}/*/")
    of = lambda name: F.col(f"_metadata.{name}")
    large = raw.where((of("file_size") >= min_bytes) & (of("file_block_length") < of("file_size")))
    counts = large.groupBy(of("file_path").alias("__path"), of("file_block_start").alias("__start")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__path", "__start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
    rows = raw.where(of("file_size") >= min_bytes).select(
        F.col("value").alias("line"), of("file_path").alias("file_path"), of("file_size").alias("file_size"), of("file_modification_time").alias("modified_at"), of("file_block_start").alias("start")
    )
    placed = rows.mapInArrow(_numbered, "line string, file_path string, file_size long, modified_at timestamp, start long, place long")
    placed = placed.join(offsets, (F.col("file_path") == F.col("__path")) & (F.col("start") == F.col("__start")), "left")
    number = (F.col("place") + F.coalesce("__offset", F.lit(0))).cast("int")
    return placed.select(*[c.alias(n) for n, c in _from_path(F.col("file_path"), suffix).items()], "file_path", "file_size", "modified_at", "line", number.alias("line_no"))


def parsed(all_lines: DataFrame) -> DataFrame:
    """Adds ``v``, the line as a variant: null unless it is an object whose type is a string."""
    v = F.try_parse_json(X.trim(F.col("line")))
    typed = all_lines.withColumn("v0", v)
    ok = F.expr("schema_of_variant(variant_get(v0, '$.type')) = 'STRING'") & F.expr("schema_of_variant(v0) like 'OBJECT%'")
    return typed.withColumn("v", F.when(F.coalesce(ok, F.lit(False)), F.col("v0"))).drop("v0")


def warnings(all_parsed: DataFrame) -> DataFrame:
    """Lines that are neither blank nor valid."""
    bad = all_parsed.where(F.col("v").isNull() & (X.trim(F.col("line")) != ""))
    return bad.select("session_id", "line_no", F.lit("invalid line").alias("error"))


def messages(all_parsed: DataFrame) -> DataFrame:
    """One row per valid line that isn't a summary."""
    get = lambda path: F.try_variant_get("v", path, "string")
    rows = all_parsed.where(F.col("v").isNotNull() & (get("$.type") != "summary"))
    is_text = F.expr("schema_of_variant(variant_get(v, '$.message.content')) = 'STRING'")
    content = F.get_json_object("line", "$.message.content")
    rows = rows.withColumns(
        {
            "is_text": F.coalesce(is_text, F.lit(False)),
            "blocks": F.coalesce(F.from_json(F.when(~F.coalesce(is_text, F.lit(False)), content), _BLOCKS), F.array().cast(_BLOCKS)),
            "content": content,
        }
    )
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    text = F.when(F.col("is_text"), F.col("content")).otherwise(F.array_join(F.transform(F.filter(of("text"), lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n"))
    uses = F.transform(F.filter(of("tool_use"), lambda b: b["name"].isNotNull()), lambda b: F.struct(F.coalesce(b["id"], F.lit("")).alias("id"), b["name"].alias("name"), b["input"].alias("input")))
    results = F.transform(of("tool_result"), lambda b: F.struct(F.coalesce(b["tool_use_id"], F.lit("")).alias("tool_use_id"), X.truncate(F.coalesce(b["content"], F.lit("")), MAX_RESULT).alias("content")))
    return rows.select(
        "session_id", F.col("line_no").alias("msg_idx"), M.role_of(get("$.type"), get("$.message.role")).alias("role"), get("$.timestamp").alias("timestamp"),
        F.coalesce(text, F.lit("")).alias("text_content"), uses.alias("tool_uses"), results.alias("tool_results"),
        F.exists("blocks", lambda b: F.coalesce(b["type"] == "thinking", F.lit(False))).alias("has_thinking"), get("$.type").alias("raw_type"),
    ).withColumn("tool_names", F.transform("tool_uses", lambda u: u["name"]))


def first_timestamps(all_parsed: DataFrame, lookahead: int = LOOKAHEAD) -> DataFrame:
    """The first valid timestamp among the first physical lines of each file."""
    at = F.try_variant_get("v", "$.timestamp", "string")
    near = all_parsed.where(F.col("line_no") <= lookahead).withColumn("created_at", F.try_to_timestamp(at))
    return near.groupBy("session_id").agg(F.min_by("created_at", F.when(F.col("created_at").isNotNull(), F.col("line_no"))).alias("created_at"))


def sessions(all_parsed: DataFrame) -> DataFrame:
    """One row per file: its columns, counts, time span, last summary and number of physical lines."""
    get = lambda path: F.try_variant_get("v", path, "string")
    is_summary = get("$.type") == "summary"
    files = all_parsed.groupBy("session_id", "project_path", "project_path_encoded", "file_path", "file_size", "modified_at").agg(
        F.max("line_no").alias("message_count"),
        F.max_by(F.when(is_summary, get("$.summary")), F.when(is_summary & get("$.summary").isNotNull(), F.col("line_no"))).alias("summary"),
    )
    facts = S.session_facts(messages(all_parsed))
    out = files.join(facts, "session_id", "left").join(first_timestamps(all_parsed), "session_id", "left")
    return out.na.fill(0, ["user_message_count", "assistant_message_count", "tool_use_count"])


def projects(all_sessions: DataFrame) -> DataFrame:
    return all_sessions.groupBy("project_path", "project_path_encoded").agg(F.count(F.lit(1)).alias("sessions"), F.max(F.coalesce("created_at", "modified_at")).alias("latest"))
