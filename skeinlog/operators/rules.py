"""Rules in Markdown files: parsing, classification, statistics.

A file is scanned once, line by line, by a table function; everything about a rule that only depends on its text
is a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import text as X

#: What makes a rule emphatic, important or negative.
EMPHATIC = r"(?i)^(IMPORTANT|CRITICAL|YOU MUST|NEVER)\b"
IMPORTANT_ANY_CASE = r"(?i)\b(IMPORTANT|NEVER|DO NOT|DON'T|YOU MUST|REQUIRED|CRITICAL)\b"
IMPORTANT_UPPER = r"\bMUST\b"
NEGATIVE = r"(?i)\bavoid\b"
MARKER = r"^[*-]\s+"
SCOPES = ["global", "project", "project_local", "subdirectory"]
FORMATS = ["heading_section", "bullet_point", "command", "paragraph", "emphatic"]

_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
_BULLET = re.compile(r"(\s*)[*-]\s+.+$")
_FENCE = re.compile(r"(`{3,}|~{3,})")
_RULE_OFF = re.compile(r"[-*_]{3,}\s*$")
_WIDE = "\t\n\x0b\x0c\r                  　﻿"


@dataclass
class _Block:
    first: int
    last: int
    lines: list[str]
    indent: int | None  # of the opening bullet; None for a paragraph
    headings: list[str] = field(default_factory=list)


def _kind(line: str) -> tuple[str, re.Match | None]:
    """blank, fence, off (a horizontal line), heading, bullet or text."""
    bare = line.strip(_WIDE)
    if not bare:
        return "blank", None
    for name, pattern in (("fence", _FENCE), ("heading", _HEADING), ("bullet", _BULLET)):
        if m := pattern.match(line):
            return ("off", None) if name == "bullet" and _RULE_OFF.match(bare) else (name, m)
    return ("off", None) if _RULE_OFF.match(bare) else ("text", None)


def _closes(fence: str, line: str) -> bool:
    bare = line.strip(_WIDE)
    return len(bare) >= len(fence) and set(bare) == {fence[0]}


def blocks(content: str) -> Iterator[_Block]:
    """Rule blocks of a Markdown text: one pass with an open block that each line either joins or ends.

    A bullet is joined by deeper bullets and indented lines, a paragraph by text lines; comments open nothing.
    """
    open_block: _Block | None = None
    fence: str | None = None
    path: list[tuple[int, str]] = []
    for at, line in enumerate(content.split("\n"), 1):
        if fence is not None:
            fence = None if _closes(fence, line) else fence
            continue
        kind, m = _kind(line)
        if open_block is not None:
            if open_block.indent is None:
                joins = kind == "text"
            else:
                joins = (kind == "bullet" and len(m[1]) > open_block.indent) or (kind in ("text", "off") and line[:1] in (" ", "\t"))
                # a horizontal line made of list marks is a sibling bullet's line to an open bullet
            if joins:
                open_block.lines.append(line.strip(_WIDE))
                open_block.last = at
                continue
            yield open_block
            open_block = None
        if kind == "fence":
            fence = m[1]
        elif kind == "heading":
            level = len(m[1])
            path = [(n, t) for n, t in path if n < level] + [(level, m[2].strip(_WIDE))]
        elif kind in ("bullet", "text") and not line.strip(_WIDE).startswith("<!--"):
            open_block = _Block(at, at, [line.strip(_WIDE)], len(m[1]) if m else None, [t for _, t in path])
    if open_block is not None:
        yield open_block


def fenced(content: str) -> set[int]:
    """Numbers of the lines inside fences, marks included."""
    out, fence = set(), None
    for at, line in enumerate(content.split("\n"), 1):
        if fence is not None:
            out.add(at)
            fence = None if _closes(fence, line) else fence
        elif m := _FENCE.match(line):
            out.add(at)
            fence = m[1]
    return out


def _parse(frames):
    import pandas as pd

    for pdf in frames:
        rows = []
        for path, scope, content in zip(pdf["path"], pdf["scope"], pdf["content"], strict=True):
            for b in blocks(content or ""):
                rows.append((path, scope, "\n".join(b.lines), b.headings[-1] if b.headings else None, b.headings, b.first, b.last))
        yield pd.DataFrame(rows, columns=["source_file", "source_scope", "raw", "section", "section_hierarchy", "line_start", "line_end"])


def format_of(raw: Column) -> Column:
    body = F.regexp_replace(raw, MARKER, "")
    return F.when(body.rlike(EMPHATIC), "emphatic").when(body.rlike("^`[^`]+`"), "command").when(raw.rlike(MARKER), "bullet_point").otherwise("paragraph")


def emphasis_of(raw: Column) -> Column:
    return F.when(raw.rlike(IMPORTANT_ANY_CASE) | raw.rlike(IMPORTANT_UPPER), "important").when(raw.rlike(NEGATIVE), "negative").otherwise("normal")


def parse(files: DataFrame) -> DataFrame:
    """One row per rule of ``files(path, scope, content)``."""
    kind = "source_file string, source_scope string, raw string, section string, section_hierarchy array<string>, line_start int, line_end int"
    rows = files.select("path", "scope", "content").mapInPandas(_parse, kind)
    raw = F.col("raw")
    return rows.select(
        X.digest(F.concat_ws(":", "source_file", F.col("line_start").cast("string"), raw), 16).alias("id"),
        F.regexp_replace(raw, MARKER, "").alias("text"), "section", "section_hierarchy", "source_file", "source_scope", "line_start", "line_end",
        format_of(raw).alias("format"), emphasis_of(raw).alias("emphasis"), X.import_references(raw).alias("imports"),
    )


def _outside(frames):
    import pandas as pd

    for pdf in frames:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            skip = fenced(content or "")
            rows += [(path, at, line) for at, line in enumerate((content or "").split("\n"), 1) if at not in skip and "@" in line]
        yield pd.DataFrame(rows, columns=["source_file", "line_number", "line"])


def file_imports(files: DataFrame) -> DataFrame:
    """(source_file, path, resolved_path, line_number) of the references outside of code."""
    lines = files.select("path", "content").mapInPandas(_outside, "source_file string, line_number int, line string")
    found = lines.select("source_file", "line_number", F.explode(X.import_references(F.col("line"))).alias("path"))
    folder = F.regexp_replace("source_file", r"/[^/]*$", "")
    # a/./b and a/b/../c, as often as they occur
    joined = F.regexp_replace(F.concat_ws("/", folder, "path"), r"/(\./)+", "/")
    for _ in range(8):
        joined = F.regexp_replace(joined, r"/[^/.][^/]*/\.\./", "/")
    return found.select("source_file", "path", joined.alias("resolved_path"), "line_number")


def stats(files: DataFrame, rules: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: counts of files, rules, lines, bytes, imports; a map by scope and one by format, zeros included."""
    f = files.agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum(F.size(F.split("content", "\n", -1))), F.lit(0)).alias("total_lines"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("total_bytes"),
        *[F.coalesce(F.bool_or(F.col("scope") == s), F.lit(False)).alias(f"has_{s}") for s in SCOPES],
    )
    def counts(column, values):
        return F.create_map(*[x for v in values for x in (F.lit(v), F.count_if(F.col(column) == v))])

    r = rules.agg(F.count(F.lit(1)).alias("total_rules"), counts("source_scope", SCOPES).alias("by_scope"), counts("format", FORMATS).alias("by_format"), F.count_if(F.col("emphasis") == "important").alias("emphasized"))
    i = imports.agg(F.count(F.lit(1)).alias("total_imports"))
    return f.join(r).join(i)  # three rows of one


def section_report(rules: DataFrame) -> DataFrame:
    """Rules per file and section with the line range, most rules first and then as they stand in the file."""
    section = F.coalesce("section", F.lit("(no section)"))
    return rules.groupBy("source_file", section.alias("section")).agg(
        F.count(F.lit(1)).alias("rules"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line")
    ).orderBy("source_file", F.col("rules").desc(), "first_line")


LARGE_LINES = 500


def large_files(files: DataFrame, most: int = LARGE_LINES) -> DataFrame:
    """Rule files (path, content) of more than ``most`` lines, with their number of lines. A file may come in several rows, each
    a piece of whole lines; pieces are counted where they are and never put together."""
    lines = F.sum(F.size(F.split("content", "\n", -1))).cast("int")
    return files.groupBy("path").agg(lines.alias("lines")).where(F.col("lines") > most)


def render(rules: DataFrame) -> DataFrame:
    """One text per file for a prompt: its rules in order, with line, section and what marks them."""
    marks = F.concat_ws(", ", F.when(F.col("format") != "paragraph", F.col("format")), F.when(F.col("emphasis") != "normal", F.col("emphasis")))
    line = F.concat(F.lit("  L"), F.col("line_start").cast("string"), F.lit(" ["), F.coalesce("section", F.lit("no section")), F.lit("] "), F.replace("text", F.lit("\n"), F.lit(" / ")), F.when(marks != "", F.concat(F.lit(" ("), marks, F.lit(")"))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_start", line.alias("t")))), lambda x: x["t"])
    return rules.groupBy("source_file").agg(F.concat_ws("\n", F.col("source_file"), F.array_join(lines, "\n")).alias("rendered"))
