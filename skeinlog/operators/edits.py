"""Diffs of suggestions against rule files, and their application.

Suggestions of one file are worked off in order, as a stream sorted by file and order (later ones see earlier edits); files
are spread over tasks, which hold one file's text.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinlog.functions import markdown as M
from skeinlog.functions import text as X

_LINE = "struct<line_number:int,content:string>"
_FLAT = f"type:string,after_line:int,in_section:string,removed_lines:array<{_LINE}>,added_lines:array<{_LINE}>"
#: A diff with parts is one level deep.
DIFF = f"struct<{_FLAT},parts:array<struct<{_FLAT}>>>"


def _numbered(text: str | None) -> list[dict] | None:
    return [{"line_number": None, "content": x} for x in text.split("\n")] if text else None


def _rows(found: list[tuple[int, str]] | None, text: str) -> list[dict] | None:
    return [{"line_number": n, "content": x} for n, x in found] if found else _numbered(text)


def _part(kind: str, after=None, section=None, removed=None, added=None) -> dict:
    return {"type": kind, "after_line": after, "in_section": section, "removed_lines": removed, "added_lines": added}


def build_diff(kind: str, add: str | None, removes: list[str], section: str | None, content: str | None, section_rules: int = 0) -> dict | None:
    """The line-level diff of a suggestion; ``content`` is None for a file that doesn't exist yet."""
    whole = lambda part, parts=None: part | {"parts": parts}
    remove = "\n".join(removes) if removes else None
    lines = content.split("\n") if content is not None else []
    found = M.find_section(lines, section) if section and content is not None else None
    own = [(i + 1, lines[i]) for i in range(found.start, M.trimmed_end(lines, found))] if found else None
    if kind == "remove":
        return whole(_part("remove", removed=_rows(M.locate(content, remove), remove))) if remove and content is not None else None
    if not add:
        return None
    if kind == "split":
        if not own:
            return None
        summary = [{"line_number": None, "content": x} for x in (f"# {section}", f"({section_rules} rules moved)")]
        return whole(_part("replace", found.start + 1, section), [_part("remove", section=section, removed=_rows(own, "")), _part("add", added=summary)])
    if kind == "consolidate":
        parts = [_part("remove", removed=_rows(M.locate(content, x), x)) for x in removes if x] if content is not None else []
        after = M.insertion_line(content, section) if content is not None else None
        return whole(_part("replace", section=section), [*parts, _part("add", after, section, added=_numbered(add))])
    if content is None:
        return whole(_part("add", section=section, added=_numbered(add)))
    if kind == "update":
        if own:
            return whole(_part("replace", found.start + 1, section, _rows(own, ""), _numbered(add)))
        if remove:
            hit = M.locate(content, remove)
            return whole(_part("replace", hit[0][0] if hit else None, section, _rows(hit, remove), _numbered(add)))
        return whole(_part("add", len(lines), section, added=_numbered(add)))
    return whole(_part("add", M.insertion_line(content, section), section, added=_numbered(add)))


def match_files(suggestions: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the file each suggestion aims at: an equal relative path, else a path that ends so, else a home path;
    the first of the best kind."""
    f = files.select(F.col("path").alias("file_path"), F.col("relative_path").alias("__rel"), F.col("content").alias("file_content"), F.col("ord").alias("__ord"))
    home = F.col("target_file").contains("~") | F.col("target_file").startswith(".claude/")
    bare = F.regexp_replace("target_file", r"~[/\\]", "")
    kind = F.when(F.col("__rel") == F.col("target_file"), 0).when(F.expr("endswith(__rel, target_file)"), 1).when(home & F.col("file_path").endswith(bare), 2)
    # every ending of a path is a key, so that the matches are an equi-join on the distinct targets
    targets = suggestions.select("target_file").distinct()
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i))
    keyed = f.withColumn("__end", F.explode(F.array_distinct(F.concat(ends(F.col("__rel")), ends(F.col("file_path"))))))
    wanted = targets.withColumn("__end", F.explode(F.array_distinct(F.array(F.col("target_file"), bare))))
    hits = wanted.join(keyed, "__end").withColumn("__kind", kind).where("__kind is not null")
    best = hits.groupBy("target_file").agg(F.min_by(F.struct("file_path", "file_content"), F.struct("__kind", "__ord", "file_path")).alias("__best"))
    return suggestions.join(best, "target_file", "left").select(*[F.col(c) for c in suggestions.columns], "__best.file_path", "__best.file_content")


def with_diffs(matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``diff`` to suggestions(type, add_text, remove_texts, target_section, file_path, file_content)."""
    counts = rules.groupBy(F.col("source_file").alias("file_path"), F.col("section").alias("target_section")).agg(F.count(F.lit(1)).alias("__rules"))
    joined = matched.join(counts, ["file_path", "target_section"], "left")

    names = ["type", "add_text", "remove_texts", "target_section", "file_content", "__rules"]
    schema = T.StructType([*(f for f in joined.schema if f.name != "__rules"), T.StructField("diff", T._parse_datatype_string(DIFF))])
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            made = [build_diff(kind, add, removes or [], section, content, n or 0) for kind, add, removes, section, content, n in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(f).cast(out.field(f).type) for f in out.names[:-1]), pa.array(made, out.field("diff").type)], schema=out)

    return joined.mapInArrow(run, schema)


def line_presence(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.8) -> DataFrame:
    """Of each text, its lines that are not blank, how many of them stand in another text, and whether that is nearly all."""
    lines = texts.select(F.col(id_col), F.explode(F.split(text_col, "\n")).alias("line")).select(id_col, X.normalize_line(F.col("line")).alias("line")).where("line <> ''")
    shared = lines.groupBy("line").agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).where("a <> b").select("line", F.lit(1).alias("hit"))
    present = F.count("hit")
    return lines.join(shared, "line", "left").groupBy(id_col).agg(F.count(F.lit(1)).alias("lines"), present.alias("present"), (present / F.count(F.lit(1)) > most).alias("already_present"))


def added_text(diff: Column) -> Column:
    """All added lines, or those of the parts."""
    join = lambda rows: F.array_join(F.transform(rows, lambda x: x["content"]), "\n")
    parts = F.transform(F.filter(diff["parts"], lambda p: F.size(p["added_lines"]) > 0), lambda p: join(p["added_lines"]))
    return F.when(F.size(diff["added_lines"]) > 0, join(diff["added_lines"])).when(F.size(parts) > 0, F.array_join(parts, "\n"))


def is_verbose(text: Column, most: int = 5) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")) > most


@dataclass
class Outcome:
    content: str | None  # the file after the edit, None if it doesn't exist
    action: str = "modified"
    error: str | None = None
    created: tuple[str, str] | None = None  # another file that the edit makes


def apply_one(kind: str, content: str | None, section: str | None, added: str | None, removed: str | None, part_removes: list[str], split_target: str | None) -> Outcome:
    """One suggestion on one file's text."""
    if kind == "add" or (content is None and kind in ("update", "consolidate")):
        if not added:
            return Outcome(content, "created", "no content to add")
        if content is None:
            return Outcome(added + "\n", "created")
        return Outcome(content if M.mostly_present(content, added) else M.insert(content, added, section))
    if content is None:
        return Outcome(None, error="file not found")
    if kind == "update":
        if not added:
            return Outcome(content, error="no replacement text")
        out = M.replace(content, removed, added) if removed else M.insert(content, added, section)
        return Outcome(out) if out is not None else Outcome(content, error="text to replace not found")
    if kind == "remove":
        out = M.replace(content, removed, "") if removed else None
        return Outcome(M.collapse(out)) if out is not None else Outcome(content, error="text to remove not found" if removed else "no text to remove")
    if kind == "consolidate":
        for text in filter(None, part_removes):
            content = next((x for x in [M.replace(content, text, "")] if x is not None), content)
        content = M.collapse(content)
        return Outcome(M.insert(content, added, section) if added else content)
    if kind == "split":
        if not split_target or not section:
            return Outcome(content, error="no split target" if not split_target else "no section")
        cut = M.cut_section(content, section)
        return Outcome(cut[0], created=(split_target, cut[1])) if cut else Outcome(content, error="section not found")
    return Outcome(content, error=f"unknown type {kind}")


RESULT = T.StructType([T.StructField(n, k) for n, k in (("target_file", T.StringType()), ("ord", T.LongType()), ("id", T.StringType()), ("action", T.StringType()), ("error", T.StringType()), ("content", T.StringType()), ("created_file", T.StringType()), ("created_content", T.StringType()))])


def apply_all(suggestions: DataFrame) -> DataFrame:
    """One row per suggestion(target_file, ord, id, type, decision, target_section, added, removed, part_removes,
    split_target, file_content): the outcome, with the file's text after it. Only decisions ``accept`` edit."""

    names = ["target_file", "ord", "id", "type", "decision", "target_section", "added", "removed", "part_removes", "split_target", "file_content"]
    own = suggestions.select(*names[:1], F.col("ord").cast("long").alias("ord"), *names[2:])
    ordered = own.repartition("target_file").sortWithinPartitions("target_file", "ord")
    out = to_arrow_schema(RESULT)

    def run(batches):
        now, content = object(), None
        for batch in batches:
            rows = []
            for target, place, key, kind, decision, section, added, removed, part_removes, split_target, file_content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if target != now:  # a new file begins; later suggestions see what earlier ones made of it
                    now, content = target, file_content
                if decision != "accept":
                    rows.append((target, place, key, "skipped", None, content, None, None))
                    continue
                made = apply_one(kind, content, section, added, removed, part_removes or [], split_target)
                content = made.content
                rows.append((target, place, key, made.action, made.error, content, *(made.created or (None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return ordered.mapInArrow(run, RESULT)


def decide(confidence: Column, dry_run: bool = False, yes: bool = False, least: float | None = None, choice: Column | None = None) -> Column:
    """accept or skip: a dry run skips all, then ``yes`` accepts all, then the threshold, then the reviewer's choice."""
    if dry_run:
        return F.lit("skip")
    if yes:
        return F.lit("accept")
    if least is not None:
        return F.when(confidence >= least, "accept").otherwise("skip")
    return F.coalesce(choice, F.lit("skip")) if choice is not None else F.lit("skip")


def rule_counts(applied: DataFrame) -> DataFrame:
    """One row of applied suggestions(type, added_lines): rules added, updated, removed and split. A consolidation removes one
    and adds one, and list lines after the first count as added."""
    bullets = F.size(F.filter(F.coalesce("added_lines", F.array().cast("array<string>")), lambda x: x.startswith("- ") | x.startswith("* ")))
    more, of = F.coalesce(F.sum(F.greatest(bullets - 1, F.lit(0))), F.lit(0)), lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    return applied.agg((of("add", "consolidate") + more).alias("added"), of("update").alias("updated"), of("remove", "consolidate").alias("removed"), of("split").alias("split"))


def review_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if((F.col("action") != "skipped") & F.col("error").isNull()).alias("accepted"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(F.col("action") == "skipped").alias("skipped"), F.count_if(F.col("created_file").isNotNull()).alias("split"),
    )
