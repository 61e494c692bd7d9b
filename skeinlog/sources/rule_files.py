"""Discovery and reading of Markdown rule files of a project."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: File names, and folders that are not searched.
RULES_FILE, LOCAL_FILE, RULES_DIR = "CLAUDE.md", "CLAUDE.local.md", ".claude"
IGNORED = ("node_modules", ".git", ".hg", ".svn", "dist", "build", ".next", ".nuxt", ".output", "vendor", "__pycache__", ".venv", "venv")
MAX_DEPTH = 3
#: The folder of the store in a project.
STORE_DIR = ".skeinlog"
#: What a project's root holds.
ROOT_MARKERS = (".git", "package.json", RULES_FILE, STORE_DIR)

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("relative_path", T.StringType()),
        T.StructField("content", T.StringType()), T.StructField("last_modified", T.DoubleType()), T.StructField("size_bytes", T.LongType()), T.StructField("ord", T.IntegerType()),
    ]
)


def project_root(start: str, home: str | None = None) -> str | None:
    """The nearest folder upwards that has a marker; never home or what lies above it, and None if there is no such folder."""
    home = Path(home or os.path.expanduser("~")).resolve()
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if folder == home:
            break
        if any((folder / m).exists() for m in ROOT_MARKERS):
            return str(folder)
    return None


def discover(root: str, home: str | None = None) -> list[tuple[str, str]]:
    """(path, scope) in order of precedence; a file reached twice keeps its first scope."""
    base, home = Path(root), Path(home or os.path.expanduser("~"))
    wanted = [(home / RULES_DIR / RULES_FILE, "global"), (base / RULES_FILE, "project"), (base / LOCAL_FILE, "project_local"), (base / RULES_DIR / RULES_FILE, "project")]
    wanted += [(p, "project") for p in sorted((base / RULES_DIR / "rules").glob("*.md"))]
    wanted += [(d / RULES_FILE, "subdirectory") for d in _below(base, MAX_DEPTH)]
    seen, out = set(), []
    for path, scope in wanted:
        real = os.path.realpath(path)
        if os.path.isfile(real) and real not in seen:
            seen.add(real)
            out.append((str(path), scope))
    return out


def _below(parent: Path, depth: int) -> list[Path]:
    """The folders below one, each followed by those in it."""
    return [x for d in _folders(parent) for x in (d, *_below(d, depth - 1))] if depth else []


def _folders(parent: Path) -> list[Path]:
    try:
        return sorted(d for d in parent.iterdir() if d.is_dir() and d.name not in IGNORED and not d.name.startswith("."))
    except OSError:
        return []


def read(spark: SparkSession, root: str, home: str | None = None) -> DataFrame:
    """The rule files of one project (a handful of small files on the driver's disk), as a DataFrame."""
    rows = []
    for i, (path, scope) in enumerate(discover(root, home)):
        try:
            raw = Path(path).read_bytes()
        except OSError:  # a file that cannot be read counts as empty
            raw = b""
        try:
            content = raw.decode("utf-8")
        except UnicodeDecodeError:
            content = raw.decode("latin-1")
        rel = os.path.relpath(path, root) if not os.path.relpath(path, root).startswith("..") else path
        rows.append((path, scope, rel, content.replace("\r\n", "\n"), os.path.getmtime(path) * 1000, len(raw), i))
    return spark.createDataFrame(rows, SCHEMA)
