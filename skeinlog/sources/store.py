"""The store of an analysis: partitioned Parquet tables, versioned tables, an audit log, an append-only history.

A versioned table is a folder of immutable versions and a pointer file that names one. A new version is written beside the others and the
pointer renamed over the old one, which the file system does in one step, so a reader sees the old version or the new one, also when a
writer dies on the way. What belongs together (a snapshot and the files that it was made from) is one version.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_VERSION = 1
AUDIT = "session_id string, parsed_at string, analyzed_at string, analysis_prompt_version string, insight_count int, session_mtime double, seq long"


class Store:
    """Tables under one folder. A session's results replace its partition; batches are appended under their id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf), at

    def exists(self, name: str) -> bool:
        fs, path = self._fs(self._at(name))
        return fs.exists(path)

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """A table; without one no rows of the schema, or None if none is given. A table that has been written without rows is none."""
        if not self.exists(name):
            return self.spark.createDataFrame([], schema) if schema else None
        if schema:
            return self.spark.read.schema(schema).parquet(self._at(name))
        try:
            return self.spark.read.parquet(self._at(name))
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
                return None
            raise

    def read_tolerant(self, name: str, schema: str) -> tuple[DataFrame, DataFrame]:
        """The rows of a table's readable files, and (path, length, error) of the others.

        Footers are read in tasks. Files that gave no row are the only ones that are looked at again: those that end as Parquet
        files do are empty, the others broken.
        """
        nothing = self.spark.createDataFrame([], "path string, length long, error string")
        if not self.exists(name):
            return self.spark.createDataFrame([], schema), nothing
        rows = self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(self._at(name))
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self._at(name))
        plain = lambda c: F.regexp_replace(F.url_decode(c), "^file:/+", "file:/")
        gave = rows.select(plain(F.col("_metadata.file_path")).alias("__path")).distinct()
        silent = files.select("path", plain(F.col("path")).alias("__path")).join(gave, "__path", "left_anti")
        suspects = [r["path"] for r in silent.select("path").collect()]  # files without a row, which are few or tiny
        if not suspects:
            return rows, nothing
        looked = self.spark.read.format("binaryFile").load(suspects)
        ends = lambda c: F.hex(F.substring("content", c, 4)) == "50415231"
        error = F.when(F.col("length") < 12, "too short").when(~ends(1), "no magic number at the start").when(~ends(-4), "no footer at the end")
        # a file that is whole and gave no row is empty, unless its footer can't be read
        footer = F.reverse(F.substring("content", -8, 4))
        too_long = F.conv(F.hex(footer), 16, 10).cast("long") + 12 > F.col("length")
        return rows, looked.select("path", "length", F.coalesce(error, F.when(too_long, "a footer longer than the file")).alias("error")).where("error is not null")

    # --- versions ---

    def replace(self, name: str, **tables: DataFrame) -> str:
        """Write a new version of a table of several parts, and point to it."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for part, rows in tables.items():
            rows.write.parquet(self._at(f"{name}/versions/{version}/{part}"))
        self._point(name, version)
        return version

    def _point(self, name: str, version: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, draft = self._fs(self._at(f"{name}/.current-{uuid.uuid4().hex}"))
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        target = jvm.org.apache.hadoop.fs.Path(self._at(f"{name}/current"))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), conf).rename(draft, target, how)

    def version(self, name: str) -> str | None:
        """The version that is pointed to; None without any."""
        fs, path = self._fs(self._at(f"{name}/current"))
        if not fs.exists(path):
            return None
        held = fs.open(path)
        try:
            return bytes(held.readNBytes(200)).decode()
        finally:
            held.close()

    def part(self, name: str, part: str, version: str | None = None) -> DataFrame | None:
        """A part of the newest version, or of the one that is named."""
        version = version or self.version(name)
        return None if version is None else self.read(f"{name}/versions/{version}/{part}")

    def invalidate(self, name: str) -> None:
        """Forget a versioned table: from here on there is none, until it is written again."""
        fs, path = self._fs(self._at(f"{name}/current"))
        fs.delete(path, False)

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Remove all but the newest versions and the one pointed to; how many went. Readers of the kept ones aren't disturbed."""
        fs, path = self._fs(self._at(f"{name}/versions"))
        if not fs.exists(path):
            return 0
        found = sorted(f.getPath().getName() for f in fs.listStatus(path))
        old = [v for v in found[: max(0, len(found) - keep)] if v != self.version(name)]
        for v in old:
            fs.delete(self._fs(self._at(f"{name}/versions/{v}"))[1], True)
        return len(old)

    # --- keyed and batched tables ---

    def save_sessions(self, name: str, rows: DataFrame) -> None:
        """Keyed overwrite: partitions of the sessions in ``rows`` are replaced, others stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(self._at(name))

    def load(self, name: str, session_id: str) -> DataFrame | None:
        """One session's results; its partition alone is read."""
        rows = self.read(name)
        return None if rows is None else rows.where(F.col("session_id") == session_id)

    def append_batch(self, name: str, rows: DataFrame, batch_id: str) -> None:
        """A batch under its id; a rerun of the batch replaces it."""
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self._at(name))

    def latest(self, name: str) -> DataFrame | None:
        """The rows of the largest batch id; its partition alone is read."""
        rows = self.read(name)
        if rows is None:
            return None
        newest = rows.agg(F.max(F.col("batch_id").cast("string"))).first()[0]
        return rows.where(F.col("batch_id").cast("string") == newest)

    def by_cache_key(self, name: str, key: str) -> DataFrame | None:
        """The newest batch with this cache key."""
        rows = self.read(name)
        if rows is None:
            return None
        hits = rows.where(F.col("cache_key") == key)
        newest = hits.agg(F.max(F.col("batch_id").cast("string"))).first()[0]
        return hits.where(F.col("batch_id").cast("string") == newest) if newest is not None else None

    def audit(self) -> DataFrame:
        """The last record of each session: the snapshot, and the log's records since it. Records of another version don't count."""
        snapshot = self.part("audit", "sessions")
        log = self.read("audit/log", f"{AUDIT}, version int").where(F.col("version") == AUDIT_VERSION)
        names = [c.split()[0] for c in AUDIT.split(", ")]
        if snapshot is not None:
            until = self.part("audit", "until").first()["seq"]
            log = log.where(F.col("seq") > until).select(*names).unionByName(snapshot)  # partitions of the log before it aren't read
        newest = log.groupBy("session_id").agg(F.max_by(F.struct(*names), "seq").alias("r"))
        return newest.select("r.*")

    def mark(self, rows: DataFrame) -> None:
        """Upsert of audit(session_id, and any of its other columns): given values win over the recorded ones."""
        before = self.audit()
        names = [c.split()[0] for c in AUDIT.split(", ")]
        # later than what is recorded, and apart from what another writer records meanwhile
        start = max((before.agg(F.max("seq")).first()[0] or 0) + 1, time.time_ns())
        old = before.select("session_id", *[F.col(n).alias(f"__{n}") for n in names[1:]])
        new = rows.join(old, "session_id", "left")
        kinds = dict(c.split() for c in AUDIT.split(", "))
        pick = lambda n: F.coalesce(F.col(n), F.col(f"__{n}")) if n in rows.columns else F.col(f"__{n}")
        out = new.select("session_id", *[pick(n).cast(kinds[n]).alias(n) for n in names[1:-1]], F.lit(start).cast("long").alias("seq"), F.lit(AUDIT_VERSION).alias("version"))
        # the audit is read above, so the new records go beside the old ones, which they outrank
        out.write.mode("append").partitionBy("seq").parquet(self._at("audit/log"))

    def mark_cross_done(self, at: str, version: str) -> None:
        """Record that patterns over all sessions have been looked for."""
        self.replace("cross_audit", done=self.spark.createDataFrame([(at, version)], "analyzed_at string, prompt_version string"))

    def cross_done(self) -> DataFrame | None:
        return self.part("cross_audit", "done")

    def compact_audit(self) -> None:
        """Fold the log into a snapshot, so that later reads and marks read that and what comes after it. The log before it is removed once
        the snapshot is pointed to."""
        now = self.audit()
        until = now.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq"))
        self.replace("audit", sessions=now, until=until)
        last = self.part("audit", "until").first()["seq"]
        fs, path = self._fs(self._at("audit/log"))
        if fs.exists(path):
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.startswith("seq=") and int(name[4:]) <= last:
                    fs.delete(f.getPath(), True)

    def append_history(self, rows: DataFrame) -> None:
        rows.write.mode("append").json(self._at("history"))

    def history(self) -> DataFrame:
        return self.spark.read.json(self._at("history"))


def cache_is_valid(current: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: whether both name the same paths and no file is newer than its cached state."""
    c, k = current.select("path", F.col("mtime").alias("now")), cached.select("path", F.col("mtime").alias("then"))
    bad = F.col("now").isNull() | F.col("then").isNull() | (F.col("now") > F.col("then"))
    return c.join(k, "path", "full_outer").agg((~F.coalesce(F.bool_or(bad), F.lit(False))).alias("valid"))


def fresh(listed: DataFrame, cached: DataFrame) -> DataFrame:
    """Listed sessions(session_id, mtime) with ``fresh``: they are cached, no earlier than their last change."""
    at = cached.select("session_id", "cached_at")
    return listed.join(at, "session_id", "left").withColumn("fresh", F.coalesce(F.col("mtime") <= F.col("cached_at"), F.lit(False))).drop("cached_at")


def cached_or_built(store: Store, name: str, files: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table if its files (path, mtime) are still the same; else a new one. Both are one version."""
    version = store.version(name)
    if version is not None and cache_is_valid(files, store.part(name, "files", version)).first()["valid"]:
        return store.part(name, "rows", version)
    version = store.replace(name, rows=build(), files=files)
    return store.part(name, "rows", version)
