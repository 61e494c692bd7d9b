"""Shards with size-tiered compaction under a versioned manifest.

Arrivals are written as small immutable shard files. Compaction looks at sizes: files whose sizes lie within the
same power of ``fanout`` form a tier; when a tier has ``fanout`` files or more, they are merged in order of arrival
into files of about ``target_bytes``. A merge group is read and written by one task, without a shuffle. A version
becomes visible when its manifest is renamed into place, and a rename never replaces an existing manifest, so of two
writers one loses; it then tries again on top of the other's version. Readers open the files of one manifest. ``vacuum``
removes the files that none of the newest ``retain`` manifests names, if they are older than a grace period, in which
a writer may still commit them.

The driver handles file names and sizes, never rows. Defined results: rows are kept as they are (nulls, repeats, very long
texts, extra columns of any name); an empty arrival adds no shard; an empty store reads as no rows of its schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 32 << 20
UNIT_BYTES = 1 << 20
FANOUT = 4
GROUPS_PER_JOB = 64
ARRIVALS = 8
#: Versions that a vacuum leaves readable, and how old a file must be to go, in seconds.
RETAIN, GRACE_S = 2, 86_400.0
ATTEMPTS = 10


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int
    arrival: int
    merges: int


def free_name(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name in taken:
        name += "_"
    return name


class ConcurrentCommit(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.target_bytes, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ---

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _list(self, name: str) -> list[tuple[str, int]]:
        fs, at = self._fs(), self._path(name)
        if not fs.exists(at):
            return []
        found = [(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(at)]
        return sorted((n, size) for n, size, is_dir in found if not is_dir and not n.startswith(("_", ".")))

    def _dirs(self, name: str) -> list[str]:
        fs, at = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    # --- manifest ---

    def version(self) -> int:
        return max((int(n[1:-5]) for n, _ in self._list("manifest") if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> tuple[list[Shard], T.StructType | None]:
        version = self.version() if version is None else version
        if not version:
            return [], None
        stream = self._fs().open(self._path(f"manifest/v{version:08d}.json"))
        try:
            body = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return [Shard(**s) for s in body["shards"]], T.StructType.fromJson(body["schema"])

    def _commit(self, base: int, shards: list[Shard], schema: T.StructType) -> int:
        """Make version base + 1 visible, or raise if another writer has."""
        body = json.dumps({"version": base + 1, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]})
        fs = self._fs()
        draft, final = self._path(f"manifest/.draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{base + 1:08d}.json")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf) if draft.toUri().getScheme() else self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(draft, final, options)
        except Exception as e:
            fs.delete(draft, False)
            if fs.exists(final):
                raise ConcurrentCommit(f"version {base + 1} exists") from e
            raise
        return base + 1

    # --- writing ---

    def _add(self, new: list[Shard], schema: T.StructType) -> int:
        """Commit new shards on top of the newest version, behind its arrivals; a writer that loses a race tries again."""
        for attempt in range(ATTEMPTS):
            base = self.version()
            shards, have = self.manifest(base)
            if have is not None and [(f.name, f.dataType) for f in have] != [(f.name, f.dataType) for f in schema]:
                raise ValueError("the arrival's columns differ from the store's")
            arrival = 1 + max((s.arrival for s in shards), default=-1)
            try:
                return self._commit(base, shards + [replace(s, arrival=arrival) for s in new], schema)
            except ConcurrentCommit:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def append(self, rows: DataFrame, arrival_col: str | None = None) -> int:
        """Add rows as new shards. With ``arrival_col`` (integers from 0), the files of all arrivals are written in one job, and
        each arrival is committed as a version of its own, in order; that column is not stored."""
        own = T.StructType([f for f in rows.schema if f.name != arrival_col])
        name = f"data/{uuid.uuid4().hex}"
        if not arrival_col:
            rows.write.parquet(f"{self.path}/{name}")
            folders = [name]
        else:
            number = free_name("arrival", rows.columns)
            rows.withColumn(number, F.col(arrival_col).cast("int")).drop(arrival_col).write.partitionBy(number).parquet(f"{self.path}/{name}")
            values = {d: d.split("=")[1] for d in self._dirs(name)}
            if any(not v.isdigit() for v in values.values()):
                raise ValueError("an arrival number is null or negative")
            folders = [f"{name}/{d}" for d in sorted(values, key=lambda d: int(values[d]))]
        version = self.version()
        for folder in folders or [name]:
            version = self._add([Shard(f"{folder}/{file}", size, 0, 0) for file, size in self._list(folder)], own)
        return version

    def tier(self, size: int) -> int:
        return 0 if size <= UNIT_BYTES else 1 + int(math.log(size / UNIT_BYTES, self.fanout))

    def _groups(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: files of one tier, in order of arrival, up to the target each."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target_bytes * 3 // 4:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        groups = []
        for _, files in sorted(tiers.items()):
            if len(files) < self.fanout:
                continue
            run: list[Shard] = []
            for s in sorted(files, key=lambda s: (s.arrival, s.file)):
                if run and sum(r.bytes for r in run) + s.bytes > self.target_bytes * 5 // 4:
                    groups.append(run)
                    run = []
                run.append(s)
            groups.append(run)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier is full; each pass is committed before the next. What other writers have appended in the
        meantime stays; if they have merged the same files, this pass counts for nothing and the next begins anew."""
        attempts = 0
        while True:
            base = self.version()
            shards, schema = self.manifest(base)
            groups = self._groups(shards)
            if not groups:
                return base
            new: list[Shard] = []
            for at in range(0, len(groups), GROUPS_PER_JOB):
                batch = groups[at : at + GROUPS_PER_JOB]
                parts = [self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.file}" for s in g]).coalesce(1) for g in batch]
                name = f"data/{uuid.uuid4().hex}"
                with self._separate_unions():
                    reduce(DataFrame.union, parts).write.parquet(f"{self.path}/{name}")
                # part files are numbered by partition, and partition i is group i
                for file, size in self._list(name):
                    g = batch[int(file.split("-")[1])]
                    new.append(Shard(f"{name}/{file}", size, min(s.arrival for s in g), 1 + max(s.merges for s in g)))
            gone = {s.file for g in groups for s in g}
            while gone <= {s.file for s in shards}:
                try:
                    self._commit(base, [s for s in shards if s.file not in gone] + new, schema)
                    break
                except ConcurrentCommit:
                    attempts += 1
                    if attempts >= ATTEMPTS:
                        raise
                    base = self.version()
                    shards, schema = self.manifest(base)

    @contextmanager
    def _separate_unions(self):
        """A union of one-partition inputs keeps one partition for each (else Spark makes them one)."""
        name = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def vacuum(self, retain: int = RETAIN, grace_s: float = GRACE_S) -> int:
        """Delete the manifests before the newest ``retain``, and data files that none of these names and that are older than
        the grace period; returns how many data files went."""
        before = time.time() * 1000 - grace_s * 1000
        kept = [int(n[1:-5]) for n, _ in self._list("manifest") if n.startswith("v")][-max(1, retain) :]
        named = {s.file for v in kept for s in self.manifest(v)[0]}
        fs, gone = self._fs(), 0
        for top in self._dirs("data"):
            for folder in (f"data/{top}", *[f"data/{top}/{d}" for d in self._dirs(f"data/{top}")]):
                for file, _ in self._list(folder):
                    at = self._path(f"{folder}/{file}")
                    if f"{folder}/{file}" not in named and fs.getFileStatus(at).getModificationTime() <= before:
                        gone += bool(fs.delete(at, False))
        for n, _ in self._list("manifest"):
            if n.startswith("v") and int(n[1:-5]) < min(kept, default=0):
                fs.delete(self._path(f"manifest/{n}"), False)
        return gone

    # --- reading ---

    def read(self, version: int | None = None, file_col: str = "shard_file") -> DataFrame:
        """The rows of a version, with ``file_col`` naming the file that holds each."""
        shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("the store has no version yet")
        if not shards:
            return self.spark.createDataFrame([], schema).withColumn(file_col, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{s.file}" for s in shards])
        return rows.select("*", F.regexp_extract("_metadata.file_path", ".*/(data/.+)$", 1).alias(file_col))


def shard_documents(docs: DataFrame, path: str, id_col: str = "doc_id", arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> ShardStore:
    """Append ``docs`` as ``arrivals`` arrivals, a version each; compact; and remove what no retained version names."""
    store = ShardStore(docs.sparkSession, path, target_bytes, fanout)
    number = free_name("arrival_no", docs.columns)
    store.append(docs.withColumn(number, F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(arrivals))), number)
    store.compact()
    store.vacuum()
    return store
