"""Watching growing transcripts: a listing source, keyed change detection with a cooldown, and the batch step.

Spark's file source emits a file once, so the source here emits one row per file and poll with its size and
modification time. State per session decides what has become a candidate, a timer when it rests, and tables of the store what is done.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinlog.sources.store import Store

GROWTH_BYTES = 5120
POLL_S, COOLDOWN_S = 300, 60
LISTING = "session_id string, path string, size long, mtime double, poll long"
#: Fixed: what a user asks the product for.
COMMANDS = ("analyze", "review", "suggest", "apply", "watch", "run")


@dataclass(frozen=True)
class Seen:
    mtime: float
    size: int
    analyzed: bool


def step(seen: Seen | None, size: int, mtime: float, growth: int = GROWTH_BYTES) -> tuple[Seen, bool]:
    """The next state of a session and whether it is a candidate. The size is kept at every poll, so growth counts from the previous one."""
    if seen is None:
        return Seen(mtime, size, False), True
    return Seen(mtime, size, seen.analyzed), not seen.analyzed and size - seen.size > growth


class ListingReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root, self.polls = root, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"poll": 0}

    def _list(self, poll: int) -> list[tuple]:
        rows = []
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                if name.endswith(".jsonl"):
                    path = os.path.join(folder, name)
                    s = os.stat(path)
                    rows.append((name.removesuffix(".jsonl"), path, s.st_size, s.st_mtime * 1000, poll))
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        poll = start["poll"] + 1
        self.polls[poll] = rows = self._list(poll)
        return iter(rows), {"poll": poll}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        # the same rows again where this reader made them; after a restart the folder as it is, which only moves a growth forward
        return iter(self.polls.get(end["poll"]) or self._list(end["poll"]))

    def commit(self, end: dict) -> None:
        self.polls = {p: rows for p, rows in self.polls.items() if p > end["poll"]}


class SessionListing(DataSource):
    """``spark.readStream.format("session_listing").option("path", root)``"""

    @classmethod
    def name(cls) -> str:
        return "session_listing"

    def schema(self) -> str:
        return LISTING

    def simpleStreamReader(self, schema) -> ListingReader:  # noqa: N802
        return ListingReader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SessionListing)
    return spark.readStream.format("session_listing").option("path", root).load()


def baseline(now_listing: DataFrame, audit: DataFrame) -> DataFrame:
    """What is known as a watch begins: every session that is there already, and whether the audit knows it as analysed."""
    done = audit.where("analyzed_at is not null").select("session_id", F.lit(True).alias("__done")).distinct()
    now = now_listing.select("session_id", F.col("mtime").alias("base_mtime"), F.col("size").alias("base_size"))
    return now.join(done, "session_id", "left").withColumn("base_analyzed", F.coalesce("__done", F.lit(False))).drop("__done")


#: transformWithState keeps its state and timers in RocksDB.
STATE_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FOUND = "session_id string, size long, mtime double, poll long"


class Growth(StatefulProcessor):
    """What is known of one session, and its cooldown.

    A session that is new or has grown becomes a candidate with a timer; each further change moves the timer on, and when it
    expires the candidate is sent. All of it is state of the query, so a restart between growth and timer loses nothing
    and sends nothing twice.
    """

    def __init__(self, growth: int, cooldown_ms: int) -> None:
        self.growth, self.cooldown_ms = growth, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "mtime double, size long, analyzed boolean")
        self.found = handle.getValueState("found", "size long, mtime double, poll long, due long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        r = next(initialState.itertuples())
        self.seen.update((float(r.base_mtime), int(r.base_size), bool(r.base_analyzed)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = Seen(*self.seen.get()) if self.seen.exists() else None
        found = tuple(self.found.get()) if self.found.exists() else None
        before, out = found, []
        due = timerValues.getCurrentProcessingTimeInMs() + self.cooldown_ms
        for r in pd.concat(list(rows)).sort_values("poll").itertuples():
            size, mtime = int(r.size_bytes), float(r.mtime)
            seen, hit = step(seen, size, mtime, self.growth)
            if hit and not self.cooldown_ms:
                out.append((key[0], size, mtime, int(r.poll)))
            elif hit or (found is not None and mtime != found[1]):
                found = (size, mtime, int(r.poll), due)
        self.seen.update((seen.mtime, seen.size, seen.analyzed))
        if found != before:
            if before is not None:
                self.handle.deleteTimer(before[3])
            self.found.update(found)
            self.handle.registerTimer(found[3])
        yield pd.DataFrame(out, columns=["session_id", "size", "mtime", "poll"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = self.found.get() if self.found.exists() else None
        rests = found is not None and found[3] <= expiredTimerInfo.getExpiryTimeInMs()
        if rests:
            self.found.clear()
        yield pd.DataFrame([(key[0], *found[:3])] if rests else [], columns=["session_id", "size", "mtime", "poll"])

    def close(self) -> None:
        pass


def candidates(rows: DataFrame, growth: int = GROWTH_BYTES, known: DataFrame | None = None, cooldown_s: float = 0) -> DataFrame:
    """(session_id, size, mtime, poll) of sessions that are new or have grown and then rested for the cooldown (none: at once), over a
    stream of listings. The baseline ``known`` is the state that a new query begins with. The session needs ``STATE_PROVIDER``."""
    named = rows.withColumnRenamed("size", "size_bytes")  # a frame's own size would hide the column
    initial = None if known is None else known.groupBy("session_id")
    mode = "processingTime" if cooldown_s else "none"
    return named.groupBy("session_id").transformWithStateInPandas(Growth(growth, round(cooldown_s * 1000)), FOUND, "append", mode, initial)


def replay(polls: DataFrame, growth: int = GROWTH_BYTES) -> DataFrame:
    """The same candidates from a finished table of listings (session_id, size, mtime, poll)."""
    before = F.lag("size").over(Window.partitionBy("session_id").orderBy("poll"))
    own = polls.select("session_id", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), F.col("poll").cast("long").alias("poll"))
    return own.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("size") - F.col("__before") > growth)).drop("__before")


def stable(found: DataFrame, now_listing: DataFrame) -> DataFrame:
    """Candidates whose file hasn't changed since they were found; the rest wait for their next growth."""
    now = now_listing.select("session_id", F.col("mtime").alias("__now"))
    return found.join(now, "session_id").where(F.col("mtime") == F.col("__now")).drop("__now")


def not_analyzed(found: DataFrame, audit: DataFrame) -> DataFrame:
    return found.join(audit.where("analyzed_at is not null").select("session_id"), "session_id", "left_anti")


def own_sessions(messages: DataFrame, products: tuple[str, ...], shell: str = "Bash", first: int = 5) -> DataFrame:
    """Sessions in whose first messages the user asks for the product, or its command is run."""
    any_of = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.coalesce(x.contains(w), F.lit(False)))
    low = F.lower("text_content")
    asked = (F.col("role") == "user") & any_of(low, products) & any_of(low, COMMANDS)
    ran = (F.col("role") == "assistant") & F.exists("tool_uses", lambda u: (u["name"] == shell) & any_of(F.get_json_object(u["input"], "$.command"), products))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("msg_idx"))
    head = messages.withColumn("__n", n).where(F.col("__n") <= first)
    return head.where(asked | ran).select("session_id").distinct()


DONE = "session_id string, size long, outcome string, batch_id string"


@dataclass
class Watch:
    """What happens to the candidates of a micro-batch.

    They are written to the store first, and a session at one size is done once its outcome is written too. So a batch that
    Spark repeats does nothing twice, and what failed, or was found by a batch that failed, is taken up by the next one: the work
    of a batch is all that has been found and isn't done. Sessions that the audit knows as analysed, and the product's own, are
    left out.
    """

    store: Store
    own: Callable[[DataFrame], DataFrame]
    #: Gets the sessions to process and the batch's number; gives the sessions that it dealt with, or None for all of them.
    process: Callable[[DataFrame, int], DataFrame | None]
    counts: Counter = field(default_factory=Counter)
    errors: list[tuple[int, str]] = field(default_factory=list)

    def open(self) -> DataFrame:
        """The newest find of each session that isn't done at that size."""
        found = self.store.read("watch_found", f"{FOUND}, batch_id string")
        newest = found.groupBy("session_id").agg(F.max_by(F.struct("size", "mtime", "poll"), "poll").alias("r")).select("session_id", "r.*")
        return newest.join(self.store.read("watch_done", DONE).select("session_id", "size"), ["session_id", "size"], "left_anti")

    def batch(self, found: DataFrame, batch_id: int) -> None:
        """The step of foreachBatch. An error is noted and the watch goes on."""
        work = None
        try:
            counted = Observation()
            self.store.append_batch("watch_found", found.observe(counted, F.count(F.lit(1)).alias("n")), str(batch_id))
            self.counts.update(polls=1, found=counted.get["n"])
            work = self.open().persist()
            todo = not_analyzed(work, self.store.audit())
            todo = todo.join(self.own(todo).select("session_id"), "session_id", "left_anti")
            left = work.join(todo.select("session_id"), "session_id", "left_anti")
            n, n_todo = work.count(), todo.count()
            self.counts.update(left_out=n - n_todo)
            self._done(left, "left out", f"{batch_id}-left", n - n_todo)
            if n_todo:
                finished = self.process(todo, batch_id)
                done = todo if finished is None else todo.join(finished.select("session_id").distinct(), "session_id", "left_semi")
                n_done = self._done(done, "processed", str(batch_id), n_todo)
                self.counts.update(processed=n_done, failed=n_todo - n_done)
        except Exception as e:  # the watch goes on; what is open stays open
            self.counts.update(errors=1)
            self.errors.append((batch_id, f"{type(e).__name__}: {e}"))
        finally:
            if work is not None:
                work.unpersist()

    def _done(self, rows: DataFrame, outcome: str, batch: str, most: int) -> int:
        """Write an outcome; how many sessions have it, counted as they are written."""
        if not most:
            return 0
        counted = Observation()
        marked = rows.select("session_id", "size", F.lit(outcome).alias("outcome")).observe(counted, F.count(F.lit(1)).alias("n"))
        self.store.append_batch("watch_done", marked, batch)
        return counted.get["n"]

    def summary(self) -> dict[str, int]:
        return {k: self.counts[k] for k in ("polls", "found", "left_out", "processed", "failed", "errors")}


def watch(spark: SparkSession, root: str, work: Watch, checkpoint: str, poll_s: float = POLL_S, growth: int = GROWTH_BYTES, cooldown_s: float = COOLDOWN_S):
    """Start the query: sessions that are there already are the baseline, and each poll's candidates go through ``work``."""
    spark.conf.set(*STATE_PROVIDER)
    found = candidates(listing(spark, root), growth, baseline(list_now(spark, root), work.store.audit()), cooldown_s)
    return found.writeStream.foreachBatch(work.batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=f"{poll_s} seconds").start()


def list_now(spark: SparkSession, root: str) -> DataFrame:
    """The listing as it is, without a stream."""
    return spark.createDataFrame(ListingReader(root)._list(0), LISTING)


__all__ = ["Growth", "Seen", "SessionListing", "Watch", "baseline", "candidates", "list_now", "listing", "not_analyzed", "own_sessions", "replay", "stable", "step", "watch"]
