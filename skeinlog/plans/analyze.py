"""The analysis as one plan: transcripts and rule files in, insights, patterns and ranked suggestions out.

Prompts and answers are written to the store before anything reads them, and an answer is kept under the digest of its prompt, so that a retried
task, a repeated batch or a later run never repeats a model call that has succeeded. Everything else is DataFrame work between
these tables. Counts of a run come with its writes (observed), not from second scans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators import combined, dedup, edits, insights, messages, model_calls, rules, sessions, suggestions, tool_usage
from skeinlog.operators.ranking import numbered
from skeinlog.plans import prompts
from skeinlog.sources import rule_files, transcripts
from skeinlog.sources.scratch import written
from skeinlog.sources.store import Store, cached_or_built
from skeinlog.streaming import watch

#: Findings in one prompt of the synthesis, and characters of each one's title: a bound on the prompt.
FINDINGS, TITLE_CHARS = 200, 200
CALLS = "prompt_hash string, raw string, error string"
OCCURRENCES = "id string, session_id string, insight_id string"


@dataclass
class Result:
    sessions: DataFrame
    insights: DataFrame
    patterns: DataFrame
    suggestions: DataFrame
    skipped: DataFrame
    stats: DataFrame
    #: What the run did: sessions asked and analysed, model calls made and failed, insights, those below the least confidence, patterns, suggestions.
    run: dict[str, int] = field(default_factory=dict)
    #: In a combined run, each session's suggestions that were kept when it had been folded in.
    by_session: DataFrame | None = None


class Analysis:
    def __init__(self, spark: SparkSession, transcripts_root: str, project_root: str, store: Store, backend: Callable[[str], str], home: str | None = None) -> None:
        self.spark, self.store, self.backend, self.root = spark, store, backend, transcripts_root
        self.files = rule_files.read(spark, project_root, home)
        self.rules = cached_or_built(store, "rules_cache", self.files.select("path", F.col("last_modified").alias("mtime")), lambda: rules.parse(self.files))
        self.counts: dict[str, int] = {}
        self.scan()

    def scan(self) -> None:
        """Look at the transcripts as they are now."""
        self.lines = transcripts.parsed(transcripts.lines(self.spark, self.root))
        self.sessions = transcripts.sessions(self.lines)
        self.messages = transcripts.messages(self.lines)

    def to_analyze(self, prompt_version: str, least: int = sessions.MIN_USER_MESSAGES, limit: int | None = None) -> DataFrame:
        """Long enough sessions, newest first, that the audit doesn't know as done; the limit counts before the audit does."""
        enough = sessions.analyzable(self.sessions, least).withColumn("mtime", F.unix_millis("modified_at").cast("double"))
        if limit is not None:
            enough = enough.orderBy(F.coalesce("created_at", "modified_at").desc(), "session_id").limit(limit)
        return sessions.change_status(enough, self.store.audit(), prompt_version).where("needs_analysis")

    def rules_text(self) -> str:
        """All rules as text; rule files are few and small."""
        return "\n".join(r["rendered"] for r in rules.render(self.rules).orderBy("source_file").collect()) or "(No rules files exist yet.)"

    def session_prompts(self, wanted: DataFrame, seed: int = 0, prompt: str = prompts.SINGLE) -> DataFrame:
        own = self.messages.join(wanted.select("session_id"), "session_id", "left_semi")
        sampled = messages.sample(messages.prepare(own), seed)
        conversation = messages.render(sampled, order="sort")
        usage = tool_usage.render(tool_usage.summary(own)).withColumnRenamed("rendered", "usage")
        joined = conversation.join(usage, "session_id", "left")
        values = {"rules": F.lit(self.rules_text()), "usage": F.coalesce("usage", F.lit("")), "conversation": F.col("rendered"), "existing": F.lit("(nothing)"), "insights": F.lit("(those that you find)")}
        return joined.select("session_id", X.template(F.lit(prompt), values).alias("prompt"))

    def _count(self, **more: int) -> None:
        for k, v in more.items():
            self.counts[k] = self.counts.get(k, 0) + v

    def _answers(self, name: str, asked: DataFrame, batch: str) -> DataFrame:
        """Ask the model what it hasn't answered yet, and keep what it says; prompts that are equal are asked once."""
        keyed = asked.withColumn("prompt_hash", F.sha2(F.col("prompt").cast("binary"), 256))
        self.store.append_batch(f"{name}_prompts", keyed, batch)
        shape = keyed.schema.simpleString()[len("struct<") : -1].replace(":", " ")
        own = self.store.read(f"{name}_prompts", f"{shape}, batch_id string").where(F.col("batch_id") == batch).drop("batch_id")
        known = self.store.read("calls", CALLS).where("error is null").select("prompt_hash")
        fresh = own.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"]).join(known, "prompt_hash", "left_anti")
        seen = Observation()
        said = model_calls.call(fresh, self.backend).select("prompt_hash", "raw", "error")
        said = said.observe(seen, F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed_calls"))
        said.write.mode("append").parquet(self.store._at("calls"))
        self._count(**seen.get)
        best = self.store.read("calls", CALLS).groupBy("prompt_hash").agg(F.max_by(F.struct("raw", "error"), F.col("error").isNull()).alias("r"))
        return model_calls.parse(own.join(best.select("prompt_hash", "r.*"), "prompt_hash", "left"))

    # --- the steps ---

    def analyse(self, wanted: DataFrame, batch: str, version: str, seed: int = 0, with_suggestions: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """Findings of the sessions that are wanted, kept and marked, and, with one combined call, raw suggestions; sessions whose call failed
        stay unmarked."""
        answers = self._answers("combined" if with_suggestions else "single", self.session_prompts(wanted, seed, prompts.COMBINED if with_suggestions else prompts.SINGLE), batch)
        said = answers.where("error is null").select("session_id", "value")
        found, changes = combined.from_answers(said, ["session_id"]) if with_suggestions else (insights.from_answers(said, ["session_id"]), None)
        seen = Observation()
        self.store.save_sessions("insights", found.observe(seen, F.count(F.lit(1)).alias("insights"), F.count_if(F.col("confidence") < insights.LEAST_CONFIDENCE).alias("filtered_out")))
        self._count(**seen.get)
        done = answers.where("error is null").join(wanted.select("session_id", "mtime"), "session_id").select(
            "session_id", F.lit(batch).alias("analyzed_at"), F.lit(version).alias("analysis_prompt_version"), F.col("mtime").alias("session_mtime")
        )
        marked = Observation()
        self.store.mark(done.observe(marked, F.count(F.lit(1)).alias("sessions")))
        self._count(sessions=marked.get["sessions"])
        return found, changes

    def known(self) -> DataFrame:
        """The confident findings of all sessions."""
        rows = self.store.read("insights")
        if rows is None:
            empty = self.spark.createDataFrame([], "session_id string, value string").select("session_id", F.try_parse_json("value").alias("value"))
            return insights.confident(insights.from_answers(empty, ["session_id"]))
        return insights.confident(rows.withColumn("session_id", F.col("session_id").cast("string")))

    def synthesize(self, known: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
        """Patterns over all sessions, and (id, session_id, insight_id) of the findings behind each.

        Findings are asked about in prompts of at most ``FINDINGS``; what is found there is merged in further rounds until one
        prompt holds it all. A merged pattern stands on the findings of its parts; a part that no later answer names stays a pattern.
        """
        items = known.select("id", "session_id", "category", F.substring("title", 1, TITLE_CHARS).alias("title"))
        source = items.select("id", "session_id", F.col("id").alias("insight_id"))  # of an item, the findings behind it
        done, links, level = None, None, 0
        n = items.count()
        if known.select("session_id").distinct().limit(2).count() < 2:
            n = 0
        while n:
            ranked = numbered(items, [F.col("category").asc(), F.col("title").asc(), F.col("id").asc()], "__n")
            brief = F.to_json(F.array_sort(F.collect_list(F.struct("session_id", "id", "category", "title"))))
            asked = ranked.groupBy(F.expr(f"cast((__n - 1) div {FINDINGS} as int)").alias("part")).agg(brief.alias("b"))
            asked = asked.select(F.concat(F.lit(f"{level}-"), F.col("part").cast("string")).alias("scope"), X.template(F.lit(prompts.CROSS), {"insights": F.col("b")}).alias("prompt"))
            raw = written(insights.from_answers(self._answers("cross", asked, f"{batch}-{level}").where("error is null").select("scope", "value"), ["scope"], cross=True, keep_raw=True), "patterns")
            named = insights.occurrences(raw.select("id", "v")).select("id", "insight_id", "session_id").distinct()
            # on an item: the findings behind it; on nothing that was asked about: the session that the answer names
            behind = source.select(F.col("id").alias("insight_id"), F.col("session_id").alias("of"), F.col("insight_id").alias("finding"))
            joined = named.join(behind, "insight_id", "left").select("id", F.coalesce("of", "session_id").alias("session_id"), F.coalesce("finding", "insight_id").alias("insight_id"))
            now = written(joined.where("session_id <> ''").distinct(), "occurrences")
            if done is not None:  # parts that no answer names
                left = done.join(named.select(F.col("insight_id").alias("id")).distinct(), "id", "left_anti")
                raw = written(raw.drop("v").unionByName(left), "patterns")
                now = written(now.unionByName(links.join(left.select("id"), "id", "left_semi")), "occurrences")
            done, links, before = raw.drop("v"), now, n
            n = done.count()
            if before <= FINDINGS or n >= before:  # one prompt held all, or nothing more comes together
                break
            items = done.select("id", F.lit("several").alias("session_id"), "category", F.substring("title", 1, TITLE_CHARS).alias("title"))
            source, level = links, level + 1
        if done is None:
            empty = self.spark.createDataFrame([], "scope string, value string").select("scope", F.try_parse_json("value").alias("value"))
            return insights.from_answers(empty, ["scope"], cross=True), self.spark.createDataFrame([], OCCURRENCES)
        self.store.append_batch("patterns", done, batch)
        self.store.append_batch("pattern_occurrences", links, batch)
        self.store.mark_cross_done(batch, "cross")
        self._count(patterns=n)
        return insights.confident(done), links

    def _existing(self) -> str:
        """Titles that are suggested already, which the prompt lists; as many as wait for a review."""
        before = self.store.latest("suggestions")
        return "\n".join(f"- {r['title']}" for r in suggestions.pending(before).select("title").collect()) if before is not None else ""

    def built(self, said: DataFrame, links: DataFrame) -> DataFrame:
        """Suggestions with their sessions, confidence and diff; those without a diff go."""
        out = suggestions.with_provenance(said.where("not skipped"), links)
        out = edits.with_diffs(edits.match_files(out, self.files), self.rules).where("diff is not null")
        return out.withColumn("added_text", edits.added_text(F.col("diff"))).drop("file_content")

    def suggest(self, known: DataFrame, patterns: DataFrame, seen: DataFrame, batch: str, version: str, scope: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """Ranked suggestions from findings and patterns (of the ids in ``scope`` alone, if given), and what the model skipped. The same findings and
        files give the suggestions that they gave before, without a call."""
        if scope is not None:
            known, patterns = insights.in_scope(known, scope, "id"), insights.in_scope(patterns, scope, "id")
        payload = written(insights.payload(known, patterns, seen), "payload")
        if payload.isEmpty():
            return None, None
        key = suggestions.cache_key(payload.select("id"), self.files, version).first()["key"]
        held = self.store.by_cache_key("suggestions", key)
        if held is not None:
            return held, held.limit(0)
        grouped = insights.batches(payload)
        told = F.struct("id", "source", "category", "title", "description", "suggested_rule", "confidence", "session_count")
        asked = grouped.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(told))).alias("i"))
        values = {"rules": F.lit(self.rules_text()), "existing": F.lit(self._existing() or "(nothing)"), "insights": F.col("i")}
        asked = asked.select("batch", X.template(F.lit(prompts.SUGGEST), values).alias("prompt"))
        said = suggestions.from_answers(self._answers("suggest", asked, batch).select("batch", "value"), ["batch"])
        links = known.select("id", "session_id").unionByName(seen.select("id", "session_id")).select(F.col("id").alias("insight_id"), "session_id")
        ranked = dedup.dedup_and_rank(self.built(said, links).withColumn("ord", F.col("batch") * 1_000_000 + F.col("ord")))
        counted = Observation()
        self.store.append_batch("suggestions", ranked.withColumn("cache_key", F.lit(key)).observe(counted, F.count(F.lit(1)).alias("suggestions")), batch)
        self._count(**counted.get)
        return self.store.by_cache_key("suggestions", key), said.where("skipped")

    def _version(self) -> str:
        return self.spark.range(1).select(X.digest(F.lit(prompts.SINGLE), 12)).first()[0]

    # --- whole runs ---

    def run(self, batch: str, limit: int | None = None, seed: int = 0) -> Result:
        """Sessions, then patterns over all of them, then suggestions."""
        self.counts, version = {}, self._version()
        self.analyse(self.to_analyze(version, limit=limit), batch, version, seed)
        known = self.known()
        patterns, seen = self.synthesize(known, batch)
        kept, skipped = self.suggest(known, patterns, seen, batch, version)
        none = kept if kept is not None else self.spark.createDataFrame([], "id string, type string, priority string, title string, status string")
        return Result(self.sessions, known, patterns, none, skipped if skipped is not None else none.limit(0), suggestions.stats(none, self.rules.count()), dict(self.counts))

    def run_combined(self, batch: str, limit: int | None = None, seed: int = 0, on_session: Callable[[str, int], None] | None = None) -> Result:
        """One call a session for findings and changes; each session's changes are folded into those of the sessions before it (oldest
        first), and ``on_session`` is told, in that order, how many of them were kept then. Changes from patterns are folded in last."""
        self.counts, version = {}, self._version()
        wanted = written(self.to_analyze(version, limit=limit), "wanted")
        found, changes = self.analyse(wanted, batch, version, seed, with_suggestions=True)
        known = self.known()
        patterns, seen = self.synthesize(known, batch)
        links = known.select("id", "session_id").unionByName(seen.select("id", "session_id")).select(F.col("id").alias("insight_id"), "session_id")
        turn = numbered(wanted.select("session_id", F.coalesce("created_at", "modified_at").alias("at")), [F.col("at").asc(), F.col("session_id").asc()], "step").select("session_id", "step")
        rows = self.built(changes.join(turn, "session_id"), links)
        cross, skipped = self.suggest(known.limit(0), patterns, seen, f"{batch}-cross", version)
        if cross is not None:
            last = F.lit((1 << 62) - 1).cast("long")
            shared = [c for c in rows.columns if c not in ("session_id", "step")]
            rows = rows.unionByName(cross.select(*shared).withColumns({"session_id": F.lit(None).cast("string"), "step": last}))
        ranked, by_session = dedup.by_step(written(rows, "changes"), "step")
        by_session = written(by_session, "by-session")
        counted = Observation()
        self.store.append_batch("suggestions", ranked.drop("step").withColumn("cache_key", F.lit(None).cast("string")).observe(counted, F.count(F.lit(1)).alias("suggestions")), batch)
        self.counts["suggestions"] = counted.get["suggestions"]
        if on_session is not None:
            each = turn.join(by_session.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")), "session_id", "left").orderBy("step")
            for r in each.toLocalIterator():
                on_session(r["session_id"], r["n"] or 0)
        kept = self.store.read("suggestions").where(F.col("batch_id").cast("string") == batch)
        return Result(self.sessions, known, patterns, kept, changes.where("skipped"), suggestions.stats(kept, self.rules.count()), dict(self.counts), by_session)

    # --- watching ---

    def watched(self, found: DataFrame, batch_id: int) -> DataFrame:
        """The step of a watch: analyse the sessions that were found, and suggest from their findings alone. Returned are the sessions that are
        dealt with: analysed, or too short."""
        self.scan()
        batch, version = f"watch-{batch_id}", self._version()
        own = written(found.select("session_id"), "found")
        there = self.sessions.join(own, "session_id", "left_semi").withColumn("mtime", F.unix_millis("modified_at").cast("double"))
        wanted = written(sessions.analyzable(there), "wanted")
        self.analyse(wanted, batch, version)
        known = self.known()
        scope = insights.in_scope(known, wanted).select("id")
        held = self.store.latest("pattern_occurrences")
        patterns = self.store.latest("patterns")
        if patterns is None or held is None:
            patterns, seen = self.synthesize(known.limit(0), batch)
        else:
            patterns, seen = insights.confident(patterns.drop("batch_id")), held.drop("batch_id")
        self.suggest(known, patterns, seen, batch, version, scope)
        failed = wanted.join(self.store.audit().where("analyzed_at is not null"), "session_id", "left_anti")
        return own.join(failed.select("session_id"), "session_id", "left_anti")

    def watch(self, products: Iterable[str]) -> watch.Watch:
        """The work of a watch over this analysis's transcripts; sessions of the named products are left out."""
        return watch.Watch(self.store, lambda todo: watch.own_sessions(self.messages.join(todo.select("session_id"), "session_id", "left_semi"), tuple(products)), self.watched)


def register_views(spark: SparkSession, analysis: Analysis) -> None:
    """The derived tables as SQL views."""
    for name, df in (("sessions", analysis.sessions), ("messages", analysis.messages), ("rules", analysis.rules), ("rules_files", analysis.files)):
        df.createOrReplaceTempView(name)
