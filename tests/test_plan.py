"""The whole analysis with a model that is played, the watch over its candidates, and writing edits back."""

import json
import os
import time
import types
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skeinlog.operators import edits, sessions, suggestions, tool_usage
from skeinlog.plans import analyze, prompts, registry
from skeinlog.plans import review as R
from skeinlog.sources import store as S
from skeinlog.sources import transcripts
from skeinlog.sources.rule_writer import RuleWriter
from skeinlog.streaming import watch as W


def player():
    """A model: findings for each session, one pattern over both, and one suggestion that the pattern alone supports."""

    def played(prompt):
        if "Find what recurs" in prompt:
            found = json.loads(prompt.split("\n\n")[1])
            pairs = [{"sessionId": x["session_id"], "insightId": x["id"]} for x in found]
            return json.dumps([{"title": "Tests are forgotten", "category": "repeated_correction", "confidence": 0.9, "suggestedRule": "Run the tests", "occurrences": pairs}])
        if "Suggest changes" in prompt:
            found = json.loads(prompt.split("Findings:\n")[1].split("\n\n")[0])
            cross = [x for x in found if x["source"] == "cross"]
            return json.dumps([{"type": "add", "priority": "high", "title": "Run tests", "targetFile": "RULES.md", "content": {"add": ["- Run the tests"]}, "sourceInsightIds": [x["id"] for x in cross]}])
        return json.dumps([{"title": "No tests run", "category": "repeated_correction", "confidence": 0.8, "suggestedRule": "Run the tests"}, {"title": "unsure", "category": "unclear", "confidence": 0.2}])

    return played  # a local function travels to the workers by value


def test_analysis(spark, tmp_path):
    folder = tmp_path / "t" / "-home-me-p"
    folder.mkdir(parents=True)
    for name in ("s1", "s2"):
        said = [{"type": k, "message": {"role": k, "content": f"{k} says something at some length {i}"}, "timestamp": f"2024-01-0{i + 1}T10:00:00Z"} for i, k in enumerate(["user", "assistant", "user", "assistant"])]
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, said)) + "\n")
    (tmp_path / "p").mkdir()
    calls = []

    def run(batch):
        a = analyze.Analysis(spark, str(tmp_path / "t"), str(tmp_path / "p"), S.Store(spark, str(tmp_path / "store")), player(), str(tmp_path / "home"))
        calls.append(a)
        return a.run(batch)

    r = run("b1")
    assert r.insights.count() == 2 and [x.title for x in r.patterns.collect()] == ["Tests are forgotten"]
    (one,) = r.suggestions.collect()
    # the pattern's two sessions stand behind the suggestion
    assert (one.title, one.source_session_ids, one.confidence, one["rank"]) == ("Run tests", ["s1", "s2"], 0.85, 1)
    assert calls[0].store.audit().where("analyzed_at = 'b1'").count() == 2
    again = run("b2")
    assert again.insights.count() == 2 and calls[1].store.load("insights", "s1").count() == 2  # nothing new is asked of the model
    assert [x.title for x in again.suggestions.collect()] == ["Run tests"]


def write_sessions(folder, *names):
    folder.mkdir(parents=True, exist_ok=True)
    for n, name in enumerate(names):
        said = [{"type": k, "message": {"role": k, "content": f"{k} of {name} says something at some length {i}"}, "timestamp": f"2024-01-{n + 1:02}T10:0{i}:00Z"} for i, k in enumerate(["user", "assistant", "user", "assistant"])]
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, said)) + "\n")


def counted(model, folder):
    """A model whose calls leave a file each, also from the workers."""
    folder.mkdir(exist_ok=True)
    path = str(folder)

    def call(prompt):
        with open(os.path.join(path, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        return model(prompt)

    return call


def both_player():
    def played(prompt):
        if "Find what recurs" in prompt:
            return "[]"
        name = prompt.split("user of ")[1].split(" ")[0]
        if name == "s3":
            return json.dumps([{"title": "alone", "category": "intent_clarification", "confidence": 0.9}])  # findings without changes
        sure = {"s1": "medium", "s2": "high", "s4": "low"}[name]
        return json.dumps({
            "insights": [{"title": f"first of {name}", "category": "repeated_correction", "confidence": 0.8}, {"category": "no title"}, {"title": f"third of {name}", "category": "tool_usage_pattern", "confidence": 0.9}],
            "suggestions": [
                {"type": "add", "priority": sure, "title": "Always run the tests first", "targetFile": "R.md", "content": {"add": [f"- Run them, says {name}"]}, "sourceInsightIds": [2]},
                {"type": "add", "priority": "low", "title": f"Something {name}abc {name}def {name}ghi", "targetFile": f"{name}.md", "content": {"add": [f"- {name} {name}x {name}y"]}, "sourceInsightIds": [0, 7]},
                {"title": "no need", "skipped": True},
            ],
        })

    return played


def test_combined_run(spark, tmp_path):
    """One call a session; its changes are folded into those before, and each session is told of in turn."""
    write_sessions(tmp_path / "t" / "-p", "s1", "s2", "s3", "s4")
    (tmp_path / "p").mkdir()
    a = analyze.Analysis(spark, str(tmp_path / "t"), str(tmp_path / "p"), S.Store(spark, str(tmp_path / "store")), counted(both_player(), tmp_path / "calls"), str(tmp_path / "home"))
    told = []
    r = a.run_combined("b1", on_session=lambda s, n: told.append((s, n)))
    # the second session's change is better than the first's and takes its place; the last one's is worse
    assert told == [("s1", 2), ("s2", 2), ("s3", 0), ("s4", 1)]
    got = [(x.title, x.priority) for x in r.suggestions.orderBy("rank").collect()]
    assert got == [("Always run the tests first", "high"), *[(f"Something {s}abc {s}def {s}ghi", "low") for s in ("s1", "s2", "s4")]]
    ids = {x.title: x.id for x in r.insights.collect()}
    best = r.suggestions.orderBy("rank").first()
    assert best.source_insight_ids == [ids["third of s2"]] and best.source_session_ids == ["s2"]
    assert {x.id for x in r.by_session.where("session_id = 's1'").collect()} != {x.id for x in r.suggestions.where("session_id = 's1'").collect()}
    assert r.run == {"calls": 5, "failed_calls": 0, "insights": 7, "filtered_out": 0, "sessions": 4, "patterns": 0, "suggestions": 4} and r.skipped.count() == 3
    assert len(os.listdir(tmp_path / "calls")) == 5


def test_failed_calls_are_made_again(spark, tmp_path):
    """What has been answered is never asked again; what failed is, by the next run, and is marked then."""
    write_sessions(tmp_path / "t" / "-p", "s1", "s2")
    (tmp_path / "p").mkdir()
    (tmp_path / "down").write_text("")
    flag, model = str(tmp_path / "down"), player()

    def broken(prompt):
        if "of s2 " in prompt and os.path.exists(flag):
            raise RuntimeError("no answer")
        return model(prompt)

    store = S.Store(spark, str(tmp_path / "store"))
    run = lambda b: analyze.Analysis(spark, str(tmp_path / "t"), str(tmp_path / "p"), store, counted(broken, tmp_path / "calls"), str(tmp_path / "home")).run(b)
    first = run("b1")
    assert (first.run["sessions"], first.run["failed_calls"]) == (1, 1) and store.audit().where("analyzed_at is not null").count() == 1
    os.remove(flag)
    second = run("b2")
    assert second.run["sessions"] == 1 and store.audit().where("analyzed_at is not null").count() == 2 and second.patterns.count() == 1
    n = len(os.listdir(tmp_path / "calls"))
    a = analyze.Analysis(spark, str(tmp_path / "t"), str(tmp_path / "p"), store, counted(broken, tmp_path / "calls"), str(tmp_path / "home"))
    a.analyse(a.sessions.withColumn("mtime", F.lit(1.0)), "b1", "v")  # a batch is repeated
    assert len(os.listdir(tmp_path / "calls")) == n and a.counts["calls"] == 0


def test_watched_sessions(spark, tmp_path):
    """A watch analyses what it finds and suggests from it alone; a repeated batch asks nothing; failed sessions are not dealt with."""
    write_sessions(tmp_path / "t" / "-p", "s1", "s2")
    (tmp_path / "p").mkdir()
    store = S.Store(spark, str(tmp_path / "store"))

    def model(prompt):
        if "Suggest changes" in prompt:
            found = json.loads(prompt.split("Findings:\n")[1].split("\n\n")[0])
            return json.dumps([{"type": "add", "priority": "high", "title": "Run tests", "targetFile": "R.md", "content": {"add": ["- Run"]}, "sourceInsightIds": [x["id"] for x in found]}])
        if "of s2 " in prompt:
            raise RuntimeError("no answer")
        return json.dumps([{"title": "No tests run", "category": "repeated_correction", "confidence": 0.8, "suggestedRule": "Run the tests"}])

    a = analyze.Analysis(spark, str(tmp_path / "t"), str(tmp_path / "p"), store, counted(model, tmp_path / "calls"), str(tmp_path / "home"))
    work = a.watch(["no such product"])
    found = spark.createDataFrame([("s1", 9, 1.0, 1), ("s2", 9, 1.0, 1), ("gone", 9, 1.0, 1)], W.FOUND)
    work.batch(found, 0)
    assert not work.errors and work.summary() == {"polls": 1, "found": 3, "left_out": 0, "processed": 2, "failed": 1, "errors": 0}
    (one,) = store.latest("suggestions").collect()
    assert one.source_session_ids == ["s1"] and len(os.listdir(tmp_path / "calls")) == 3
    work.process(found.where("session_id = 's1'"), 0)
    assert len(os.listdir(tmp_path / "calls")) == 3 and store.latest("suggestions").count() == 1


def test_synthesis_in_rounds(spark, tmp_path, monkeypatch):
    """Many findings go through prompts of bounded size, and every finding of a pattern can be traced through the rounds."""
    monkeypatch.setattr(analyze, "FINDINGS", 50)
    (tmp_path / "p").mkdir()
    topics = 23

    def merge(prompt):
        found, groups = json.loads(prompt.split("\n\n")[1]), {}
        assert len(found) <= 50
        for x in found:
            if x["title"] != "alone":
                groups.setdefault(x["title"], []).append({"sessionId": x["session_id"], "insightId": x["id"]})
        return json.dumps([{"title": t, "category": "repeated_correction", "confidence": 0.9, "occurrences": o} for t, o in groups.items()])

    store = S.Store(spark, str(tmp_path / "store"))
    a = analyze.Analysis(spark, str(tmp_path / "none"), str(tmp_path / "p"), store, counted(merge, tmp_path / "calls"), str(tmp_path / "home"))
    n = 1500
    k = F.col("id")
    known = spark.range(n).select(F.concat(F.lit("i"), k).alias("id"), F.concat(F.lit("s"), k % 40).alias("session_id"), F.lit("repeated_correction").alias("category"),
                                  F.when(k % 100 == 99, "alone").otherwise(F.concat(F.lit("topic"), k * 7 % topics)).alias("title"))
    patterns, seen = a.synthesize(known, "b")
    assert sorted(r.title for r in patterns.collect()) == sorted(f"topic{t}" for t in range(topics))
    title = {r.id: r.title for r in patterns.collect()}
    got = {(title[r.id], r.insight_id, r.session_id) for r in seen.collect()}
    assert got == {(f"topic{i * 7 % topics}", f"i{i}", f"s{i % 40}") for i in range(n) if i % 100 != 99} and seen.count() == len(got)
    sizes = [os.path.getsize(tmp_path / "calls" / f) for f in os.listdir(tmp_path / "calls")]
    assert max(sizes) < 50 * 200 + 5000 and len(sizes) > n / 50
    few, none = a.synthesize(known.where("session_id = 's1'"), "c")
    assert few.count() == none.count() == 0


def test_prompts_ask_for_what_is_read():
    for text in (prompts.SINGLE, prompts.CROSS, prompts.SUGGEST, prompts.COMBINED):
        assert "JSON" in text and "{{" in text
    assert "occurrences" in prompts.CROSS and "sourceInsightIds" in prompts.COMBINED


def test_missing_transcripts(spark, tmp_path):
    for root in (tmp_path / "none", tmp_path):
        p = transcripts.parsed(transcripts.lines(spark, str(root)))
        assert p.count() == transcripts.sessions(p).count() == transcripts.messages(p).count() == 0


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "nothing came"
        time.sleep(0.2)


def poll(folder, n, **sessions):
    """One poll of the listing, with the sessions' (size, mtime)."""
    rows = [json.dumps({"session_id": s, "path": "p", "size": size, "mtime": mtime, "poll": n}) for s, (size, mtime) in sessions.items()]
    (folder / f".{n}").write_text("\n".join(rows))
    (folder / f".{n}").rename(folder / f"{n}.json")


@pytest.fixture
def state(spark):
    spark.conf.set(*W.STATE_PROVIDER)
    yield
    spark.conf.unset(W.STATE_PROVIDER[0])


class Held:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return types.SimpleNamespace(exists=lambda: name in self.value, get=lambda: self.value[name], update=lambda v: self.value.__setitem__(name, v), clear=lambda: self.value.pop(name, None))

    def registerTimer(self, due):  # noqa: N802
        self.timers.add(due)

    def deleteTimer(self, due):  # noqa: N802
        self.timers.discard(due)


def test_watch_timers():
    """A change moves the timer on; what expires is sent once, with the size that rests; growth after that is a new candidate."""
    held = Held()
    g = W.Growth(100, 60_000)
    g.init(held)

    def rows(now, *listed):
        frame = pd.DataFrame([(s, m, n) for s, m, n in listed], columns=["size_bytes", "mtime", "poll"])
        clock = types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        return [tuple(r) for f in g.handleInputRows(("a",), iter([frame]), clock) for r in f.itertuples(index=False)]

    def expire(now):
        due = {t for t in held.timers if t <= now}
        held.timers -= due
        return [tuple(r) for t in sorted(due) for f in g.handleExpiredTimer(("a",), None, types.SimpleNamespace(getExpiryTimeInMs=lambda: t)) for r in f.itertuples(index=False)]

    assert rows(0, (10, 1.0, 1)) == [] and held.timers == {60_000}
    assert rows(50_000, (20, 2.0, 2)) == [] and held.timers == {110_000} and expire(70_000) == []
    assert rows(90_000, (20, 2.0, 3)) == [] and held.timers == {110_000}
    assert expire(120_000) == [("a", 20, 2.0, 2)] and expire(300_000) == [] and not held.timers
    assert rows(310_000, (90, 3.0, 4)) == [] and not held.timers  # too little
    assert rows(320_000, (500, 4.0, 5), (510, 5.0, 6)) == [] and held.timers == {380_000}
    assert expire(380_000) == [("a", 510, 5.0, 6)]
    known = pd.DataFrame([(1.0, 5000, True)], columns=["base_mtime", "base_size", "base_analyzed"])
    other = W.Growth(100, 60_000)
    other.init(fresh := Held())
    other.handleInitialState(("b",), known, None)
    assert fresh.value["seen"] == (1.0, 5000, True)


def test_watch_restart(spark, tmp_path, state):
    """A query that stops between growth and timer, and starts again, sends the candidate once, and no earlier."""
    folder = tmp_path / "in"
    folder.mkdir()
    got, cooldown = [], 12

    def start():
        rows = spark.readStream.schema(W.LISTING).json(str(folder))
        found = W.candidates(rows, cooldown_s=cooldown)
        return found.writeStream.foreachBatch(lambda df, i: got.extend((time.time(), r.session_id, r["size"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    began = time.time()
    poll(folder, 1, a=(10, 1.0))
    q = start()
    until(lambda: q.lastProgress is not None and sum(p["numInputRows"] for p in q.recentProgress))
    q.stop()
    poll(folder, 2, a=(10, 1.0))  # nothing new, as most polls are
    q = start()
    until(lambda: got)
    time.sleep(3)
    q.stop()
    assert [r[1:] for r in got] == [("a", 10)] and got[0][0] - began >= cooldown


def test_watch_baseline(spark, tmp_path, state):
    """Sessions of the baseline are no news, unless they grow and haven't been analysed; the state outlives a restart."""
    folder = tmp_path / "in"
    folder.mkdir()
    now = spark.createDataFrame([("old", "p", 1000, 1.0, 0), ("done", "p", 1000, 1.0, 0), ("late", "p", 1000, 1.0, 0)], W.LISTING)
    base = W.baseline(now, spark.createDataFrame([("done", "then")], "session_id string, analyzed_at string"))
    got = []

    def run(known):
        rows = spark.readStream.schema(W.LISTING).json(str(folder))
        q = W.candidates(rows, known=known).writeStream.foreachBatch(lambda df, i: got.extend((r.session_id, r["size"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()

    for n, sizes in enumerate([{"old": 1000, "done": 1000, "new": 10, "late": 1000}, {"old": 9000, "done": 9000, "new": 20, "late": 1001}, {"late": 9000, "done": 90000}], 1):
        poll(folder, n, **{s: (size, float(n)) for s, size in sizes.items()})
        run(base)
    assert got == [("new", 10), ("old", 9000), ("late", 9000)]


def test_watch_work(spark, tmp_path):
    """A failed batch is taken up by the next; a repeated batch does nothing twice; what is left out doesn't come back."""
    store = S.Store(spark, str(tmp_path / "store"))
    store.mark(spark.createDataFrame([("done", "then"), ("a", None)], "session_id string, analyzed_at string"))
    found = lambda *rows: spark.createDataFrame([(s, size, 1.0, n) for s, size, n in rows], W.FOUND)
    got, fail = [], [True]

    def process(df, i):
        if fail[0]:
            raise RuntimeError("no model")
        got.append((i, sorted(r.session_id for r in df.collect())))
        return df.where("session_id <> 'half'")

    work = W.Watch(store, lambda df: df.where("session_id = 'own'"), process)
    first = found(("a", 9, 1), ("b", 9, 1), ("own", 9, 1), ("done", 9, 1))
    work.batch(first, 0)
    assert work.errors[0][1].startswith("RuntimeError") and work.summary() == {"polls": 1, "found": 4, "left_out": 2, "processed": 0, "failed": 0, "errors": 1}
    fail[0] = False
    work.batch(first.limit(0), 1)
    assert got == [(1, ["a", "b"])] and work.summary()["processed"] == 2
    work.batch(first, 0)  # Spark repeats a batch
    again = W.Watch(store, work.own, process)  # a new driver
    again.batch(first.limit(0), 2)
    assert len(got) == 1 and again.summary()["left_out"] == 0
    again.batch(found(("b", 20, 3), ("half", 5, 3)), 3)
    again.batch(first.limit(0), 4)
    assert got[1:] == [(3, ["b", "half"]), (4, ["half"])] and again.summary() == {"polls": 3, "found": 2, "left_out": 0, "processed": 1, "failed": 2, "errors": 0}


def test_watch_query(spark, tmp_path, state):
    """The whole query over a real folder: the baseline is no candidate, a new file is, once it rests."""
    (tmp_path / "t" / "p").mkdir(parents=True)
    (tmp_path / "t" / "p" / "old.jsonl").write_text("x" * 200)
    store, got = S.Store(spark, str(tmp_path / "store")), []
    work = W.Watch(store, lambda df: df.limit(0), lambda df, i: got.extend(r.session_id for r in df.collect()))
    q = W.watch(spark, str(tmp_path / "t"), work, str(tmp_path / "c"), poll_s=1, cooldown_s=2)
    try:
        until(lambda: work.counts["polls"] >= 1)
        (tmp_path / "t" / "p" / "new.jsonl").write_text("y" * 300)
        until(lambda: work.counts["processed"])
    finally:
        q.stop()
    assert got == ["new"]
    assert [tuple(r) for r in store.read("watch_done").select("session_id", "size", "outcome").collect()] == [("new", 300, "processed")]


def test_store_caches(spark, tmp_path):
    s = S.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1)], "session_id string, n int")
    s.append_batch("x", rows, "b1")
    s.append_batch("x", rows, "b1")  # a rerun of the batch
    assert s.read("x").count() == 1 and s.load("x", "a").count() == 1 and s.load("none", "a") is None
    files = lambda t: spark.createDataFrame([("f", t)], "path string, mtime double")
    built = []
    make = lambda: built.append(1) or rows.withColumn("n", F.lit(len(built)))
    assert [S.cached_or_built(s, "snap", files(t), make).first().n for t in (1.0, 1.0, 2.0)] == [1, 1, 2]
    got = {r.session_id: r.fresh for r in S.fresh(spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 1.0)], "session_id string, mtime double"), spark.createDataFrame([("a", 2.0), ("b", 2.0)], "session_id string, cached_at double")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_versions(spark, tmp_path):
    """A reader sees the old version or the new one, whatever part of the new one has been written when its writer dies."""
    s = S.Store(spark, str(tmp_path / "s"))
    rows = lambda n: spark.createDataFrame([(n,)], "n int")
    assert s.version("t") is None and s.part("t", "rows") is None
    first = s.replace("t", rows=rows(1), files=rows(1))
    held = s.part("t", "rows")
    broken = rows(2).select(F.raise_error(F.lit("lost")).cast("int").alias("n"))
    for parts in ({"rows": rows(2), "files": broken}, {"rows": broken, "files": rows(2)}):
        with pytest.raises(Exception, match="lost"):
            s.replace("t", **parts)
        assert s.version("t") == first and (s.part("t", "rows").first().n, s.part("t", "files").first().n) == (1, 1)
    s.replace("t", rows=rows(3), files=rows(3))
    assert held.first().n == 1 and (s.part("t", "rows").first().n, s.part("t", "files").first().n) == (3, 3)
    assert s.vacuum("t", keep=1) == 3 and s.part("t", "rows").first().n == 3
    s.invalidate("t")
    assert s.version("t") is None


def test_audit_compaction(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"))
    mark = lambda **v: s.mark(spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)))
    mark(session_id="a", parsed_at="1")
    mark(session_id="b", parsed_at="1")
    mark(session_id="a", analyzed_at="2")
    before = sorted(s.audit().collect())
    s.compact_audit()
    assert sorted(s.audit().collect()) == before and not [n for n in os.listdir(tmp_path / "s/audit/log") if n.startswith("seq=")]
    mark(session_id="b", analyzed_at="3")
    assert {r.session_id: (r.parsed_at, r.analyzed_at) for r in s.audit().collect()} == {"a": ("1", "2"), "b": ("1", "3")}
    s.compact_audit()
    assert s.audit().count() == 2 and s.cross_done() is None
    s.mark_cross_done("4", "v")
    assert tuple(s.cross_done().first()) == ("4", "v")


def test_tolerant_load(spark, tmp_path):
    """A cut file, a foreign one and an empty one among good ones cost their own rows only."""
    s = S.Store(spark, str(tmp_path / "s"))
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "s/t"))
    names = sorted(n for n in os.listdir(tmp_path / "s/t") if n.endswith(".parquet"))
    lost = spark.read.parquet(str(tmp_path / "s/t" / names[0])).count()
    data = (tmp_path / "s/t" / names[0]).read_bytes()
    (tmp_path / "s/t" / names[0]).write_bytes(data[: len(data) // 2])
    os.remove(tmp_path / "s/t" / f".{names[0]}.crc")
    (tmp_path / "s/t/x.parquet").write_bytes(b"not a table at all")
    spark.range(0).coalesce(1).write.mode("append").parquet(str(tmp_path / "s/t"))
    rows, broken = s.read_tolerant("t", "id long")
    assert rows.count() == 40 - lost
    assert {os.path.basename(r.path): r.error for r in broken.collect()} == {names[0]: "no footer at the end", "x.parquet": "no magic number at the start"}
    rows, broken = s.read_tolerant("none", "id long")
    assert rows.count() == broken.count() == 0


def test_set_digest(spark):
    """The same for any order, partitioning and repetition; another item makes another one."""
    items = spark.range(3000).select(F.col("id").cast("string").alias("item"))
    root = lambda df: suggestions.set_digest(df).first().digest
    one = root(items)
    assert one == root(items.repartition(9)) == root(items.orderBy(F.rand(1)).unionByName(items.limit(5)))
    assert len({one, root(items.limit(2999)), root(items.limit(0)), root(items.unionByName(items.limit(1).select(F.lit("x").alias("item"))))}) == 4


def test_rule_writer(tmp_path):
    (tmp_path / "R.md").write_text("# R\n- old\n")
    (tmp_path / "S.md").write_text("# S\n")
    w = RuleWriter(str(tmp_path), str(tmp_path / "backups"))
    row = lambda ord, action, content, error=None, made=None, text=None: {"target_file": "R.md", "ord": ord, "action": action, "error": error, "content": content, "created_file": made, "created_content": text}
    paths = w.write_outcomes([row(2, "modified", "# R\n- two\n", made="S.md", text="- moved\n"), row(1, "modified", "# R\n- one\n"), row(3, "skipped", "never"), row(4, "modified", "no", error="failed")])
    assert sorted(os.path.basename(p) for p in paths) == ["R.md", "S.md"]
    assert (tmp_path / "R.md").read_text() == "# R\n- two\n" and (tmp_path / "S.md").read_text() == "# S\n\n- moved\n"
    w.write(str(tmp_path / "R.md"), "# R\n- three\n")
    copy = w.backup(str(tmp_path / "R.md"))
    assert open(copy).read() == "# R\n- old\n" and len(os.listdir(tmp_path / "backups")) == 2
    assert not [n for n in os.listdir(tmp_path) if n.startswith(".draft")]


def test_review(spark, tmp_path):
    """Decisions, edits, backups, files, history and what is left to review, in one flow."""
    root = tmp_path / "p"
    root.mkdir()
    (root / "R.md").write_text("# R\n- old\n- keep\n")
    store = S.Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([(str(root / "R.md"), "R.md", "# R\n- old\n- keep\n", 0)], "path string, relative_path string, content string, ord int")
    raw = [
        {"title": "more", "type": "add", "targetFile": "R.md", "content": {"add": ["- new"]}, "sourceInsightIds": ["1"]},
        {"title": "less", "type": "remove", "targetFile": "R.md", "content": {"remove": "- old"}, "sourceInsightIds": ["1"]},
        {"title": "made", "type": "add", "targetFile": "N.md", "content": {"add": [f"- {i}" for i in range(9)]}, "sourceInsightIds": ["1"]},
        {"title": "unsure", "type": "add", "targetFile": "R.md", "content": {"add": ["- never"]}},
    ]
    answers = spark.createDataFrame([(1, json.dumps(raw))], "batch int, raw string").select("batch", F.try_parse_json("raw").alias("value"))
    said = suggestions.with_provenance(suggestions.from_answers(answers, ["batch"]), spark.createDataFrame([("1", "s1")], "insight_id string, session_id string"))
    made = edits.with_diffs(edits.match_files(said, files), spark.createDataFrame([], "source_file string, section string")).drop("file_content").withColumn("rank", F.col("ord") + 1)
    writer = RuleWriter(str(root), str(tmp_path / "backups"))
    dry = R.review(store, writer, made, files, "r0", dry_run=True)
    assert dry.paths == [] and dry.counts["accepted"] == 4 and not (root / "N.md").exists() and store.read("reviews") is None
    shown = {r.title: r.preview for r in dry.outcomes.collect()}
    assert shown["less"] == "- - old" and shown["made"].split("\n")[-1] == "+ ... 3 more" and len(shown["made"].split("\n")) == 7
    done = R.review(store, writer, made, files, "r1", least=0.65)
    assert sorted(map(os.path.basename, done.paths)) == ["N.md", "R.md"] and done.counts == {"accepted": 3, "failed": 0, "skipped": 1, "split": 0}
    assert (root / "R.md").read_text() == "# R\n\n- keep\n\n- new\n" and (root / "N.md").read_text().startswith("- 0\n- 1\n")
    assert [(tmp_path / "backups" / n).read_text() for n in os.listdir(tmp_path / "backups")] == ["# R\n- old\n- keep\n"]
    assert {(r.title, r.status) for r in store.history().collect()} == {("more", "applied"), ("less", "applied"), ("made", "applied"), ("unsure", "skipped")}
    left = R.review(store, writer, made, files, "r2", choices=made.where("title = 'unsure'").select("id", F.lit("skip").alias("choice")))
    assert [r.title for r in left.outcomes.collect()] == ["unsure"] and left.paths == []


def test_match_files(spark):
    files = spark.createDataFrame([("/p/a/R.md", "a/R.md", "1", 0), ("/p/R.md", "R.md", "2", 1), ("/h/.claude/X.md", "/h/.claude/X.md", "3", 2)], "path string, relative_path string, content string, ord int")
    wanted = {"R.md": "/p/R.md", "a/R.md": "/p/a/R.md", "~/.claude/X.md": "/h/.claude/X.md", "X.md": "/h/.claude/X.md", "none.md": None}
    df = spark.createDataFrame([(t, t) for t in wanted], "id string, target_file string")
    assert {r.id: r.file_path for r in edits.match_files(df, files).collect()} == wanted


def test_previews(spark):
    df = spark.createDataFrame([("Bash", json.dumps({"command": "x" * 90})), ("Glob", '{"pattern": "*.py"}'), ("Task", '{"description": "d"}'), ("Read", "null"), ("Else", "{}")], "n string, i string")
    assert [r[0] for r in df.select(tool_usage.preview(F.col("n"), F.col("i"))).collect()] == ["x" * 80 + "...", "*.py", "d", "", ""]
    row = spark.range(1).select(sessions.date_range(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")).alias("a"), sessions.date_range(F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit(None).cast("timestamp")).alias("b")).first()
    assert (row.a, row.b) == ("Unknown date", "2024-01-02 03:04")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered(spark, name):
    """Every registered query runs on the smallest tables with the columns of its SQL."""
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    out = registry.queries()[name](spark, d)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns) and out.count() == len(want.fetchall())
