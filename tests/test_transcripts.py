import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlog.operators import messages as M
from skeinlog.operators import sessions as S
from skeinlog.operators import tool_usage as U
from skeinlog.sources import transcripts as T
from skeinlog.streaming import watch as W


def use(i, name, **args):
    return {"type": "tool_use", "id": i, "name": name, "input": args}


def result(i, content):
    return {"type": "tool_result", "tool_use_id": i, "content": content}


def line(kind, content=None, role=None, ts=None, **more):
    out = {"type": kind, **more}
    if content is not None:
        out["message"] = {"role": role or kind, "content": content}
    if ts:
        out["timestamp"] = ts
    return json.dumps(out)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("t")
    p = base / "-home-me-proj"
    p.mkdir()
    lines = [
        line("user", "hello", ts="2024-01-01T10:00:00Z"),
        line("assistant", [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "one"}, {"type": "text", "text": "two"}, use("a", "Bash", command="ls"), use("b", "Bash", command="x"), result("a", "exit code 1")], ts="2024-01-01T10:10:00Z"),
        "not json", "", '{"type": 42}', "[1]",
        line("progress", [use(f"r{i}", "Read", file_path="/f") for i in range(5)]),
        line("user", [result("b", {"k": "v" * 600})], ts="2024-01-01T10:47:00Z"),
        line("summary", summary="first"), line("summary", summary="last"),
    ]
    (p / "s1.jsonl").write_text("\n".join(lines) + "\n")
    (p / "s2.jsonl").write_text("\r\n".join([line("user", "x" * 120), line("assistant", "y")]))
    (p / "tiny.jsonl").write_text("{}")
    return str(base)


@pytest.fixture(scope="module")
def parsed(spark, root):
    return T.parsed(T.lines(spark, root)).cache()


def test_lines_and_warnings(parsed):
    assert {r.session_id for r in parsed.select("session_id").distinct().collect()} == {"s1", "s2"}
    assert sorted(r.line_no for r in T.warnings(parsed).collect()) == [3, 5, 6]


def test_messages(parsed):
    rows = {(r.session_id, r.msg_idx): r for r in T.messages(parsed).collect()}
    assert len(rows) == 6
    two = rows["s1", 2]
    assert (two.role, two.text_content, two.has_thinking, two.tool_names) == ("assistant", "one\ntwo", True, ["Bash", "Bash"])
    assert json.loads(two.tool_uses[0].input) == {"command": "ls"}
    long = rows["s1", 8].tool_results[0].content
    assert len(long) == 503 and long.startswith('{"k":"vvv') and long.endswith("...")
    assert rows["s1", 7].role == "unknown"


def test_sessions(parsed):
    s = {r.session_id: r for r in T.sessions(parsed).collect()}["s1"]
    assert (s.message_count, s.user_message_count, s.assistant_message_count, s.tool_use_count) == (10, 2, 1, 7)
    assert (s.duration_minutes, s.summary, s.project_path) == (47, "last", "/home/me/proj")
    assert s.created_at.isoformat().startswith("2024-01-01T10:00:00")


def test_tool_usage(parsed):
    s = {r.session_id: r for r in U.summary(T.messages(parsed)).collect()}["s1"]
    assert s.total_tool_calls == 7
    assert s.by_tool["Bash"].asDict() == {"count": 2, "failures": 1} and s.by_tool["Read"]["count"] == 5
    assert s.bash_failure_rate == 0.5
    assert [(x.file_path, x.read_count) for x in s.repeated_file_access] == [("/f", 5)]
    text = U.render(U.summary(T.messages(parsed))).where("session_id = 's1'").first().rendered
    assert text == "Total tool calls: 7\n  Read: 5\n  Bash: 2 (1 failures)\nBash failure rate: 50%\n\nFrequently accessed files:\n  /f: 5 reads, 0 writes"


def test_result_in_next_message_does_not_count(spark):
    rows = [("s", 1, [("a", "Bash", "{}")], []), ("s", 2, [], [("a", "Error")])]
    m = spark.createDataFrame(rows, "session_id string, msg_idx int, tool_uses array<struct<id:string,name:string,input:string>>, tool_results array<struct<tool_use_id:string,content:string>>")
    assert U.shell_failure_rate(U.calls(m)).first().bash_failure_rate == 0.0
    assert U.shell_failure_rate(U.calls(m, "session")).first().bash_failure_rate == 1.0


def conversation(spark, n):
    rows = [("s", i, "user" if i % 2 == 0 else "assistant", "user", f"m{i}", []) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, msg_idx int, role string, raw_type string, text_content string, tool_names array<string>")


def test_sampling(spark):
    short = M.sample(M.prepare(conversation(spark, 120)))
    assert short.count() == 120 and not short.where("was_sampled").count()
    long = M.sample(M.prepare(conversation(spark, 200))).orderBy("sort").collect()
    marks = [r for r in long if r.original_index == -1]
    assert len(marks) == 2 and marks[0].text == marks[1].text == "[...skipped 140 messages from 70 exchanges...]"
    own = [r.original_index for r in long if r.original_index >= 0]
    assert own == sorted(own) and own[0] == 0 and own[-1] == 199 and len(own) == 60


def test_flag_without_loss(spark):
    rows = [("s", i, "user" if i == 0 else "assistant", "x", f"m{i}", []) for i in range(151)]
    df = spark.createDataFrame(rows, "session_id string, msg_idx int, role string, raw_type string, text_content string, tool_names array<string>")
    out = M.sample(M.prepare(df))
    assert out.count() == 151 and out.where("was_sampled").count() == 151


def test_needs_analysis(spark):
    s = spark.createDataFrame([("new", 1.0), ("same", 1.0), ("touched", 2.0), ("prompt", 1.0), ("never", 1.0)], "session_id string, mtime double")
    a = spark.createDataFrame([("same", "t", "v", 1.0), ("touched", "t", "v", 1.0), ("prompt", "t", "u", 1.0), ("never", None, "v", 1.0)], "session_id string, analyzed_at string, analysis_prompt_version string, session_mtime double")
    got = {r.session_id for r in S.change_status(s, a, "v").where("needs_analysis").collect()}
    assert got == {"new", "touched", "prompt", "never"}


def test_watch_step():
    seen, hit = W.step(None, 5000, 1)
    assert hit
    assert not W.step(seen, 9000, 2)[1]
    again, hit = W.step(seen, 20000, 3)
    assert hit and again.size == 20000
    assert not W.step(W.Seen(1, 0, True), 90000, 2)[1]


def test_watch_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    got = []
    spark.conf.set(*W.STATE_PROVIDER)
    rows = spark.readStream.schema(W.LISTING).json(str(folder))
    q = W.candidates(rows).writeStream.foreachBatch(lambda df, i: got.extend((r.session_id, r["size"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    for poll, size in enumerate([5000, 9000, 20000], 1):
        (folder / f"{poll}.json").write_text(json.dumps({"session_id": "a", "path": "p", "size": size, "mtime": poll, "poll": poll}))
        q.processAllAvailable()
    q.stop()
    assert got == [("a", 5000), ("a", 20000)]


def test_listing_source(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.jsonl").write_text("x" * 10)
    q = W.listing(spark, str(tmp_path)).writeStream.format("memory").queryName("listed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    q.awaitTermination(8)
    q.stop()
    assert spark.table("listed").where(F.col("session_id") == "a").count() >= 1


def test_lines_of_split_files(spark, tmp_path):
    """Files read in many splits have the same line numbers, look-ahead and warnings as in one."""
    rnd = random.Random(4)
    want = {}
    for f in range(3):
        folder = tmp_path / "root" / f"-p-{f}"
        folder.mkdir(parents=True)
        own = ["" if rnd.random() < 0.1 else "x" * rnd.choice([1, 30, 400, 9000]) for _ in range(rnd.randint(50, 400))]
        own[3] = json.dumps({"type": "user", "timestamp": "2024-01-01T10:00:00Z", "message": {"role": "user", "content": "é" * 3000}})
        (folder / "s.jsonl").write_bytes(rnd.choice(["\n", "\r\n"]).join(own).encode() + b"\n" * (f > 0))
        want[f"-p-{f}"] = list(enumerate(own, 1))
    sizes = {}
    for size in ("4096", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "4096")
        try:
            found = T.lines(spark, str(tmp_path / "root"))
            rows = found.withColumn("p", F.spark_partition_id()).collect()
            sizes[size] = len({r.p for r in rows})
            got = {}
            for r in rows:
                got.setdefault(r.project_path_encoded, []).append((r.line_no, r.line))
            assert {k: sorted(v) for k, v in got.items()} == want
            parsed = T.parsed(found)
            assert T.warnings(parsed).count() == sum(line != "" and n != 4 for own in want.values() for n, line in own)
            assert {r.created_at.isoformat() for r in T.first_timestamps(parsed.withColumn("session_id", F.col("project_path_encoded"))).collect()} == {"2024-01-01T10:00:00"}
        finally:
            for name in ("maxPartitionBytes", "openCostInBytes"):
                spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("size", [1, 3, 100])
def test_places_over_batches(size):
    rows = [("a", 0)] * 7 + [("a", 50)] * 5 + [("b", 0)] * 4 + [("a", 0)] + [("c", 9)] * 6
    cut = [pa.RecordBatch.from_pylist([{"file_path": p, "start": s} for p, s in rows[i : i + size]]) for i in range(0, len(rows), size)]
    got = [x for b in T._numbered(iter(cut)) for x in b.column("place").to_pylist()]
    assert got == [*range(1, 8), *range(1, 6), *range(1, 5), 1, *range(1, 7)]
