import itertools
import random
import re

from pyspark.sql import functions as F

from skeinlog.functions import markdown as K
from skeinlog.functions import text as X
from skeinlog.operators import dedup as D
from skeinlog.operators import edits as E
from skeinlog.operators import insights as I
from skeinlog.operators import model_calls as L
from skeinlog.operators import ranking
from skeinlog.operators import rules as R
from skeinlog.operators import similarity as S
from skeinlog.operators import suggestions as G
from skeinlog.sources import rule_files, scratch
from skeinlog.sources.store import Store, cache_is_valid

DOC = """# Top

Intro line
goes on

## Style
- NEVER do this
  - nested
- `make` builds @docs/a.md
* avoid that
---
```
- not a rule
# no heading
```
## Style two

text <!-- x -->
<!-- comment -->
1. numbered
"""


def parse(spark, text):
    return R.parse(spark.createDataFrame([("f.md", "project", text)], "path string, scope string, content string")).orderBy("line_start").collect()


def test_parse(spark):
    rows = parse(spark, DOC)
    got = [(r.line_start, r.line_end, r.section, r.format, r.emphasis) for r in rows]
    assert got == [
        (3, 4, "Top", "paragraph", "normal"),
        (7, 8, "Style", "emphatic", "important"),
        (9, 9, "Style", "command", "normal"),
        (10, 10, "Style", "bullet_point", "negative"),
        (18, 20, "Style two", "paragraph", "normal"),
    ]
    assert rows[1].text == "NEVER do this\n- nested" and rows[1].section_hierarchy == ["Top", "Style"]
    assert rows[2].imports == ["docs/a.md"] and len(rows[0].id) == 16 and len({r.id for r in rows}) == 5


def test_emphasis(spark):
    words = {"must": "normal", "MUST": "important", "don't": "important", "do not": "important", "avoid": "negative", "required": "important"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", R.emphasis_of(F.col("w")).alias("e"))
    assert {r.w: r.e for r in df.collect()} == words


def test_imports_and_stats(spark):
    files = spark.createDataFrame([("/p/a/f.md", "project", "see @x.md @../y.md `@z.md`\n```\n@q.md\n```")], "path string, scope string, content string")
    got = [(r.path, r.resolved_path, r.line_number) for r in R.file_imports(files).collect()]
    assert got == [("x.md", "/p/a/x.md", 1), ("../y.md", "/p/y.md", 1)]
    s = R.stats(files, R.parse(files), R.file_imports(files)).first()
    assert (s.total_files, s.total_lines, s.total_imports, s.has_project, s.has_global) == (1, 4, 2, True, False)
    assert s.by_format["heading_section"] == 0 and s.by_scope["project"] == s.total_rules == 1


def test_discovery(spark, tmp_path):
    home = tmp_path / "home"
    root = tmp_path / "p"
    read = ("target", "coverage", "out", "x/a")  # folders that rules are read from
    for p in (*(f"{d}/CLAUDE.md" for d in read), "dist/CLAUDE.md", ".svn/CLAUDE.md", "CLAUDE.md", "CLAUDE.local.md", ".claude/rules/b.md", ".claude/rules/a.md", "x/CLAUDE.md", "x/y/z/CLAUDE.md", "x/y/z/w/CLAUDE.md", "node_modules/CLAUDE.md", ".hid/CLAUDE.md"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("- rule\r\n")
    rows = rule_files.read(spark, str(root), str(home)).orderBy("ord").collect()
    assert [r.relative_path for r in rows] == ["CLAUDE.md", "CLAUDE.local.md", ".claude/rules/a.md", ".claude/rules/b.md", "coverage/CLAUDE.md", "out/CLAUDE.md", "target/CLAUDE.md", "x/CLAUDE.md", "x/a/CLAUDE.md", "x/y/z/CLAUDE.md"]
    assert rows[0].content == "- rule\n" and rows[4].scope == "subdirectory"
    assert rule_files.project_root(str(root / "x" / "y"), str(home)) == str(root / "x")


def test_project_root(tmp_path):
    """Never home, though it has a marker; nothing where no folder below it has one."""
    home = tmp_path / "home"
    for p in ("CLAUDE.md", ".claude/x", "plain/deep/x", "repo/.git/x", "repo/src/lib/x", "node/package.json", "node/.claude/x", "kept/.skeinlog/x"):
        (home / p).parent.mkdir(parents=True, exist_ok=True)
        (home / p).write_text("")
    root = lambda p: rule_files.project_root(str(home / p), str(home))
    assert root("") is None and root("plain/deep") is None
    assert root("repo/src/lib") == root("repo") == str(home / "repo") and root("node/.claude") == str(home / "node") and root("kept") == str(home / "kept")


def test_fixed_values():
    assert len(I.CATEGORIES) == 7 and {"convention_establishment", "tool_command_correction"} < set(I.CATEGORIES)
    assert I.ACTION_HINTS == ["add_to_rules", "update_rules", "add_to_global_rules", "prompt_improvement", "unclear"]


def test_sections():
    text = "# A\na\n\n## B\nb\n\n## C\nc\n# D\nd\n"
    assert K.insert(text, "- n", "b") == "# A\na\n\n## B\nb\n\n- n\n\n## C\nc\n# D\nd\n"
    assert K.insert("x\n", "- n", "New") == "x\n\n## New\n\n- n\n"
    assert K.insertion_line(text, "A") == 8 and K.insertion_line(text, None) == 11
    left, moved = K.cut_section("# A\n## B\nb\n### C\nc\n## D\n", "B")
    assert left == "# A\n## D\n" and moved == "# B\nb\n## C\nc\n"


def test_replace():
    assert K.replace("a b a", "a", "c$&") == "c$& b a"
    assert K.replace("x\n -  Foo  bar\ny", "- foo bar", "z") == "x\nz\ny"
    assert K.replace("x", "y", "z") is None
    assert K.locate("- one\n- two\nthree", "two\nthree") == [(2, "- two"), (3, "three")]
    assert K.mostly_present("a\nb\nc\nd\ne", "A\nB\nC\nD\nE") and not K.mostly_present("a", "a\nb\nc\nd\ne")


def test_apply(spark):
    cols = "target_file string, ord long, id string, type string, decision string, target_section string, added string, removed string, part_removes array<string>, split_target string, file_content string"
    base = "# R\n## S\n- a\n- b\n"
    rows = [
        ("f", 1, "1", "add", "accept", "S", "- c", None, None, None, base),
        ("f", 2, "2", "add", "accept", "S", "- c", None, None, None, base),
        ("f", 3, "3", "update", "accept", None, "- A", "- a", None, None, base),
        ("f", 4, "4", "remove", "accept", None, None, "- missing", None, None, base),
        ("f", 5, "5", "remove", "skip", None, None, "- b", None, None, base),
        ("f", 6, "6", "consolidate", "accept", "S", "- bc", None, ["- b", "- c"], None, base),
        ("g", 1, "7", "add", "accept", None, "- n", None, None, None, None),
        ("h", 1, "8", "split", "accept", "S", None, None, None, "s.md", base),
    ]
    got = {r.id: r for r in E.apply_all(spark.createDataFrame(rows, cols)).collect()}
    assert got["1"].content == got["2"].content == "# R\n## S\n- a\n- b\n\n- c\n"
    assert "- A" in got["3"].content and got["4"].error and got["5"].action == "skipped"
    assert got["6"].content.count("- bc") == 1 and "- c\n" not in got["6"].content
    assert (got["7"].content, got["7"].action) == ("- n\n", "created")
    assert (got["8"].content, got["8"].created_content) == ("# R", "# S\n- a\n- b\n")
    c = E.review_counts(E.apply_all(spark.createDataFrame(rows, cols))).first()
    assert (c.accepted, c.failed, c.skipped, c.split) == (6, 1, 1, 1)


def test_diffs():
    text = "# A\n- x\n\n# B\n- y\n"
    d = E.build_diff("update", "- z", [], "A", text)
    assert (d["type"], d["after_line"], [x["content"] for x in d["removed_lines"]]) == ("replace", 1, ["# A", "- x"])
    assert E.build_diff("add", "- z", [], "A", text)["after_line"] == 2
    assert E.build_diff("add", None, [], "A", text) is None and E.build_diff("add", "q", [], None, None)["after_line"] is None
    d = E.build_diff("consolidate", "- n", ["- x", "- y"], None, text)
    assert [p["type"] for p in d["parts"]] == ["remove", "remove", "add"]
    d = E.build_diff("split", "new.md", [], "B", text, 3)
    assert d["parts"][1]["added_lines"][1]["content"] == "(3 rules moved)"
    assert E.build_diff("remove", None, ["- x"], None, text)["removed_lines"] == [{"line_number": 2, "content": "- x"}]


# --- dedup against a plain model ---


def words(t):
    return {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", "", t.lower())) if len(w) > 2}


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def model(items):
    kept = []
    order = {"high": 0, "medium": 1, "low": 2}
    for x in items:
        for i, k in enumerate(kept):
            t = jac(words(k[1]), words(x[1]))
            if (k[4] == x[4] and t > 0.6) or set(k[5]) & set(x[5]) or t > 0.8 or jac(words(k[6]), words(x[6])) > 0.6:
                if (order[x[2]], -x[3]) < (order[k[2]], -k[3]):
                    kept[i] = x
                break
        else:
            kept.append(x)
    return [k[0] for k in kept]


def test_dedup_model(spark):
    rnd = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "omega"]
    groups = {}
    for g in range(12):
        groups[f"g{g}"] = [
            (f"{g}-{i}", " ".join(rnd.choices(vocab, k=rnd.randint(0, 4))), rnd.choice(["high", "medium", "low"]), rnd.choice([0.5, 0.7, 0.9]), rnd.choice(["a", "b"]), rnd.choice([[], ["i1"], [f"u{i}"]]), " ".join(rnd.choices(vocab, k=rnd.randint(0, 4))))
            for i in range(12)
        ]
    rows = [(g, i, *x[:5], None, x[5], x[6]) for g, xs in groups.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, ord long, id string, title string, priority string, confidence double, target_file string, target_section string, source_insight_ids array<string>, added_text string")
    got = {}
    for r in D.dedup(df, ["g"]).orderBy("g", "place").collect():
        got.setdefault(r.g, []).append(r.id)
    assert got == {g: model(xs) for g, xs in groups.items()}
    ranked = D.dedup_and_rank(df, ["g"]).where("g = 'g0'").orderBy("rank").collect()
    keys = [({"high": 0, "medium": 1, "low": 2}[r.priority], -r.confidence) for r in ranked]
    assert keys == sorted(keys)
    out, fresh = D.incremental(D.dedup_and_rank(df.where("ord < 6"), ["g"]), df.where("ord >= 6"), ["g"])
    assert fresh.count() <= out.count() and fresh.join(df.where("ord < 6"), "id").count() == 0


# --- model answers, suggestions, store ---


def test_answers(spark):
    good = '[{"category": "rejected_approach", "title": "T", "confidence": 0.8, "evidence": [1, {"role": "user", "text": "x"}, {}, {}, {}]}, {"title": 3, "category": "x"}, {"category": "odd", "title": "U", "confidence": 7}]'
    shapes = [good, f"```json\n{good}\n```", f"Sure: {good}", '{"result": ' + __import__("json").dumps(good) + "}"]
    prompts = spark.createDataFrame([(str(i), "p" * 8) for i in range(len(shapes) + 1)], "session_id string, prompt string")
    answers = {str(i): s for i, s in enumerate(shapes)}
    recorded = spark.createDataFrame([("0", "q")], "a string, b string")
    assert recorded.count() == 1
    keyed = prompts.join(spark.createDataFrame(list(answers.items()), "session_id string, raw string"), "session_id", "left").withColumn("error", F.lit(None).cast("string"))
    out = I.from_answers(L.parse(keyed).select("session_id", "value"), ["session_id"]).collect()
    assert len(out) == 8
    t = next(r for r in out if r.title == "T")
    assert (t.category, t.confidence, len(t.evidence), t.evidence[0].role, t.action_hint) == ("rejected_approach", 0.8, 3, "user", "unclear")
    u = next(r for r in out if r.title == "U")
    assert (u.category, u.confidence) == ("missing_project_knowledge", 0.5)


def test_call_errors_are_rows(spark):
    def backend(prompt):
        if prompt == "bad":
            raise RuntimeError("no")
        return "[]"

    got = {r.k: r for r in L.call(spark.createDataFrame([("a", "ok"), ("b", "bad")], "k string, prompt string"), backend).select("k", "error", "tokens_used").collect()}
    assert got["a"].error is None and "RuntimeError" in got["b"].error and got["a"].tokens_used == 2


def test_suggestions(spark):
    raw = '[{"title": "A", "type": "split", "content": {"add": ["n.md"]}, "sourceInsightIds": ["1", "2"]}, {"title": "B", "content": {"add": "x", "remove": ["y", "z"]}, "sourceInsightIds": ["1", "2", "nope"]}, {"title": "C", "skipped": true}, {"title": "D"}, {"type": "add"}]'
    df = spark.createDataFrame([(1, raw)], "batch int, raw string").select("batch", F.try_parse_json("raw").alias("value"))
    s = G.from_answers(df, ["batch"])
    links = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("2", "s1")], "insight_id string, session_id string")
    got = {r.title: r for r in G.with_provenance(s, links).collect()}
    assert len(got) == 4 and got["A"].split_target == "n.md" and got["A"].confidence == 0.85
    assert got["B"].source_session_ids == ["s1", "s2"] and got["B"].confidence == 0.85 and got["B"].remove_texts == ["y", "z"]
    assert got["C"].skip_reason == "already covered" and got["D"].confidence == 0.6 and got["D"].target_file == "CLAUDE.md"
    stats = G.stats(s.where("not skipped"), 10).first()
    assert stats.by_type["add"] == 2 and stats.by_type["remove"] == 0 and stats.estimated_rules_after == 12


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.latest("x") is None and store.audit().count() == 0
    store.mark(spark.createDataFrame([("s", "t0")], "session_id string, parsed_at string"))
    store.mark(spark.createDataFrame([("s", "t1", 3)], "session_id string, analyzed_at string, insight_count int"))
    r = store.audit().first()
    assert (r.parsed_at, r.analyzed_at, r.insight_count) == ("t0", "t1", 3)
    for b, v in (("1", 1), ("2", 2)):
        store.append_batch("sets", spark.createDataFrame([(v, "k")], "v int, cache_key string"), b)
    assert store.latest("sets").first().v == 2 and store.by_cache_key("sets", "k").first().v == 2 and store.by_cache_key("sets", "q") is None
    store.save_sessions("i", spark.createDataFrame([("a", 1), ("b", 1)], "session_id string, v int"))
    store.save_sessions("i", spark.createDataFrame([("a", 2)], "session_id string, v int"))
    assert {(r.session_id, r.v) for r in store.read("i").collect()} == {("a", 2), ("b", 1)}
    store.append_history(spark.createDataFrame([("x",)], "action string"))
    store.append_history(spark.createDataFrame([("y",)], "action string"))
    assert store.history().count() == 2
    now = spark.createDataFrame([("p", 1.0)], "path string, mtime double")
    assert cache_is_valid(now, now).first().valid
    assert not cache_is_valid(spark.createDataFrame([("p", 2.0)], "path string, mtime double"), now).first().valid
    assert not cache_is_valid(spark.createDataFrame([("q", 1.0)], "path string, mtime double"), now).first().valid


def test_text_functions(spark):
    df = spark.createDataFrame([("x" * 600,), ("y" * 500,), ("﻿ a ",)], "t string")
    got = [len(r[0]) for r in df.select(X.truncate(F.col("t"), 500)).collect()]
    assert got[:2] == [503, 500]
    assert df.select(X.trim(F.col("t"))).collect()[2][0] == "a"
    one = spark.createDataFrame([("\U0001f600",)], "t string").select(X.utf16_length(F.col("t"))).first()[0]
    assert one == 2
    assert list(itertools.chain(*spark.range(1).select(X.template(F.lit("{{a}}{{b}}"), {"a": F.lit("{{b}}"), "b": F.lit("$&")})).collect()))[0] == "$&$&"


def test_dedup_in_components(spark):
    """The fold is dealt over tasks by component, and comes out as over one stream."""
    rnd = random.Random(11)
    words = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(400):
        t = rnd.randint(0, 60)
        title = " ".join(words[t % 30 : t % 30 + 4]) + (f" tail{t}" if t > 30 else "")
        rows.append((i, str(i), title, rnd.choice(["high", "medium", "low"]), rnd.random(), rnd.choice(["a", "b"]), rnd.choice([None, "s"]), [f"i{rnd.randint(0, 300)}"] if rnd.random() < 0.1 else [], " ".join(f"c{rnd.randint(0, 3000)}x" for _ in range(rnd.randint(0, 3)))))
    df = spark.createDataFrame(rows, "ord long, id string, title string, priority string, confidence double, target_file string, target_section string, source_insight_ids array<string>, added_text string")
    worded = D.with_words(df)
    found = S.components_of(worded, "id")
    assert 5 < found.select("component").distinct().count() < 400
    kept = D.Kept()
    for x in worded.orderBy("ord").collect():
        kept.add(x.asDict() | {"row": x.id, "at": (x.ord, x.id)})
    got = D.dedup(df).orderBy("place").collect()
    assert [(r.place, r.id) for r in got] == [(i, x["row"]) for i, x in enumerate(kept.items)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 7).alias("b")).repartition(5)
    got = ranking.numbered(df, [F.col("b").desc(), F.col("a").asc()]).collect()
    assert [r.rank for r in sorted(got, key=lambda r: (-r.b, r.a))] == list(range(1, 1001))
    assert ranking.numbered(df.where("false"), [F.col("a")]).count() == 0
    plan = I.batches(spark.range(50).select("id", (F.col("id") / 50).alias("confidence")))._jdf.queryExecution().toString()
    assert "Window" not in plan


def _brute_pairs(sets, least):
    return {(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) > least}


def test_set_pairs_by_size(spark, monkeypatch):
    """Sets of one small size that have to be equal never meet, however many share a word; across bands of sizes no pair is lost."""
    prefixes = []

    def kept(df, name):
        out = scratch.written(df, name)
        prefixes.extend([out] if name == "prefixes" else [])
        return out

    monkeypatch.setattr(S, "written", kept)
    frame = lambda sets: spark.createDataFrame([(k, sorted(w)) for k, w in sets.items()], "cls string, w array<string>")
    four = {f"{i:04d}": {"common", f"x{i % 20}x", f"y{i % 15}y", f"z{i}z"} for i in range(300)}
    assert S.set_pairs(frame(four), 0.6).count() == 0
    p = prefixes[0]
    sizes = (F.col("a.band") == F.col("b.other")) & (F.col("a.other") == F.col("b.band")) if "band" in p.columns else F.lit(True)
    assert p.alias("a").join(p.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.cls") < F.col("b.cls")) & sizes).count() == 0
    rnd = random.Random(4)
    near = {}
    for i in range(160):
        w = {f"w{j}" for j in rnd.sample(range(28), rnd.randint(1, 26))} if i % 3 == 0 else near[f"{i - 1:04d}"] ^ {f"w{rnd.randrange(28)}"}
        near[f"{i:04d}"] = w if w and w not in near.values() else {f"own{i}"}
    for least in (0.6, 0.8):
        assert {(r.a, r.b) for r in S.set_pairs(frame(near), least).collect()} == _brute_pairs(near, least) != set()


def test_alike_links_classes(spark):
    """Items with the same classes and ids link them once, so the graph does not grow with copies."""
    items = D.with_words(spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("one title").alias("title"), F.lit("high").alias("priority"), F.lit("a").alias("target_file"), F.lit(None).cast("string").alias("target_section"), F.array(F.lit("i")).alias("source_insight_ids"), F.lit("some content").alias("added_text")))
    graph = S.components_of(items, "id")
    assert graph.select("component").distinct().count() == 1 and graph.count() == 500
    assert S.alike(items)[2].count() == 2


def test_dedup_of_a_large_component(spark, monkeypatch):
    """A large component is folded from the few rows that change what is kept, and comes out as over one stream."""
    rnd = random.Random(12)
    words = [f"word{i}" for i in range(9)]
    rows = []
    for i in range(3000):
        title, content = (" ".join(rnd.choices(words, k=rnd.randint(0, n))) for n in (3, 4))
        rows.append((i // 50, i, str(i), title, rnd.choice(["high", "medium", "low"]), rnd.choice([None, 0.5, rnd.random()]), rnd.choice("ab"), rnd.choice([None, "s"]), rnd.choice([[], [], [], None, [f"i{rnd.randint(0, 90)}", None]]), content))
    df = spark.createDataFrame(rows, "step int, ord long, id string, title string, priority string, confidence double, target_file string, target_section string, source_insight_ids array<string>, added_text string")
    kept = D.Kept()
    for x in D.with_words(df).orderBy("ord").collect():
        kept.add(x.asDict() | {"row": x.id, "at": (x.ord, x.id)})
    steps = [sorted(map(str, t.collect())) for t in D.by_step(df, "step")]
    tables = {}

    def written(rows, name):
        tables[name] = scratch.written(rows, name)
        return tables[name]

    monkeypatch.setattr(D, "LARGE", 300)
    monkeypatch.setattr(D, "written", written)
    got = D.dedup(df.drop("step")).orderBy("place").collect()
    assert [(r.place, r.id) for r in got] == [(i, x["row"]) for i, x in enumerate(kept.items)]
    assert tables["own"].count() > 2500 and tables["own"].select("__part").distinct().count() > 1 and tables["known"].count() < 1500
    assert [sorted(map(str, t.collect())) for t in D.by_step(df, "step")] == steps
