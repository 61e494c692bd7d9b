"""Exact dedup, n-gram join, top-k search, sharding and the pipeline: against brute force."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skeinlog.llm import _graph, exact_dedup, mixing, ngram_join, queries, sharding, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, kept boolean, n long, sid long, shard_file string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 1, False, 2, 3, "f") for i, t in rows], SCHEMA)


# --- exact dedup ---


@pytest.mark.parametrize("limit", [0, 2, 200_000])
def test_exact(spark, limit):
    rnd = random.Random(1)
    long = "y" * 300
    rows = [(i, rnd.choice(["a", "b", "ab", "", None, long + "1", long + "2", "c" * i])) for i in range(200)]
    rows += [(None, "a"), (None, "only null id"), (3, rows[3][1]), (500, "z" * 2_000_000), (501, "z" * 2_000_000)]
    got = exact_dedup.exact_dedup(docs(spark, rows), broadcast_keys=limit).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    kept = exact_dedup.drop_duplicates(docs(spark, rows), broadcast_keys=limit)
    assert kept.columns == docs(spark, []).columns
    expect = collections.Counter((i, t or "") for i, t in rows if i == max((x for x in groups[t or ""] if x is not None), default=None))
    assert collections.Counter((r.doc_id, r.text or "") for r in kept.collect()) == expect


def test_exact_prunes(spark, monkeypatch):
    """Beyond the broadcast bound too, only rows whose length and prefix repeat are hashed whole."""
    seen = []
    monkeypatch.setattr(exact_dedup, "write_table", lambda df, name: seen.append((name, df.count(), df._jdf.queryExecution().toString())) or df.cache())
    rows = [(i, "x" * i) for i in range(50)] + [(100 + i, f"{i:03d} same length") for i in range(20)] + [(200, "twice"), (201, "twice")]
    for limit in (0, 1000):
        seen.clear()
        groups, prefixes = exact_dedup.find_groups(docs(spark, rows), broadcast_keys=limit)
        assert [(n, c) for n, c, _ in seen] == [("dedup-lengths", 2), ("dedup-prefixes", 1), ("dedup-groups", 1)]
        assert ("BroadcastHashJoin" in seen[2][2].split("== Physical Plan ==")[1]) == (limit > 0) and "LeftSemi" in seen[2][2]


def test_own_names(spark):
    """Columns of the names that the operators use inside come back as they were."""
    names = ["__len", "__prefix", "__row", "__id", "__text", "__full", "__keep", "__own", "__arrival", "__arrival_no", "__lang", "__score", "__row_key", "__stay", "__words"]
    base = docs(spark, [(1, "one two three"), (2, "one two three"), (3, "another text here"), (4, "so much more text here")])
    df = base.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    want = {r.doc_id: r for r in df.collect()}
    kept = exact_dedup.drop_duplicates(df).collect()
    assert {r.doc_id for r in kept} == {2, 3, 4} and all(r == want[r.doc_id] for r in kept)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "").collect()
        assert out and all(r.asDict() == want[r.doc_id].asDict() for r in out), name


def test_exact_empty(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(docs(spark, [])).count() == 0


# --- components ---


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (300, 200), (200, 250), (7, 7)] + [(1000, x) for x in range(1001, 1100)]
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200} | {x: 1000 for x in range(1000, 1100)}
    assert got == want


# --- n-gram join ---


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("salt_rows", [50_000, 3])
def test_ngram_join(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt_rows)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 300)}"
    rows, base = [], [[word() for _ in range(rnd.randint(3, 60))] for _ in range(12)]
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = word()
        if rnd.random() < 0.2:
            w = w[: rnd.randint(1, len(w))]
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else "  ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[3][1]), (None, rows[4][1]), (904, "one two"), (905, "One  Two"), (5, rows[5][1]), (906, "t " * 20_000)]
    got = ngram_join.near_duplicate_components(docs(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(brute(rows))


def test_ngram_join_draws_names_anew(spark, monkeypatch):
    """Where two different sets come to the same name, no result depends on it."""
    real = ngram_join.set_key
    monkeypatch.setattr(ngram_join, "set_key", lambda s, seed=0: (real(s, seed)[0] & 1, real(s, seed)[1]) if seed == 0 else real(s, seed))
    join = ngram_join._Join(docs(spark, [(i, f"word{i}") for i in range(20)]), "doc_id", "text", 5, 75)
    assert join.seed == 1 and join.nodes.count() == 20


def test_ngram_join_without_links(spark):
    assert ngram_join.near_duplicate_components(docs(spark, [])).count() == 0
    got = ngram_join.near_duplicate_components(docs(spark, [(1, "a b c"), (2, "x y z"), (3, None)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 3)}


def test_filters():
    rnd = np.random.default_rng(2)
    for size in (50, 3000):
        for _ in range(100):
            pool = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            a, b = (np.sort(rnd.choice(pool, rnd.integers(1, len(pool)), replace=False)) for _ in range(2))
            shared = len(np.intersect1d(a, b))
            assert ngram_join.suffix_bound(ngram_join.signature(a), ngram_join.signature(b)) >= shared
            assert ngram_join.similar(a, b) == (100 * shared >= 75 * (len(a) + len(b) - shared))


# --- top-k ---


def search(rows, k=10):
    v = []
    for i, x in rows:
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.append((i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]))
    out = []
    for q in sorted({i for i, _ in v if i is not None and i % 100 == 0}):
        own = min(x for i, x in v if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, x, strict=False)), i is None, i or 0) for i, x in v if i != q)
        out += [(q, r, None if lost else i, -s) for r, (s, lost, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_top_k(spark, block):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.0, 0.5, 0.1]) for _ in range(6)]) for i in range(410)]
    rows += [(1000, None), (1001, [1.0, None]), (1100, [float("nan")] * 6), (1002, [float("inf")] * 6), (1003, []), (200, [9.0] * 6), (7, rows[7][1]), (1200, [1.0, 1.0]), (None, [1.0] * 6)]
    rows += [(None, [-90.0] * 6), (None, rows[3][1]), (None, rows[3][1]), (None, None)]
    df = spark.createDataFrame([(i, v, 0, 5) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(5)
    got = topk.exact_top_k(df, F.col("vec_id") % 100 == 0, query_block=block).collect()
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(search(rows), key=key)
    assert any(r.vec_id is None for r in got)


def test_top_k_sql_with_null_ids(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (None, [5.0, 0.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0]), (100, [0.5, 0.5]), (4, None), (5, [1.0, float("inf")])]
    rows += [(i, [0.1, 0.1]) for i in range(11, 19)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    key = lambda r: (r[0], r[1])
    got = sorted((tuple(r) for r in queries.op8_exact_top_k(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(con.sql(queries.oracle_sql()["op8_exact_top_k"]).fetchall(), key=key) == sorted(search(rows), key=key)


def test_top_k_says_what_is_too_large(spark):
    for x in (1e30, 1e17):
        df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [x, 0.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="passes 64 bits"):
            topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()


def test_top_k_large(spark):
    """Finite components of any size that scales into 64 bits take part, as candidates and as queries."""
    rnd = random.Random(4)
    rows = [(i, [float(np.float32(rnd.choice([-3e4, 2e4, 1.5, 3e8, -3e8]) * rnd.random())) for _ in range(6)]) for i in range(210)]
    # products near and beyond 2^53 that cancel
    rows += [(300, [float(2**20), 3.0]), (301, [float(2**20), float(-(2**20))]), (302, [float(2**50), 0.0]), (400, [0.0, 1.0 / 1024]), (303, [0.0, float(2**52)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in x]) for i, x in rows]
    want = []
    for q, own in v:
        if q in (0, 100, 200, 400):
            scores = sorted((-sum(a * b for a, b in zip(own, x, strict=False)), i) for i, x in v if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:10], 1)]
    fits = {q for q in (0, 100, 200, 400) if all(-(2**63) <= s < 2**63 for x, _, _, s in want if x == q)}
    assert 400 in fits
    got = topk.exact_top_k(df, F.col("vec_id").isin(*fits)).collect()
    assert sorted(tuple(r) for r in got) == sorted(w for w in want if w[0] in fits)


def test_top_k_exact_beyond_64_bits():
    rnd = random.Random(6)
    for few in (1, 9):
        a = np.array([[rnd.choice([rnd.randint(-(2**62), 2**62), rnd.randint(-9, 9)]) for _ in range(5)] for _ in range(9)])
        b = np.array([[rnd.randint(-(2**62), 2**62) if i < few else rnd.randint(-9, 9) for _ in range(5)] for i in range(20)])
        for x, y in ((a, b), (b, a)):
            want = [[sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for s in y] for r in x]
            assert topk.exact_scores(x, y).tolist() == want
    with pytest.raises(OverflowError):
        topk.as_long(np.array([1 << 63], object))


def test_top_k_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 2097152)]
    assert topk.exact_top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0


# --- sharding ---


def test_sharding(spark, tmp_path):
    rows = [(i, f"text {i} " * 50) for i in range(2000)] + [(None, None), (5, "text 5"), (3000, "x" * 100_000)]
    df = docs(spark, rows).repartition(6)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, fanout=3)
    for part in range(4):
        store.append(df.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == part))
    first = store.version()
    before, _ = store.manifest()
    store.compact()
    after, _ = store.manifest()
    assert len(after) < len(before) and max(s.bytes for s in after) < 200_000 and sum(s.merges > 0 for s in after) > 1
    read = lambda v: collections.Counter((r.doc_id, r.text) for r in store.read(v, "__f").collect())
    assert read(None) == read(first) == collections.Counter(rows)
    assert {r[0] for r in store.read(file_col="__f").select("__f").distinct().collect()} == {s.file for s in after}
    # the first shards go, and what a first pass of merges made and a second merged again
    assert store.vacuum() == 0  # all of it is younger than the grace period
    assert store.vacuum(retain=1, grace_s=0) >= len(before) - len({s.file for s in after} & {s.file for s in before}) and read(None) == collections.Counter(rows)
    assert store.vacuum(retain=1, grace_s=0) == 0
    with pytest.raises(sharding.ConcurrentCommit):
        store._commit(store.version() - 1, after, df.schema)
    with pytest.raises(ValueError):
        store.append(df.select("doc_id"))


def test_sharding_versions(spark, tmp_path):
    """One version an arrival; rows of whatever column names; retained versions stay readable."""
    df = docs(spark, [(i, f"t{i}") for i in range(40)]).withColumn("__arrival", F.lit("mine")).withColumn("batch", F.pmod("doc_id", F.lit(5)))
    store = sharding.ShardStore(spark, str(tmp_path / "v"), target_bytes=60_000, fanout=3)
    store.append(df, "batch")
    assert store.version() == 5
    assert [store.read(v).count() for v in range(1, 6)] == [8, 16, 24, 32, 40]
    assert {r["__arrival"] for r in store.read().collect()} == {"mine"}
    store.compact()
    newest = store.version()
    store.vacuum(retain=2, grace_s=0)
    assert store.read(newest).count() == store.read(newest - 1).count() == 40
    with pytest.raises(Exception, match="v00000001"):
        store.read(1)


def test_sharding_races(spark, tmp_path):
    """Another writer's uncommitted files survive a vacuum, and a writer that lost a race commits on top of the winner."""
    path = str(tmp_path / "r")
    one, two = (sharding.ShardStore(spark, path, target_bytes=60_000, fanout=2) for _ in range(2))
    part = lambda a: docs(spark, [(i, f"t{i}") for i in range(a, a + 20)])
    one.append(part(0))
    commit, lost = two._commit, []

    def late(base, shards, schema):  # between this writer's files and its commit, the other one appends and cleans up
        if not lost:
            lost.append(1)
            one.append(part(100))
            one.vacuum(retain=1)
        return commit(base, shards, schema)

    two._commit = late
    two.append(part(200))
    assert one.read().count() == 60 and one.version() == 3
    lost.clear()
    two.compact()
    assert one.read().count() == 80 and len({s.file for s in one.manifest()[0]}) == len(one.manifest()[0])
    fail = sharding.ShardStore(spark, path)
    fail._commit = lambda *_: (_ for _ in ()).throw(sharding.ConcurrentCommit("always"))
    with pytest.raises(sharding.ConcurrentCommit):
        fail.append(part(300))
    assert one.read().count() == 80


def test_sharding_all(spark, tmp_path):
    store = sharding.shard_documents(docs(spark, [(i, "t") for i in range(50)]), str(tmp_path / "a"), arrivals=3)
    assert store.read(file_col="__f").count() == 50
    assert sharding.shard_documents(docs(spark, []), str(tmp_path / "b")).read(file_col="__f").count() == 0


# --- pipeline ---


def test_pipeline_stages(spark):
    rnd = random.Random(6)
    sentence = lambda: " ".join(rnd.choice(["the", "cat", "house", "runs", "green", "over", "yesterday", "tree", "slowly"]) for _ in range(40))
    texts = [sentence() for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (101, texts[1] + " extra"), (102, "12 34"), (103, None)]
    d = docs(spark, rows)
    kept = corpus_pipeline.identify_language(spark, d, "")
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if t and i != 102} and kept.columns == d.columns
    exact = corpus_pipeline.drop_exact_copies(spark, kept, "")
    assert {r.doc_id for r in exact.collect()} == {*range(1, 30), 100, 101}
    near = corpus_pipeline.drop_near_copies(spark, exact, "")
    assert {r.doc_id for r in near.collect()} == {*range(1, 30), 100} and near.columns == d.columns
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert sum(len(r.text.split()) for r in mixed.collect()) == 30 * 40 and mixed.columns == d.columns
    packed = corpus_pipeline.pack(spark, mixed, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_pipeline_repeated_and_null_ids(spark):
    """One row stays of each text and of each group of near copies, also where ids repeat or are null."""
    rnd = random.Random(7)
    a, b, c, e = (" ".join(f"w{rnd.randrange(1000)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, a), (None, b), (None, b), (2, c), (None, c), (None, None), (None, "")]
    exact = corpus_pipeline.drop_exact_copies(spark, docs(spark, rows), "").collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in exact) == sorted([(1, a), (0, b), (2, c), (0, "")])
    rows = [(1, a), (1, a + " more"), (5, b), (None, b + " more"), (None, c), (None, c + " more"), (7, e), (7, "x y z"), (None, None), (None, "")]
    near = [((r.doc_id or 0), r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()]
    left = collections.Counter((i, t.removesuffix(" more")) for i, t in near)
    assert left == {(1, a): 1, (5, b): 1, (0, c): 1, (7, e): 1, (7, "x y z"): 1, (0, ""): 2} and (5, b) in near


def test_pipeline_mixes_whole_texts(spark):
    """No text is cut, and each source's words pass its target by less than one document."""
    rnd = random.Random(9)
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(rnd.randint(5, 40))), "en", "abc"[i % 3]) for i in range(90)]
    d = spark.createDataFrame([(i, t, g, s, None, 1, False, 2, 3, "f") for i, t, g, s in rows], SCHEMA)
    demand = mixing.assign_demand(d).collect()
    texts = {i: t for i, t, _, _ in rows}
    assert any(0 < r.cut_words < r.size for r in demand)
    got = collections.Counter()
    for r in corpus_pipeline.mix_sources(spark, d, "").collect():
        assert r.text == texts[r.doc_id]
        got[r.source] += len(r.text.split())
    for s in "abc":
        target = round(next(r.target for r in demand if r.source == s))
        assert target <= got[s] < target + 40


def test_pipeline_empty(spark):
    d = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, "")
        assert out.count() == 0
