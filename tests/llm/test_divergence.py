"""Divergence of sources: against a plain model and the query's SQL."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from skeinlog.llm import divergence, queries

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, block int, g int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def docs(spark, rows):
    """Rows of (text, lang, source) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, *r, 1, "x", 2, 3) for i, r in enumerate(rows)], SCHEMA)


def brute(rows, least, top):
    counts, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in own.items():
            pairs = [(-sum(abs(p(c, t) - p(d, t)) for t in kept), x.encode()) for x, d in own.items() if x != s]
            terms = [(p(whole, t) - p(c, t), t.encode()) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    words = ["the", "The", "été", "ÉTÉ", "a1b", "x_y", "naïve", "zoo", "ﬁn", "日本", "it's"] + [f"w{chr(97 + i)}" for i in range(20)]
    made = [(" ".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "é", "Z", None])) for _ in range(200)]
    return [*made, made[0], (None, "de", "a"), ("", "de", None), ("the the", "xx", "only"), ("the " * 50_000, "en", "a"), ("y" * 20_000, "en", "b"), (None, None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, rows, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_TERMS", 3), ("BLOCK_GROUPS", 2), ("FLUSH_TERMS", 5), ("SLICE_BYTES", 16)):
            monkeypatch.setattr(divergence, name, value)
    got = sorted(tuple(r) for r in divergence.audit(docs(spark, rows), least_docs=12, top=4).collect())
    assert got == brute(rows, 12, 4) and {r[2] for r in got} == {"pair", "term"}


def test_query_and_sql(spark, rows, tmp_path):
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op11_source_divergence(spark, str(tmp_path))
    want = con.sql(queries.oracle_sql()["op11_source_divergence"]).select(*got.columns).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) == brute(rows, 30, 50)


def test_shares():
    rnd = np.random.default_rng(1)
    for most in (10, 10**6, 10**14):
        n = rnd.integers(0, most, 50)
        total = n + rnd.integers(0, most, 50)
        want = [1 + 10**9 * (a + 5) // (b + 5 * 77) for a, b in zip(n.tolist(), total.tolist(), strict=True)]
        assert divergence.shares(n, total, 77).tolist() == want


def test_empty(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
