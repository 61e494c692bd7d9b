"""Repair of conversations: against all edits tried out, and against the query's SQL."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, n long, piece long, conv string, cost long"
SPACE = " \t\n\x0b\x0c\r"


def turns(spark, rows):
    """Rows of (conv_id, turn, role, text) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 9, 9, "x", 9) for r in rows], SCHEMA)


def brute(rows):
    """Of (turn, role, text) in any order: the summary of one conversation, from every sequence of edits."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    best = None
    choices = []
    for (_, role, text), fault in zip(rows, faults, strict=True):
        late = 5 if fault == "truncated" else 0
        one = [(2, "D", [])]
        if fault not in ("blank", "duplicate"):
            one += [(late, "K", [(role, text)]), (1 + late, "R", [("user", text)]), (1 + late, "R", [("assistant", text)])]
        choices.append(one)
    gap = [[], [("user", "")], [("assistant", "")], [("user", ""), ("assistant", "")], [("assistant", ""), ("user", "")]]
    for pick in itertools.product(*choices):
        for ins in itertools.product(gap, repeat=len(rows) + 1):
            if sum(map(len, ins)) > 2:
                continue
            cost = sum(c for c, _, _ in pick) + 5 * sum(map(len, ins))
            if best is not None and cost > best[0]:
                continue
            out, audit = list(ins[0]), "I" * len(ins[0])
            for (_, letter, kept), more in zip(pick, ins[1:], strict=True):
                out += [*kept, *more]
                audit += letter + "I" * len(more)
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                offer = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
                best = offer if best is None else min(best, offer)
    n = collections.Counter(faults)
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def by_conversation(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_small_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK_TURNS", chunk)
    monkeypatch.setattr(conversations, "BATCH_TURNS", 5 if chunk == 2 else 8192)
    rnd = random.Random(chunk)
    rows = []
    for c in range(60):
        for _ in range(rnd.randint(1, 4)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool", "unknown"])
            rows.append((None if c == 7 else c, rnd.choice([None, 0, 1, 2, 5]), role, rnd.choice(["Yes.", "No", " \n", None, "", "Fine! ", "Ok. then"])))
    got = by_conversation(conversations.summarise(conversations.repair(turns(spark, rows))))
    want = collections.defaultdict(list)
    for c, *r in rows:
        want[c].append(r)
    assert len(got) == len(want)
    for c, r in want.items():
        assert got[c] == brute(r), (c, r)


def test_insertions(spark):
    """With other prices insertions pay; they stand before kept turns or at the end."""
    costs = conversations.Costs(delete=20, insert=1, rerole=20)
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (2, 0, "user", "U."), (3, 0, "system", "S."), (4, 0, "user", ""), (4, 1, "assistant", "A.")]
    got = {r.conv: r for r in conversations.repair(turns(spark, rows), costs=costs).where("whole").collect()}
    rest = by_conversation(conversations.summarise(conversations.repair(turns(spark, rows), costs=costs)).select("conv", "cost", "audit"))
    assert rest == {1: (2, "KIKIK"), 2: (1, "KI"), 3: (2, "KII"), 4: (21, "DIK")}
    for r in got.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.repaired))
    with pytest.raises(ValueError, match="insertion"):
        conversations.Costs(insert=0)


def test_one_conversation_in_many_tasks(spark, monkeypatch):
    """A long conversation is dealt over tasks and comes out as in one chunk; so do very many equal turns."""
    rnd = random.Random(2)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["a.", f"{t}.", f"{t}", "", "x" * 5000 + "."])) for t in range(600)]
    rows += [(1, 600, "user", "same.")] * 500 + [(2, None, "user", "u.")] * 3 + [(3, 1, "user", "u"), (3, 2, "assistant", "a.")]
    whole = None
    for chunk in (5000, 16):
        monkeypatch.setattr(conversations, "CHUNK_TURNS", chunk)
        pieces = conversations.repair(turns(spark, rows).repartition(3))
        if chunk == 16:
            assert pieces.where("conv = 1").count() > 30
        got = by_conversation(conversations.summarise(pieces))
        assert whole in (None, got)
        whole = got
    assert whole[1][6].count("D") >= 499 and whole[2][1:4] == (0, 2, 0) and len(whole[1][6]) >= 1100


def test_query_and_sql(spark, tmp_path):
    """Damage included: nulls in any column, equal numbers, a conversation that loses every turn, repeated rows."""
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["Well. Yes!", "no", None, "\t", "ok?"])) for c in range(150) for t in range(rnd.randint(0, 7))]
    rows += [(None, 1, "user", "x."), (None, None, "assistant", "y."), (5, None, None, None), (9, 2, "user", "again."), (9, 2, "user", "again."), (9, 2, "user", "other.")]
    turns(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    want = con.sql(queries.oracle_sql()["op12_conversation_repair"])
    assert by_conversation(got) == {r[0]: tuple(r)[1:] for r in want.select(*got.columns).fetchall()}
    assert len(by_conversation(got)) == len({r[0] for r in rows})
    damaged = {r.conv_id: r.t for r in conversations.damage(turns(spark, rows)).groupBy("conv_id").agg(F.sum("times").alias("t")).collect()}
    gone = [c for c, t in damaged.items() if t == 0]
    assert gone and all(by_conversation(got)[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


def test_empty(spark):
    assert conversations.summarise(conversations.repair(turns(spark, []))).count() == 0
