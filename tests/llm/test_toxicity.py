"""Toxicity: the learner against a plain one, features against a plain model, and accuracy on documents it has not seen."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skeinlog.llm import _words, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, held_out boolean, score double, toxic int, __text string"
BAD = ["vile", "rotten", "wretch", "filthy", "pigheaded"]


def docs(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, "en", "s", None, 9.0, 7, "y") for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, toxic int, text int")


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(5)
    words = [f"w{''.join(rnd.choices('abcdefgh', k=rnd.randint(1, 6)))}" for _ in range(300)]
    rows, marks = [], []
    for i in range(900):
        w = rnd.choices(words, k=rnd.randint(5, 60))
        bad = rnd.random() < 0.3
        for _ in range(rnd.randint(1, 3) if bad else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(BAD).title() + rnd.choice(["", "!", "ly", "est."]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    return rows, marks


def test_features():
    texts = ["One two-three", "", None, "a bb ccc", "stemming", "été"]
    got = list(toxicity.feature_sets(pa.array(texts)))
    plain = {w: int(_words.hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in ("one", "two", "three", "a", "bb", "ccc", "stemming", "été")}
    assert [len(s) for s in got] == [6, 0, 0, 6, 2, 1]
    dim = toxicity.DIMENSIONS
    assert {plain[w] % dim for w in ("one", "two", "three")} <= set(got[0].tolist()) and {plain["été"] % dim} == set(got[5].tolist())
    pair = lambda a, b, d: int(_words.mix(np.array([(plain[a] * (2 * d + 1) + plain[b]) % 2**64], np.uint64))[0]) % dim
    assert {pair("one", "two", 1), pair("two", "three", 1), pair("one", "three", 2)} <= set(got[0].tolist())
    assert len(np.intersect1d(*toxicity.feature_sets(pa.array(["stemmed", "stemming"])))) == 1


def test_learner():
    """Coordinates as a plain implementation has them, one at a time."""
    rnd = random.Random(1)
    rows = [(np.array(sorted(rnd.sample(range(20), rnd.randint(0, 6))), np.int64), rnd.randint(0, 1)) for _ in range(200)]
    state = toxicity.Ftrl(0.3, 1.0, 0.7, 0.2)
    z, n, top = {}, {}, toxicity.DIMENSIONS

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == top else (0.7, 0.2)
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + l2)

    for own, label in rows:
        state.learn(own, label)
        at = [*own.tolist(), top]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            before = n.get(i, 0.0)
            n[i] = before + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / 0.3 * w[i]
    assert all(math.isclose(state.weights(np.array([i]))[0], weight(i), abs_tol=1e-9) for i in z)


def test_accuracy_and_sparsity(spark, made):
    rows, marks = made
    df, seen = docs(spark, rows), labels(spark, [m for m in marks if m[0] % 4])
    model = toxicity.train(df, seen, queries.crc_of_id() >= 0)
    assert 0 < len(model.numbers) < 2000
    got = {r.doc_id: r for r in toxicity.predict(df, model, ["doc_id"]).collect()}
    held = [(i, y) for i, y in marks if i % 4 == 0]
    right = sum(got[i].predicted == y for i, y in held)
    assert right >= 0.97 * len(held) and all(r.predicted == (r.score >= 0.3) for r in got.values())
    texts = pa.array([t for _, t in rows])
    weight = dict(zip(model.numbers.tolist(), model.weights.tolist(), strict=True))
    for (i, _), own in zip(rows, toxicity.feature_sets(texts), strict=True):
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-sum(weight.get(f, 0.0) for f in own.tolist()) - model.intercept)), rel_tol=1e-9)


def test_bounded_sample_and_share(spark, made):
    """With a bound the share of toxic documents is still that of all labels; a rerun gives the same model."""
    rows, marks = made
    df = docs(spark, [*rows, (3, rows[3][1]), (None, "vile"), (5000, "x " * 60_000)])
    seen = labels(spark, [*marks, (None, 1), (7, None), (8, 5), (5000, 1), (6000, 0), *marks[:5]])
    model = toxicity.train(df, seen, queries.crc_of_id() >= 0, per_label={1: 60, 0: 30})
    other = toxicity.train(df.repartition(7), seen.repartition(3), queries.crc_of_id() >= 0, per_label={1: 60, 0: 30})
    assert model.numbers.tolist() == other.numbers.tolist() and model.intercept == other.intercept
    full = toxicity.train(df, seen, queries.crc_of_id() >= 0)
    empty = lambda m: float(m.scores(pa.array([""]))[0])
    assert empty(model) < 0.5 and empty(full) < 0.3


def test_edges(spark, made, tmp_path):
    df = docs(spark, [(1, None), (2, ""), (None, "vile thing"), (3, "vile " * 50_000), (3, "vile"), (3, "vile"), (4, "x" * 30_000)])
    none = labels(spark, [])
    nothing = toxicity.train(df, none, queries.crc_of_id() >= 0)
    assert {r.score for r in toxicity.predict(df, nothing, ["doc_id"]).collect()} == {0.0}
    without_texts = toxicity.train(df, labels(spark, [(90, 1), (91, 0), (92, 0), (93, 0)]), queries.crc_of_id() >= 0)
    assert all(math.isclose(r.score, 0.25) for r in toxicity.predict(df, without_texts, ["doc_id"]).collect())
    rows, marks = made
    model = toxicity.train(docs(spark, rows), labels(spark, marks), queries.crc_of_id() >= 0)
    got = toxicity.predict(df, model, ["doc_id"]).collect()
    assert len(got) == 7 and {r.predicted for r in got if r.doc_id in (1, 2)} == {0} and {r.predicted for r in got if r.doc_id in (None, 3)} == {1}
    assert toxicity.predict(docs(spark, []), model, ["doc_id"]).count() == 0


def test_query(spark, made, tmp_path):
    """Labels of held-out rows, and languages and sources, change nothing."""
    rows, marks = made
    results = []
    for turn in (False, True):
        at = tmp_path / str(turn)
        docs(spark, rows).write.parquet(str(at / "documents.parquet"))
        held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
        labels(spark, [(i, 1 - y if turn and held(i) else y) for i, y in marks]).write.parquet(str(at / "labels.parquet"))
        results.append(sorted(tuple(r) for r in queries.op13_toxicity(spark, str(at)).collect()))
    assert results[0] == results[1]
    assert all(r[1] == held(r[0]) for r in results[0])
    right = [r[3] == y for r, (_, y) in zip(results[0], marks, strict=True) if r[1]]
    assert sum(right) >= 0.97 * len(right)
