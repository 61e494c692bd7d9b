"""Toxicity by logistic regression, learnt with follow-the-regularised-leader (FTRL-proximal) over hashed word n-grams and skip-grams.

A word is a run of letters A-Z, in lower case, and of bytes beyond ASCII. A text's features are, as a set, its words, the stems of its longer
words (their first ``STEM_BYTES`` bytes, so that endings don't hide a word that was seen with another one), and pairs of words that
stand up to ``REACH`` apart, all hashed into ``DIMENSIONS`` numbers. Each feature has a learning rate of its own that falls with the gradients it has
seen, and its weight stays at zero until these outweigh the L1 penalty, so a model is a few thousand numbers, which go to all tasks.

The fit uses a bounded, hash-chosen sample: at most ``PER_LABEL`` documents of each label, none over ``MAX_TRAIN_CHARS``; the intercept is then moved
from the sample's share of toxic documents to that of all labelled ones. Ids are drawn from the table of labels alone, by a threshold on their
hash, so documents are only read once with a small broadcast table beside them, and no text is shuffled but the sample's. One task
learns from the sample in the order of the hashes, ``EPOCHS`` times. Prediction is a map over whole texts and reads nothing else of a row.

Defined results: a null or empty text has no features and gets the intercept's score; a document that has both labels counts as
toxic; of rows that share an id the least text is learnt from; null labels and ids are not learnt from; without any label the score is 0, and with
labels but without a text to learn from it is their share of toxic ones; with a tie
the score decides alone, at ``THRESHOLD``; repeated rows are scored each; very long texts are scored whole; an empty table gives an empty
result. Other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinlog.llm import _words
from skeinlog.llm._memory import released

DIMENSIONS = 1 << 20
STEM_BYTES, REACH = 4, 3
PER_LABEL = {1: 3000, 0: 6000}
MAX_TRAIN_CHARS = 50_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.5, 1.0, 4.0, 0.1
THRESHOLD = 0.3

#: A-Z as a-z; bytes of no word as a space.
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each block of texts its first and end text, and its features as (text in the block, number), with repeats."""
    for a, b, h, offsets, own, starts, stops in _words.blocks_with_bytes(texts, False, fold=_FOLD):
        text = np.repeat(np.arange(b - a), np.diff(offsets))
        long = stops - starts > STEM_BYTES + 1
        where, found = [text, text[long]], [h, _words.hashes(own, starts[long], starts[long] + STEM_BYTES, family=1)]
        for d in range(1, REACH + 1):
            together = text[d:] == text[:-d]
            where.append(text[d:][together])
            found.append(_words.mix(h[:-d][together] * np.uint64(2 * d + 1) + h[d:][together]))
        yield a, b, np.concatenate(where), (np.concatenate(found) % np.uint64(DIMENSIONS)).astype(np.int64)


def feature_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of features of each text."""
    for a, b, where, found in features(texts):
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(found[order[cuts[i] : cuts[i + 1]]])


@dataclass
class Ftrl:
    """The state of each coordinate; the last one is the intercept, which has no penalty."""

    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2
    z: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS + 1))

    def weights(self, at) -> np.ndarray:
        z, rate = self.z[at], (self.beta + np.sqrt(self.n[at])) / self.alpha
        free = np.arange(len(self.z))[at] == DIMENSIONS
        l1, l2 = np.where(free, 0.0, self.l1), np.where(free, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / (rate + l2))

    def learn(self, own: np.ndarray, label: int) -> None:
        at = np.append(own, DIMENSIONS)
        w = self.weights(at)
        g = _sigmoid(w.sum()) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    numbers: np.ndarray  # features with a weight, in order
    weights: np.ndarray
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        dense = np.zeros(DIMENSIONS, np.float64)
        dense[self.numbers] = self.weights
        out = []
        for a, b, where, found in features(texts):
            some = dense[found] != 0
            pairs = np.unique(where[some] * DIMENSIONS + found[some])  # each feature once for a text
            sums = np.bincount(pairs // DIMENSIONS, weights=dense[pairs % DIMENSIONS], minlength=b - a)
            out.append(_sigmoid(sums + self.intercept))
        return np.concatenate(out) if out else np.zeros(0)


def _fit(epochs: int):
    """One task over the sample, in its order: the weights that aren't zero, and the intercept as the last of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            rows += [(own.astype(np.int32), label) for own, label in zip(feature_sets(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
        if not rows:
            return
        state = Ftrl()
        for _ in range(epochs):
            for own, label in rows:
                state.learn(own, label)
        w = state.weights(slice(None))
        at = np.flatnonzero(w)
        at = at if len(at) and at[-1] == DIMENSIONS else np.append(at, DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["number", "weight"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: dict[int, int] | None = None,
    max_chars: int = MAX_TRAIN_CHARS,
    epochs: int = EPOCHS,
) -> Model:
    """A model from the labels (0 or 1) of the rows of ``labels`` that ``allowed`` admits, and the texts of their documents."""
    per_label = per_label or PER_LABEL
    known = labels.where(allowed & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    known = known.withColumn("__h", F.xxhash64("__id"))
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if not sizes:
        return Model(np.zeros(0, np.int64), np.zeros(0), -math.inf)
    total, toxic = sum(sizes.values()), sizes.get(1, 0)
    # a hash range of each label that holds enough; the rank then takes exactly as many
    near = F.lit(False)
    for label, n in sizes.items():
        share = min(1.0, (1.2 * per_label[label] + 100) / n)
        near = near | ((F.col("__label") == label) & (F.col("__h").cast("double") <= -(2.0**63) + share * 2.0**64))
    ranked = known.where(near).withColumn("__r", F.row_number().over(Window.partitionBy("__label").orderBy("__h", "__id")))
    wanted = F.col("__r") <= F.when(F.col("__label") == 1, per_label[1]).otherwise(per_label[0])
    drawn = ranked.where(wanted).select("__id", "__label", "__h")
    texts = docs.where(F.col(text_col).isNotNull() & (F.length(text_col) <= max_chars)).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    rows = texts.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).groupBy("__id", "__label", "__h").agg(F.min("__text").alias("__text"))
    # at most sum(per_label) rows of at most max_chars, for one task
    sample = rows.repartition(1).sortWithinPartitions("__h", "__id")
    counted = sample.groupBy("__label").count()
    found = sample.select("__text", "__label").mapInArrow(released(_fit(epochs)), "number long, weight double").toArrow().combine_chunks()
    if not found.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), _logit(toxic / total))
    number, weight = found.column("number").to_numpy(), found.column("weight").to_numpy()
    used = {r["__label"]: r["count"] for r in counted.collect()}
    shift = 0.0
    if all(d.get(label, 0) for d in (sizes, used) for label in (0, 1)):
        shift = math.log(sizes[1] / sizes[0]) - math.log(used[1] / used[0])
    return Model(number[:-1], weight[:-1], float(weight[-1]) + shift)


def _logit(p: float) -> float:
    return math.log(p / (1 - p)) if 0 < p < 1 else math.copysign(math.inf, p - 0.5)


def _predict(model: Model, names: list[str], text_at: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(text_at)) if math.isfinite(model.intercept) else np.full(batch.num_rows, 1.0 if model.intercept > 0 else 0.0)
            columns = [*(batch.column(i) for i in range(kept)), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The columns ``keep`` of every row with its score (0 to 1) and whether it reaches ``THRESHOLD``; a map over the rows, no shuffle."""
    own = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*own, F.col(text_col).alias("__text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return rows.mapInArrow(released(_predict(model, [*keep, *names], len(keep), len(keep))), schema)
