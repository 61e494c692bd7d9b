"""Language identification with string kernels.

A text is the set of its byte n-grams of 1 to 3 bytes, lower-cased (blended spectrum, presence only). The kernel
of two texts is the number of n-grams they share over the root of the product of their set sizes. Nystroem
landmarks, taken evenly from all languages, span the feature space; one ridge regression per language (one against
the rest) is solved on it. At prediction a batch of texts becomes a 0/1 matrix over the landmarks' n-grams, and two
matrix products give all kernel values and all scores.

The fit uses a bounded, hash-chosen sample: at most ``per_lang`` texts a language, ``max_sample`` in all, none over
``max_train_chars``. The number of texts of each language sets a threshold on a hash of id and text, so that only about
twice the texts that are needed leave the scan. Prediction reads whole texts and nothing else of a row.

Defined results: a null text, or one without any letter (Unicode category L), is ``und`` with score 0; so is every text
when nothing could be learned. Languages that score alike go to the first by name. Repeated rows are predicted
each and drawn once. Very long texts are predicted from all of their n-grams. An empty table gives no model and no rows.
Other columns may have any names but those of the two that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm._memory import cleared_after_tasks, released

PER_LANG = 150
MAX_SAMPLE = 2000
MAX_TRAIN_CHARS = 50_000
LANDMARKS_PER_LANG = 24
MAX_LANDMARKS = 256
RIDGE = 0.01
SHARPNESS = 6.0
UNKNOWN = "und"
_CODES = 256 + 65536 + 16777216
_LETTER = regex.compile(r"\p{L}")


def codes(text: str) -> np.ndarray:
    """Codes of the 1- to 3-byte n-grams of a text, with repeats."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
    two = b[:-1] * 256 + b[1:]
    return np.concatenate([b, two + 256, two[:-1] * 256 + b[2:] + 65792])


@dataclass
class Model:
    langs: list[str]
    vocabulary: np.ndarray  # the n-grams of the landmarks
    landmarks: np.ndarray  # vocabulary x landmarks, 0/1
    weights: np.ndarray  # landmarks x languages

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's n-grams in each text (0/1), and the size of each text's whole set."""
        flags = _flags()
        out, sizes = np.zeros((len(texts), len(self.vocabulary)), np.float32), np.zeros(len(texts))
        for i, text in enumerate(texts):
            own = np.unique(codes(text))
            sizes[i] = len(own)
            flags[own] = 1
            out[i] = flags[self.vocabulary]
            flags[own] = 0
        return out, sizes

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(*self.presence(texts)) @ self.weights

    def kernel(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Shared n-grams over the root of the product of the set sizes; the vocabulary holds all n-grams of the landmarks."""
        own = np.sqrt(np.maximum(sizes, 1))[:, None]
        other = np.sqrt(np.maximum(self.landmarks.sum(0, dtype=np.float64), 1))[None, :]
        return (x @ self.landmarks) / (own * other)


_FLAGS: list[np.ndarray] = []
cleared_after_tasks(_FLAGS.clear)


def _flags() -> np.ndarray:
    if not _FLAGS:
        _FLAGS.append(np.zeros(_CODES, np.uint8))
    return _FLAGS[0]


def fit(texts: list[str], langs: list[str], ridge: float = RIDGE, per_lang: int = LANDMARKS_PER_LANG, most: int = MAX_LANDMARKS) -> Model:
    """texts in an order of preference; the first of each language become its landmarks."""
    names = sorted(set(langs))
    each = max(1, min(per_lang, most // max(1, len(names))))
    chosen, taken = [], dict.fromkeys(names, 0)
    for i, lang in enumerate(langs):
        if taken[lang] < each:
            taken[lang] += 1
            chosen.append(i)
    vocabulary = np.unique(np.concatenate([codes(texts[i]) for i in chosen])).astype(np.int64)
    model = Model(names, vocabulary, np.zeros((len(vocabulary), 0), np.float32), np.zeros((0, len(names))))
    marks, sizes = model.presence([texts[i] for i in chosen])
    model.landmarks = np.ascontiguousarray(marks.T)
    inner = model.kernel(marks, sizes)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    fine = values > 1e-8 * max(values.max(initial=0), 1e-12)
    root = vectors[:, fine] / np.sqrt(values[fine])
    features = np.concatenate([model.kernel(*model.presence(texts[i : i + 256])) @ root for i in range(0, len(texts), 256)])
    wanted = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    # each language's regression weighs its own and the other texts alike
    solved = []
    for j in range(len(names)):
        is_own = wanted[:, j] > 0
        w = np.where(is_own, 0.5 / max(1, is_own.sum()), 0.5 / max(1, (~is_own).sum()))[:, None]
        gram = features.T @ (features * w)
        solved.append(np.linalg.solve(gram + ridge * np.eye(len(gram)) / len(texts), features.T @ (w[:, 0] * wanted[:, j])))
    model.weights = root @ np.stack(solved, 1)
    return model


def sample(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str, per_lang: int, max_sample: int, max_chars: int) -> DataFrame:
    """At most per_lang rows of each language and max_sample in all, those with the least hashes of id and text.

    A language's share of the hash range is about twice what it needs; the rows in it are the only ones that are moved.
    """
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    rows = docs.where(allowed & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= max_chars))
    rows = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), F.col(text_col).alias("text"))
    # few languages in number: no more than there can be rows in the sample
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy("lang").limit(max_sample)
    share = F.least(F.lit(1.0), (2.0 * per_lang + 100) / F.col("n"))
    bounds = sizes.select(F.col("lang").alias("__lang"), (-(2.0**63) + share * 2.0**64).alias("__most"))
    few = rows.join(F.broadcast(bounds), (F.col("lang") == F.col("__lang")) & (F.col("h").cast("double") <= F.col("__most")))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.where(F.col("r") <= per_lang).orderBy("r", "lang").limit(max_sample)


def train(
    docs: DataFrame,
    allowed: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = PER_LANG,
    max_sample: int = MAX_SAMPLE,
    max_train_chars: int = MAX_TRAIN_CHARS,
) -> Model | None:
    """A model from the rows that ``allowed`` admits, or None if none has a letter and a language."""
    narrow = sample(docs, allowed, id_col, text_col, lang_col, per_lang, max_sample, max_train_chars).collect()
    rows = [(r["text"], r["lang"]) for r in narrow if _LETTER.search(r["text"])]
    return fit([t for t, _ in rows], [n for _, n in rows]) if rows else None


def _predict(model: Model | None, sharpness: float, names: tuple[str, str], text_at: int, kept: int, batch_rows: int = 128):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                texts = part.column(text_at).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                lettered = [i for i, t in enumerate(texts) if t is not None and model is not None and _LETTER.search(t)]
                if lettered:
                    s = sharpness * model.scores([texts[i] for i in lettered])
                    p = np.exp(s - s.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    for i, j, q in zip(lettered, best.tolist(), p[np.arange(len(best)), best].tolist(), strict=True):
                        langs[i], scores[i] = model.langs[j], q
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(kept)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names[:kept], *names],
                )

    return run


def predict(
    docs: DataFrame,
    model: Model | None,
    keep: list[str],
    text_col: str = "text",
    sharpness: float = SHARPNESS,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` of every row with the predicted language and its score; a map over the rows, no shuffle."""
    from pyspark.sql import types as T

    own = [F.col(f"`{c}`") for c in keep]
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    rows = docs.select(*own, *([F.col(text_col).alias("__text")] if text_at == len(keep) else []))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(released(_predict(model, sharpness, names, text_at, len(keep))), schema)
