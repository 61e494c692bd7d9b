"""Katz backoff scoring of whole texts, of any order.

Tokens are the words of a text and one end mark; the words before a text's first are end marks too. N-grams of all
lengths up to ``order`` are counted over the training texts and all of them are stored, those seen once too. Counts up to
``GT_MOST`` are discounted by Good-Turing, with factors of each length's own. The unigram mass that discounting frees
belongs to unknown words. For a context v of any length,

    P(w | v) = d * c(v w) / c(v)   if v w is stored, else   alpha(v) * P(w | v without its first word)

and alpha(v) is what the stored continuations of v leave over, divided by what their words leave over of the shorter
model; with it the probabilities of all words and the unknown class add up to one exactly, at every length.

Texts are tokenized once, into a table of blocks (about 4 MB of text each, as codes of a dictionary of their own). Everything
else runs on blocks, level by level: a block sends each distinct n-gram once, with its count in the block, to the part of
the table that its hash names; so a frequent n-gram is combined before the shuffle. Keys travel as arrays, one
row per (block, part), and a part is read as a stream, so that a task holds one part's distinct n-grams and one
row. Contexts are sums over n-grams, combined per part in the same way, so the n-grams of a frequent context are spread over
all parts. The tables of counts and contexts are Parquet with a row per part; the number of parts grows with the
training texts. A block then asks the parts for its distinct n-grams and contexts, and each token's probability
follows by the recursion above from that of the shorter n-gram. From bigrams on, parts are worked through in ``SLICES``
ranges and blocks in as many groups, one after the other, which bounds the shuffle files that exist at once.

N-grams are told apart by 64-bit hashes: of n distinct ones about n^2 / 2^65 share a count with another.

Defined results: a null text is empty and consists of the end mark; repeated rows, also of one id, are
documents of their own; ids may be null or of any type; a text may have up to 2^28 words and is a block of its own
beyond 4 MB; an empty table gives an empty result; without training texts every score is that of unknown words, with
probability one. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from skeinlog.llm import _words
from skeinlog.llm._exchange import answer, by_part, distinct, merge, row_of, sliced, within
from skeinlog.llm._memory import released
from skeinlog.llm._tables import drop_table, write_parts, write_table

ORDER = 3
GT_MOST = 5
#: Training tokens for each part of a level's tables.
PART_TOKENS = 1_000_000
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 22
#: Ranges of parts, a power of two.
SLICES = 4
#: The hash of the end mark.
END = np.uint64(0x5851F42D4C957F2D)
_FACTOR = np.uint64(0xD1342543DE82EF95)


def discounts(n: dict[int, int], most: int = GT_MOST) -> dict[int, float]:
    """Katz's factors for counts 1 to most from the numbers n[r] of items with count r; where the counts of counts
    allow no factor in (0, 1), half a count is taken off."""
    out = {}
    common = (most + 1) * n.get(most + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, most + 1):
        d = (r - 0.5) / r
        if n.get(r) and n.get(r + 1) and common < 1:
            good = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if 0 < good < 1:
                d = good
        out[r] = d
    return out


def discounted(counts: np.ndarray, factors: dict[int, float]) -> np.ndarray:
    table = np.array([0.0, *(factors[r] * r for r in sorted(factors))])
    return np.where(counts < len(table), table[np.minimum(counts, len(table) - 1)], counts.astype(np.float64))


# --- blocks -----------------------------------------------------------------------------------------------


def extend(context: np.ndarray, word: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the n-grams of this length from those of their contexts and last words."""
    return _words.mix(context * _FACTOR + word + np.uint64(length))


class Block:
    """One row of a table of blocks."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int = 0) -> None:
        cell = lambda name: batch.column(name)[i]
        array = lambda name, kind: np.frombuffer(cell(name).as_buffer(), kind)
        self.number = cell("block").as_py()
        self.words, self.codes = array("words", np.uint64), array("codes", np.int32)
        self.known, self.logp = array("known", np.int64), array("logp", np.float64)
        self.train = cell("train").values.to_numpy(zero_copy_only=False)
        self.lengths = cell("lengths").values.to_numpy().astype(np.int64)
        self.ids = cell("ids").values
        self.tokens = self.words[self.codes]
        self.first = np.cumsum(self.lengths) - self.lengths

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: the hash of the n-gram of this length that ends with it, and that of its context."""
        grams, context, start = self.tokens, np.zeros(0, np.uint64), END
        for k in range(2, length + 1):
            context = np.concatenate([[start], grams[:-1]])
            context[self.first] = start
            grams = extend(context, self.tokens, k)
            start = extend(np.array([start]), np.array([END]), k)[0]
        return grams, context

    def level(self, length: int, part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct n-grams of this length and of one of ``parts`` ranges of hashes, in order of their hashes; a token
        at which each ends; the tokens that end one, and which; and the context of each token of the block."""
        if length == 1 and parts == 1:
            at = np.zeros(len(self.words), np.int64)
            at[self.codes] = np.arange(len(self.codes))
            return self.words, at, np.arange(len(self.codes)), self.codes, np.zeros(0, np.uint64)
        grams, context = self.grams(length)
        own = np.flatnonzero(within(grams, part, parts)) if parts > 1 else np.arange(len(grams))
        keys, at, which = distinct(grams[own])
        return keys, own[at], own, which, context


def _blocks(id_type: pa.DataType, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, train = batch.column(0).cast(id_type), batch.column(1)
            for a, b, h, offsets in _words.blocks(batch.column(2), True, BLOCK_BYTES):
                words, codes = np.unique(np.insert(h, offsets[1:], END), return_inverse=True)
                ends = pa.array([0, b - a], pa.int32())
                cells = [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(ends, ids.slice(a, b - a)),
                    pa.ListArray.from_arrays(ends, train.slice(a, b - a)),
                    pa.ListArray.from_arrays(ends, pa.array((np.diff(offsets) + 1).astype(np.int32))),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (words, codes.astype(np.int32), np.zeros(0), np.zeros(0))),
                ]
                yield pa.RecordBatch.from_arrays(cells, schema=schema)
                number += 1

    return run


# --- counting ---------------------------------------------------------------------------------------------

_SUMS = "part long, keys binary, a binary, b binary, c binary"


def _count(length: int, bits: int, part: int, parts: int, shorter: Callable):
    """Of each block: its n-grams (of one range) in training texts with their number, context, and log10 probability of the
    last word after the shorter context."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                keys, at, tokens, which, context = block.level(length, part, parts)
                n = np.bincount(which[np.repeat(block.train, block.lengths)[tokens]], minlength=len(keys))
                own = np.flatnonzero(n)
                if not len(own):
                    continue
                columns = [keys[own], n[own].astype(np.int64)]
                if length > 1:
                    columns += [context[at[own]], shorter(block)[block.level(length - 1)[3][at[own]]]]
                numbers, cells = sliced(keys[own], bits, columns)
                cells += [pa.array([b""] * len(numbers), pa.binary())] * (4 - len(cells))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *cells], names=["part", "keys", "a", "b", "c"])

    return run


_COUNTED = "kind int, part long, keys binary, n binary, context binary, q binary, stats array<long>"


def _add_counts(batches):
    """Two rows for each part: its n-grams with their counts (kind 0), and what their contexts are made of (kind 1)."""
    for part, keys, (n, context, q) in merge(batches, [np.int64, np.uint64, np.float64], [True, False, False]):
        stats = [int(n.sum()), len(n), *(int((n == r).sum()) for r in range(1, GT_MOST + 2))]
        cell = lambda a: a.tobytes()
        rows = [(0, 1), (part, part), (cell(keys), None), (cell(n), cell(n)), (None, cell(context)), (None, cell(q)), (stats, None)]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["kind", "part", "keys", "n", "context", "q", "stats"])


#: What is summed for a context: all its counts, how many of its n-grams have each discounted count, and the shorter model's share.
_CONTEXT_SUMS = GT_MOST + 2
_CONTEXT_SCHEMA = "part long, keys binary, " + ", ".join(f"s{i} binary" for i in range(_CONTEXT_SUMS))


def _sum_contexts(bits: int):
    """Of each part of the counts: what its n-grams add to their contexts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                n, context, q = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate((np.int64, np.uint64, np.float64)))
                keys, _, which = distinct(context)
                columns = [np.bincount(which, weights=w, minlength=len(keys)) for w in (n, *(n == r for r in range(1, GT_MOST + 1)), 10.0**q)]
                numbers, cells = sliced(keys, bits, [keys, *columns])
                yield pa.RecordBatch.from_arrays([pa.array(numbers), *cells], names=["part", "keys", *(f"s{j}" for j in range(_CONTEXT_SUMS))])

    return run


def _add_sums(batches):
    for part, keys, columns in merge(batches, [np.float64] * _CONTEXT_SUMS, [True] * _CONTEXT_SUMS):
        yield row_of(part, [keys, *columns], names=["part", "keys", *(f"s{j}" for j in range(_CONTEXT_SUMS))])


def weights(count: np.ndarray, kept: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts: what a discounted count is divided by, and log10 of the backoff weight. A context without any
    discounted count reserves one count."""
    whole = np.where(kept >= count * (1 - 1e-12), count + 1, count)
    return whole, np.log10(np.maximum(1 - kept / whole, 1e-300) / np.maximum(1 - share, 1e-15))


def _add_contexts(factors: dict[int, float]):
    def run(batches):
        for part, keys, (count, *often, share) in merge(batches, [np.float64] * _CONTEXT_SUMS, [True] * _CONTEXT_SUMS):
            kept = count - sum((1 - factors[r]) * r * m for r, m in enumerate(often, 1))
            yield row_of(part, [keys, *weights(count, kept, share)], names=["part", "keys", "whole", "alpha"])

    return run


# --- looking up -------------------------------------------------------------------------------------------

_ASKED = "part long, block long, kind int, keys binary, x binary, y binary"
_COUNTS, _CONTEXTS = 0, 1


def _ask(length: int, bits: int, part: int, parts: int):
    """Of each block: its distinct n-grams of this length and their distinct contexts, both of one range."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i)
                keys, _, _, _, context = block.level(length, part, parts)
                for kind, asked in ((_COUNTS, keys), (_CONTEXTS, np.unique(context[within(context, part, parts)]))):
                    if not len(asked):
                        continue
                    numbers, (cells,) = sliced(asked, bits, [asked])
                    n = len(numbers)
                    nothing = pa.nulls(n, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers), pa.array(np.full(n, block.number)), pa.array(np.full(n, kind, np.int32)), cells, nothing, nothing], names=["part", "block", "kind", "keys", "x", "y"]
                    )

    return run


def recursion(n: np.ndarray, factors: dict[int, float], whole: np.ndarray | float, alpha: np.ndarray | float, shorter: np.ndarray | float) -> np.ndarray:
    """log10 P of n-grams from their counts, their contexts' weights, and the shorter n-grams' log10 P."""
    seen = n > 0
    return np.where(seen, np.log10(np.where(seen, discounted(n, factors) / np.where(seen, whole, 1.0), 1.0)), alpha + shorter)


def _evaluate(length: int, factors: dict[int, float], shorter: Callable, finish: Callable):
    """A block and the answers to it: what ``finish`` makes of the block, its counts and log10 probabilities of this length."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.combine_chunks())
        kind, part = right.column("kind").to_numpy(), right.column("part").to_numpy()

        def values(of: int, name: str) -> np.ndarray:
            rows = np.flatnonzero(kind == of)
            cells = right.column(name).take(pa.array(rows[np.argsort(part[rows])]))
            return np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in cells])

        n = values(_COUNTS, "x").astype(np.int64)
        if length == 1:
            return finish(left, block, n, np.zeros(0), block.codes)
        _, at, _, which, context = block.level(length)
        _, _, of = distinct(context[at])
        back = shorter(block)[block.level(length - 1)[3][at]]
        return finish(left, block, n, recursion(n, factors, values(_CONTEXTS, "x")[of], values(_CONTEXTS, "y")[of], back), which)

    return run


def _as_block(schema: pa.Schema, length: int):
    def finish(left: pa.Table, block: Block, n: np.ndarray, logp: np.ndarray, _which: np.ndarray) -> pa.Table:
        known = n if length == 1 else block.known
        return pa.Table.from_arrays([*(left.column(f) for f in schema.names[:-2]), *(pa.array([a.tobytes()], pa.binary()) for a in (known, logp))], schema=schema)

    return finish


def _as_rows(schema: pa.Schema, n_all: int, v_all: int, length: int, shorter: Callable):
    """A row per text."""

    def finish(_left: pa.Table, block: Block, n: np.ndarray, logp: np.ndarray, which: np.ndarray) -> pa.Table:
        if length == 1:
            block.known = n
            logp = shorter(block)
        base = np.log10((block.known + 1) / (n_all + v_all + 1))
        sums = [np.add.reduceat(x, block.first) for x in ((block.known > 0)[block.codes].astype(np.int64), base[block.codes], logp[which])]
        columns = [block.ids, pa.array(block.train, pa.bool_()), pa.array(block.lengths), pa.array(sums[0]), pa.array(np.full(len(block.first), n_all)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(columns, schema=schema)

    return finish


# --- the model --------------------------------------------------------------------------------------------


def _write(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name, compression="zstd")


class KatzModel:
    """The tables of a model, of each n-gram length:

    counts[k]: part, keys and n (their counts);
    contexts[k], from 2: part, keys, whole (what a discounted count is divided by) and alpha (log10 of the backoff weight).
    """

    def __init__(self, order: int = ORDER, slices: int = SLICES) -> None:
        if slices & (slices - 1):
            raise ValueError("slices must be a power of two")
        self.order, self.slices, self.bits = order, slices, 1
        self.counts: dict[int, list[DataFrame]] = {}
        self.contexts: dict[int, DataFrame] = {}
        self.factors: dict[int, dict[int, float]] = {}
        self.n = self.v = 0
        self.scale, self.unknown = 1.0, 0.0

    def _slices(self, length: int) -> int:
        return self.slices if length > 1 else 1

    def _logp(self, length: int) -> Callable:
        """A function that gives a block's log10 probabilities of this length; those of words follow from their counts."""
        if length > 1:
            return lambda block: block.logp
        factors, whole, unknown = self.factors[1], max(self.n, 1) / (self.scale or 1.0), self.unknown
        return lambda block: recursion(block.known, factors, whole, 0.0, unknown)

    # --- building ---

    def _add_level(self, length: int, blocks: DataFrame) -> None:
        totals, sums = [0] * (GT_MOST + 3), []
        self.counts[length] = []
        shorter = self._logp(length - 1) if length > 1 else None
        for part in range(self._slices(length)):
            found = blocks.mapInArrow(released(_count(length, self.bits, part, self._slices(length), shorter)), _SUMS)
            counts, made = write_parts(by_part(found, _add_counts, _COUNTED), f"lm-counts-{length}-{part}", "kind", [0, 1])
            if length > 1:
                added = made.select("n", "context", "q").mapInArrow(released(_sum_contexts(self.bits)), _CONTEXT_SCHEMA)
                sums.append(_write(by_part(added, _add_sums, _CONTEXT_SCHEMA), f"lm-context-sums-{length}-{part}"))
            drop_table(made)
            own = counts.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(len(totals))]).first()
            totals = [t + (own[f"s{i}"] or 0) for i, t in enumerate(totals)]
            self.counts[length].append(counts.select("part", "keys", "n"))
        self.factors[length] = discounts({r: totals[r + 1] for r in range(1, GT_MOST + 2)})
        if length > 1:
            every = sums[0]
            for more in sums[1:]:
                every = every.unionByName(more)
            self.contexts[length] = _write(by_part(every, _add_contexts(self.factors[length]), "part long, keys binary, whole binary, alpha binary"), f"lm-contexts-{length}")
            for table in sums:
                drop_table(table)
            return
        self.n, self.v = totals[:2]
        mass = self.n - sum((1 - f) * r * totals[r + 1] for r, f in self.factors[1].items())
        # without a discounted count, one count is reserved for unknown words
        self.scale = 1.0 if self.n and mass < self.n * (1 - 1e-12) else self.n / (self.n + 1)
        self.unknown = math.log10(max(1 - self.scale * mass / self.n, 1e-300)) if self.n else 0.0

    # --- use ---

    def _answers(self, length: int, blocks: DataFrame) -> list[DataFrame]:
        """For every block: the counts of its n-grams of this length and the weights of their contexts."""
        nothing, out = F.lit(None).cast("binary"), []
        parts = self._slices(length)
        for part in range(parts):
            doubles = self.counts[length][part].mapInArrow(released(_as_doubles), "part long, keys binary, x binary")
            asked = blocks.mapInArrow(released(_ask(length, self.bits, part, parts)), _ASKED).unionByName(
                doubles.select("part", F.lit(-2).cast("long").alias("block"), F.lit(_COUNTS).alias("kind"), "keys", "x", nothing.alias("y"))
            )
            if length > 1:
                own = self.contexts[length].where(F.col("part").bitwiseAND((1 << self.bits) - (1 << self.bits) // parts) == part * ((1 << self.bits) // parts))
                asked = asked.unionByName(own.select("part", F.lit(-1).cast("long").alias("block"), F.lit(_CONTEXTS).alias("kind"), "keys", F.col("whole").alias("x"), F.col("alpha").alias("y")))
            out.append(_write(by_part(asked, answer, "block long, part long, kind int, x binary, y binary", "block"), f"lm-answers-{length}-{part}"))
        return out

    def _look_up(self, length: int, blocks: DataFrame, id_col: str) -> DataFrame:
        """The blocks with their n-grams of this length evaluated, as a new table; after the last length, a row per text."""
        answers = self._answers(length, blocks)
        every = answers[0]
        for more in answers[1:]:
            every = every.unionByName(more)
        shorter = self._logp(max(length - 1, 1))
        if length < self.order:
            schema = blocks.schema
            finish = _as_block(to_arrow_schema(schema), length)
        else:
            kind = blocks.schema["ids"].dataType.elementType
            columns = [("in_training", T.BooleanType()), *((n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
            schema = T.StructType([T.StructField("__id", kind), *(T.StructField(*c) for c in columns)])
            finish = _as_rows(to_arrow_schema(schema), self.n, self.v, length, shorter)
        run, groups, parts = _evaluate(length, self.factors[length], shorter, finish), self._slices(length), []
        for group in range(groups):
            left, right = (t.where(F.pmod("block", F.lit(groups)) == group).groupBy("block") for t in (blocks, every))
            parts.append(_write(left.cogroup(right).applyInArrow(run, schema), f"lm-blocks-{length}-{group}"))
        for table in (*answers, blocks):
            drop_table(table)
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out if length < self.order else out.withColumnRenamed("__id", id_col)

    @staticmethod
    def _tokenize(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
        rows = docs.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
        binary = [T.StructField(n, T.BinaryType()) for n in ("words", "codes", "known", "logp")]
        lists = [("ids", rows.schema["id"].dataType), ("train", T.BooleanType()), ("lengths", T.IntegerType())]
        schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(n, T.ArrayType(t)) for n, t in lists), *binary])
        return _write(rows.mapInArrow(released(_blocks(to_arrow_type(rows.schema["id"].dataType), to_arrow_schema(schema))), schema), "lm-blocks")

    def fit_and_score(self, docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Learn from the rows that ``training`` admits and score all: id, in_training, n_tokens, n_known, train_tokens,
        base_score and score (log10)."""
        blocks = self._tokenize(docs, id_col, text_col, training)
        trained = F.aggregate(F.arrays_zip("train", "lengths"), F.lit(0).cast("long"), lambda s, x: s + F.when(x["train"], x["lengths"].cast("long")).otherwise(0))
        tokens = blocks.select(F.sum(trained).alias("n")).first()["n"] or 0
        self.bits = max(4, self.slices.bit_length() - 1, (tokens // PART_TOKENS).bit_length())
        for length in range(1, self.order + 1):
            self._add_level(length, blocks)
            blocks = self._look_up(length, blocks, id_col)
        return blocks

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The same columns for other texts, from the stored tables."""
        blocks = self._tokenize(docs, id_col, text_col, F.lit(False))
        for length in range(1, self.order + 1):
            blocks = self._look_up(length, blocks, id_col)
        return blocks


def _as_doubles(batches):
    for batch in batches:
        x = pa.array([np.frombuffer(v.as_buffer(), np.int64).astype(np.float64).tobytes() for v in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x], names=["part", "keys", "x"])
