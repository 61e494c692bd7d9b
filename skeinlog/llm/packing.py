"""Best-fit packing of token sequences by large-item matching.

Only a histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. On it the packing is
planned for runs of equal lengths at once: pieces above a third of the capacity are matched greedily, longest
first with the longest partner that fits, so a sequence holds at most two of them; shorter pieces then go,
longest first, into the smallest gap that takes them. The plan says for each length which ranks go to which
sequences. Every piece gets its rank among the pieces of its length by counting, and looks its place up.

Defined results: a null or empty text is the single end id; repeated rows are packed each; an empty table gives
an empty result. A text with the tokenizer's special strings gets the ids the tokenizer gives it.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm._memory import released
from skeinlog.llm._tables import write_table

CAPACITY = 2048
END_ID = 0


# --- the plan ---------------------------------------------------------------------------------------------


class _Gaps:
    """Open sequences by free room; sequences of equal room are kept as runs of consecutive numbers."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in self.runs:
            self.runs[room] = []
            bisect.insort(self.rooms, room)
        self.runs[room].append((first, n))

    def smallest(self, least: int) -> int | None:
        at = bisect.bisect_left(self.rooms, least)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[int, int]:
        """At most ``most`` sequences of one run with this room."""
        first, n = self.runs[room].pop()
        if n > most:
            self.runs[room].append((first + most, n - most))
            n = most
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.remove(room)
        return first, n


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, pieces per sequence, offset), sorted by length and rank.

    ``counts`` has the number of pieces of each length. The piece of rank r in a row goes to sequence
    ``first sequence + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must lie in 1..capacity")
    placed = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps, opened = _Gaps(), 0

    def put(length: int, pieces: int, sequence: int, per: int, offset: int) -> None:
        rows.append((length, placed[length], pieces, sequence, per, offset))
        placed[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            partner = None
            at = bisect.bisect_right(large, capacity - n) - 1
            while at >= 0:
                if left[large[at]] > (large[at] == n):
                    partner = large[at]
                    break
                at -= 1
            if partner is None:
                m = left[n]
                put(n, m, opened, 1, 0)
                gaps.add(capacity - n, opened, m)
            else:
                m = left[n] // 2 if partner == n else min(left[n], left[partner])
                put(n, m, opened, 1, 0)
                put(partner, m, opened, 1, n)
                gaps.add(capacity - n - partner, opened, m)
            opened += m
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            room = gaps.smallest(n)
            if room is None:
                per = min(capacity // n, left[n])
                m = left[n] // per
                put(n, m * per, opened, per, 0)
                gaps.add(capacity - per * n, opened, m)
                opened += m
            else:
                per = min(room // n, left[n])
                first, m = gaps.take(room, left[n] // per)
                put(n, m * per, first, per, capacity - room)
                gaps.add(room - per * n, first, m)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def look_up(plan: np.ndarray, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces with these lengths and ranks."""
    keys = plan[:, 0] * (1 << 44) + plan[:, 1]
    row = plan[np.searchsorted(keys, lengths * (1 << 44) + ranks, side="right") - 1]
    past = ranks - row[:, 1]
    return row[:, 3] + past // row[:, 4], row[:, 5] + past % row[:, 4] * lengths


# --- tokens -----------------------------------------------------------------------------------------------

#: Fixed: the printable stand-ins of a byte-level vocabulary.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


def is_plain(spec: dict) -> bool:
    """Whether a vocabulary file is byte-level with the usual split, unnormalised, and ranks its merges by their ids; then
    merging by rank gives the ids that the ``tokenizers`` library gives."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or odd or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return all(x < y for x, y in zip([max(model["vocab"].get(c, -1) for c in _byte_of()), *made], made, strict=False)) and all(c in model["vocab"] for c in _byte_of())


class Encoder:
    """Ids of a vocabulary file (JSON of the ``tokenizers`` library).

    The merges of a plain byte-level vocabulary run in ``tiktoken``, which gives the same ids several times faster. Texts
    that hold one of the file's added strings, and files of other kinds, are left to ``tokenizers`` itself.
    """

    #: Fixed: the split pattern of byte-level vocabularies.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self._exact, self._fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        if is_plain(spec):
            byte_of = _byte_of()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.added}
            self._fast = tiktoken.Encoding("pieces", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def ids(self, text: str) -> list[int]:
        if self._fast is None or any(a in text for a in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenize(tokenizer: str, capacity: int, keep_ids: bool, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                names, out = ["__id", "piece", "start", "length", "ids_crc32", "__part", "__rank", "ids"], []
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], np.uint32)
                    for i, (start, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + n].astype("<u4")
                        rank = seen.get(n, 0)
                        seen[n] = rank + 1
                        out.append((doc, i, start, n, zlib.crc32(own.tobytes()), part, rank, own.astype(np.int32) if keep_ids else None))
                columns = list(zip(*out, strict=True))
                kinds = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _place(plan: np.ndarray, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = look_up(plan, lengths, ranks)
            kept = [n for n in batch.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if kept.

    Texts are tokenized once, without a shuffle, into a table in the shared folder. The ranks come from counts per
    (task, length), so no length's pieces ever meet in one task.
    """
    id_field = docs.select(id_col).schema[0]
    schema = f"__id {id_field.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, __part int, __rank long, ids array<int>"
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(id_field.dataType)
    pieces = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    pieces = write_table(pieces.mapInArrow(released(_tokenize(tokenizer, capacity, keep_ids, kind)), schema), "packing-pieces")
    counts = write_table(pieces.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", "length", F.coalesce(before, F.lit(0)).alias("__before"))
    columns = ["__id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = pieces.join(offsets, ["__part", "length"]).select(*columns, (F.col("__rank") + F.col("__before")).alias("__rank"))
    out_schema = f"__id {id_field.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, {'ids array<int>, ' if keep_ids else ''}sequence_id long, offset long"
    return ranked.mapInArrow(released(_place(plan, kind)), out_schema).withColumnRenamed("__id", id_col)
