"""Removal of repeated passages with difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document. A difference cover D of a period p holds for any two
positions i and j a shift s < p such that i + s and j + s both lie in D modulo p. So two equal windows also share an
anchor, a run of ``WINDOW - p + 1`` words that starts at a cover position in both documents, and only anchors at cover
positions are hashed and shuffled (4 in 13). Anchors that occur twice are then extended: windows around them are
hashed whole (128 bits, from two independent hashes of the words), and of equal windows all but the earliest are repeats. Every word that a repeat covers goes.

Documents are laid end to end in the order of their ids, and a word's place is its number in that row (leaving room for
as many words as a text has bytes). So places are single numbers that tell both the document and the order, windows are
sorted by their hash alone, and runs of repeats come together when sorted by place.

Anchors that a bounded sketch shows to be very frequent count as repeated without being shuffled (a wrong guess
costs work, not correctness), and a block of about 2 MB of text sends only its earliest occurrence of a window, so a passage
that very many documents share is combined before the shuffle. Sorted rows are read as streams, which hold one batch
and the open row or document.

Defined results: a null text has no words; texts shorter than a window lose nothing; null ids rank after all
others; rows that repeat an id are ordered by a hash of the text, and rows that repeat both are one document
written twice, which share one result; very long texts are a block of their own; an empty table gives an empty result.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skeinlog.llm import _sketch, _words
from skeinlog.llm._memory import released
from skeinlog.llm._tables import drop_table, write_table

WINDOW = 20
#: Fixed: a perfect difference set, all residues modulo 13 are differences of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
FREQUENT, LEAST_FREQUENT = 8, 256
#: Fixed: the factor of a window's second hash.
_SECOND = 0xF1357AEA2E62A9C5
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _places(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of n words of a block: its text, its place in the text, and the words from it to the text's end."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - offsets[text]
    return text, place, lengths[text] - place


def anchors(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: hash, text and place of all anchors in texts that hold a window."""
    if len(h) < ANCHOR:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, place, left = _places(offsets, len(h))
    fine = _IN_COVER[place % PERIOD] & (left >= ANCHOR) & (left + place >= WINDOW)
    fine = np.flatnonzero(fine[: len(h) - ANCHOR + 1])
    return _words.runs(h, ANCHOR)[fine], text[fine], place[fine]


def _anchor_rows(counts, frequent: int):
    def run(batches):
        table = counts.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, _, h, offsets in _words.blocks(batch.column(1), lower=False):
                own, text, place = anchors(h, offsets)
                rare = table[_sketch.cell(own, len(table))] < frequent
                if rare.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[rare].view(np.int64)), pa.array(keys[a + text[rare]]), pa.array(place[rare].astype(np.int32))], names=["h", "k", "pos"]
                    )

    return run


def _repeated(batches):
    """Over anchors sorted by hash: those whose hash occurs more than once. Holds one batch and one row."""
    last, sent = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h, k, pos = (batch.column(i).to_numpy() for i in range(3))
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[0] = last is not None and h[0] == last[0]
        listed = same.copy()
        listed[:-1] |= same[1:]
        k_out, pos_out = k[listed], pos[listed]
        if same[0] and not sent:
            k_out, pos_out = np.concatenate([[last[1]], k_out]), np.concatenate([[last[2]], pos_out])
        if len(k_out):
            yield pa.RecordBatch.from_arrays([pa.array(k_out.astype(np.int64)), pa.array(pos_out.astype(np.int32))], names=["k", "pos"])
        last, sent = (h[-1], k[-1], pos[-1]), bool(listed[-1])


def candidate_windows(h: np.ndarray, offsets: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Starts (in the block) of windows that hold a marked anchor."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    starts = np.arange(len(h) - WINDOW + 1)
    _, _, left = _places(offsets, len(h))
    return starts[(sums[starts + PERIOD] > sums[starts]) & (left[: len(starts)] >= WINDOW)]


def _windows(counts, frequent: int):
    """Candidate windows of texts with their repeated anchors: for each window content the earliest place in the
    block, to be judged (w, w2, place); and runs of later places, which are repeats already (w is null)."""
    names = ["w", "w2", "start", "place", "n"]

    def run(batches):
        table = counts.value
        for batch in batches:
            begins, known = batch.column(0).to_numpy(), batch.column(2)
            for a, b, h, offsets, *words in _words.blocks_with_bytes(batch.column(1), lower=False):
                marked = np.zeros(len(h), bool)
                own, text, place = anchors(h, offsets)
                often = table[_sketch.cell(own, len(table))] >= frequent
                marked[offsets[text[often]] + place[often]] = True
                part = known.slice(a, b - a)
                values = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                inside = values < np.repeat(np.diff(offsets), sizes)  # rows of one hash are listed together
                marked[(np.repeat(offsets[:-1], sizes) + values)[inside]] = True
                starts = candidate_windows(h, offsets, marked)
                if not len(starts):
                    continue
                w, w2 = (_words.runs(x, WINDOW, *f)[starts].view(np.int64) for x, f in ((h, ()), (_words.hashes(*words, family=1), (_SECOND,))))
                text = np.searchsorted(offsets, starts, side="right") - 1
                begin = begins[a + text]
                place = begin + starts - offsets[text]
                sort, head, first = _earliest(w, w2, place)
                w, w2, begin, place = w[sort], w2[sort], begin[sort], place[sort]
                later = ~first & (place != place[head])
                n = int(first.sum())
                yield pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(w2[first]), pa.array(begin[first]), pa.array(place[first]), pa.array(np.ones(n, np.int32))], names=names)
                if later.any():
                    sort = np.argsort(place[later])
                    begin, place = begin[later][sort], place[later][sort]
                    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1]))
                    n = np.diff(np.append(at, len(place))).astype(np.int32)
                    nothing = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(begin[at]), pa.array(place[at]), pa.array(n)], names=names)

    return run


def _earliest(w: np.ndarray, w2: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by content and then place; for each row of it the first of its content, and which are first."""
    sort = np.lexsort((place, w))
    same = w[sort][1:] == w[sort][:-1]
    if (same & (w2[sort][1:] != w2[sort][:-1])).any():
        sort = np.lexsort((place, w2, w))
        same = (w[sort][1:] == w[sort][:-1]) & (w2[sort][1:] == w2[sort][:-1])
    first = np.concatenate([[True], ~same])
    return sort, np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)), first


def _judge(batches):
    """Over windows sorted by w: all places but the earliest of each content; known repeats pass through. Holds one batch
    and the earliest places of the contents with the last w."""
    held = None
    for batch in batches:
        known = pc.is_null(batch.column("w"))
        passed = batch.filter(known)
        if passed.num_rows:
            yield passed.select(["start", "place", "n"])
        rows = batch.filter(pc.invert(known))
        if not rows.num_rows:
            continue
        w, w2, begin, place = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("w", "w2", "start", "place"))
        if held is not None:
            w, w2, begin, place = (np.concatenate(c) for c in zip(held, (w, w2, begin, place), strict=True))
        sort, head, first = _earliest(w, w2, place)
        w, w2, begin, place = w[sort], w2[sort], begin[sort], place[sort]
        later = ~first & (place != place[head])
        n = int(later.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(begin[later]), pa.array(place[later]), pa.array(np.ones(n, np.int32))], names=["start", "place", "n"])
        last = first & (w == w[-1])
        held = w[last], w2[last], begin[last], place[last]


def _gather(batches):
    """Over runs of repeated windows sorted by place: the words that they cover, as ranges, a row for each document. Holds one
    batch and the ranges of one document."""
    held = None

    def out(begin, lo, hi):
        at = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1]]))
        offsets = pa.array(np.append(at, len(begin)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array((x - begin).astype(np.int32))) for x in (lo, hi)]
        return pa.RecordBatch.from_arrays([pa.array(begin[at]), *lists], names=["start", "from", "to"])

    for batch in batches:
        if not batch.num_rows:
            continue
        begin, lo, n = (batch.column(c).to_numpy() for c in range(3))
        hi = lo + n + (WINDOW - 1)
        if held is not None:
            begin, lo, hi = (np.concatenate(c) for c in zip(held, (begin, lo, hi), strict=True))
        # no range reaches the next document's first place, so one running maximum serves all
        reach = np.maximum.accumulate(hi)
        at = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
        begin, lo, hi = begin[at], lo[at], reach[np.append(at[1:], len(reach)) - 1]
        done = int(np.searchsorted(begin, begin[-1]))  # documents come in the order of their first places
        if done:
            yield out(begin[:done], lo[:done], hi[:done])
        held = begin[done:], lo[done:], hi[done:]
    if held is not None:
        yield out(*held)


def _cut(id_type: pa.DataType):
    def run(batches):
        span = pa.struct([("from", pa.int32()), ("to", pa.int32())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, n_removed, removed, kept = [], [], [], []
                for text, lo, hi in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    n_words.append(len(words))
                    ranges = list(zip(lo or [], hi or [], strict=True))
                    removed.append([{"from": x, "to": y} for x, y in ranges])
                    n_removed.append(sum(y - x for x, y in ranges))
                    if ranges:
                        edges = [0, *(e for r in ranges for e in r), len(words)]
                        words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())],
                    names=["__id", "n_words", "n_removed", "removed", "kept_text"],
                )

    return run


def _in_order(batches):
    """Of documents sorted by id: the room that those before them in this task take up."""
    before, task = 0, TaskContext.get().partitionId()
    for batch in batches:
        room = batch.column("room").to_numpy()
        ends = before + np.cumsum(room)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("k"), pa.array(ends - room), pa.array(np.full(len(room), task, np.int32)), pa.array(ends)], names=["__id", "k", "before", "task", "upto"])
        before = int(ends[-1]) if len(ends) else before


def first_places(rows: DataFrame, partitions: int) -> DataFrame:
    """(__id, k, start): each document's first place. The driver sums one number per task."""
    id_sql = rows.schema["__id"].dataType.simpleString()
    sizes = rows.groupBy("__id", "k").agg(F.max(F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long") + 1).alias("room"))
    sizes = write_table(sizes, "repeat-sizes")
    order = [F.col("__id").asc_nulls_last(), F.col("k").asc()]
    ordered = sizes.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = write_table(ordered.mapInArrow(released(_in_order), f"__id {id_sql}, k long, before long, task int, upto long"), "repeat-order")
    drop_table(sizes)
    ends = {r["task"]: r["n"] for r in placed.groupBy("task").agg(F.max("upto").alias("n")).collect()}
    sums, at = [], 0
    for task in sorted(ends):
        sums.append((task, at))
        at += ends[task]
    offsets = rows.sparkSession.createDataFrame(sums, "task int, offset long")
    return placed.join(F.broadcast(offsets), "task").select("__id", "k", (F.col("before") + F.col("offset")).alias("start"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``removed`` (word ranges, end exclusive) and
    ``kept_text``, the words that stay joined by one space."""
    spark = docs.sparkSession
    id_field = docs.select(id_col).schema[0]
    kind, id_sql = to_arrow_type(id_field.dataType), id_field.dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).alias("__text"))

    def anchor_hashes(batch: pa.RecordBatch):
        for _, _, h, offsets in _words.blocks(batch.column(0), lower=False):
            yield anchors(h, offsets)[0]

    def with_text(table: DataFrame, *columns: str) -> DataFrame:
        other = table.select(F.col("__id").alias("__other"), F.col("k").alias("__k"), *columns)
        return rows.join(other, (F.col("k") == F.col("__k")) & F.col("__id").eqNullSafe(F.col("__other")), "left")

    counts = _sketch.build(rows.select("__text"), anchor_hashes)
    frequent = max(LEAST_FREQUENT, int(FREQUENT * counts.mean()))
    shared = spark.sparkContext.broadcast(counts)
    found = rows.select("k", "__text").mapInArrow(released(_anchor_rows(shared, frequent)), "h long, k long, pos int")
    found = found.repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(released(_repeated), "k long, pos int")
    repeated = write_table(found.groupBy("k").agg(F.collect_list("pos").alias("places")), "repeat-anchors")
    starts = first_places(rows, partitions)
    listed = write_table(starts.join(repeated, "k", "left"), "repeat-listed")
    drop_table(repeated)
    windows = with_text(listed, "start", "places").select("start", "__text", "places")
    windows = windows.mapInArrow(released(_windows(shared, frequent)), "w long, w2 long, start long, place long, n int")
    windows = windows.repartition(partitions, F.coalesce("w", "start")).sortWithinPartitions("w")
    judged = windows.mapInArrow(released(_judge), "start long, place long, n int")
    gathered = judged.repartition(partitions, "start").sortWithinPartitions("place")
    gathered = write_table(gathered.mapInArrow(released(_gather), "start long, from array<int>, to array<int>"), "repeat-ranges")
    ranges = gathered.join(listed.select("__id", "k", "start"), "start")
    out = with_text(ranges, "from", "to").select("__id", "__text", "from", "to")
    out = out.mapInArrow(released(_cut(kind)), f"__id {id_sql}, n_words long, n_removed long, removed array<struct<from:int,to:int>>, kept_text string")
    return out.withColumnRenamed("__id", id_col)
