"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of word n-grams. Sets are ordered by the number of texts that hold each n-gram, rarest first, and two
sets can only be similar enough if their prefixes share an n-gram; so prefixes are joined on n-grams, candidates pass the
length and positional filters, and each pair is verified once on its whole sets, after a suffix filter. The numbers are counted
over all texts: blocks of texts send each of their n-grams once to the part of a table that its hash names, and are answered
with the sums (``_exchange``). N-grams of one text only keep their places but are never sent.

Groups are linked without forming all of their pairs. Equal sets are one node from the start. In the sorted list
of a prefix n-gram, each entry is first paired with the list's first entry of fitting length and with its
predecessor only. Verified links give components. Lists that still hold several components are put in a new, hashed
order, and entries of different components a few places apart are paired, twice with a growing reach, so that sparse
groups merge at a cost in proportion to their size. What then remains are the pairs between different components,
and all of these are formed and verified, so no link that could join two components is lost. Sets are named by 64 bits, and 64
more are compared once: should two different sets share a name, all names are drawn anew. There an entry names the
few listed n-grams before it, and two entries that name a common one are passed over: their pair has been formed, or
ruled out, at that n-gram. The lists of very frequent n-grams are dealt over several tasks by a salt.

Defined results: a null text or one without words has an empty set and links with nothing; fewer than ``n`` words
are one n-gram; repeated rows and equal sets share a component; very long texts are taken whole; an empty table gives an
empty result; a component is named by its smallest id (null ids rank after all numbers). Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinlog.llm import _words
from skeinlog.llm._exchange import answer, by_part, distinct, merge, row_of, sliced
from skeinlog.llm._graph import components
from skeinlog.llm._memory import released
from skeinlog.llm._tables import drop_table, write_table

SHINGLE = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: N-grams for each part of the table of counts.
PART_GRAMS = 1_000_000
#: Entries of a list for each task that it is dealt to.
SALT_ROWS = 50_000
BROADCAST_IDS = 500_000
#: Places apart in a list that the rounds before the last look at: 8, then 32.
FIRST_WIDTH, LAST_WIDTH = 8, 32
#: How many of a set's earlier listed n-grams an entry names in the last join.
RECENT = 8


# --- sets -------------------------------------------------------------------------------------------------


def sets_of(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    for a, b, h, offsets in _words.blocks(texts, lower=True):
        grams = _words.runs(h, n)
        for i in range(b - a):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            yield np.unique(grams[lo : hi - n + 1] if hi - lo >= n else _words.runs(h[lo:hi], hi - lo)) if hi > lo else h[:0]


def set_key(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """128 bits that stand for a set: its key, and what tells it from another set with that key."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(16, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(a, b, percent: int = PERCENT):
    """Smallest intersection with 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def rare_first(s: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The order of a set's n-grams by the number of texts that hold each, and then by hash."""
    return np.lexsort((s, texts))


def signature(s: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each slice of the hash range, 255 standing for 255 and more; 256 slices, or as
    many as a quarter of a larger set."""
    bits = max(8, (len(s) // 4).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def suffix_bound(x: bytes, y: bytes) -> float:
    """An upper bound of the intersection of the sets with these signatures: in no slice of the hash range can they
    share more than the smaller slice holds. A full slice bounds nothing."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    if a.max() == 255 or b.max() == 255:
        return float("inf")
    if len(a) < len(b):
        b = b.reshape(len(a), -1).sum(1, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    need = least_overlap(len(a), len(b), percent)
    return min(len(a), len(b)) >= need and len(np.intersect1d(a, b, assume_unique=True)) >= need


# --- tasks ------------------------------------------------------------------------------------------------


def _blocks(n: int, seed: int, schema: pa.Schema):
    """Rows of about 2 MB of text: ids, texts, and each text's set size, key, check and signature. A text whose set this task
    has had before is left out (null)."""

    def run(batches):
        number, seen = TaskContext.get().partitionId() << 32, set()
        for batch in batches:
            texts = batch.column(1)
            for a, b, *_ in _words.blocks(texts, lower=True):
                part = texts.slice(a, b - a)
                sets = [(len(s), *set_key(s, seed), signature(s)) if len(s) else (0, None, None, None) for s in sets_of(part, n)]
                fresh = []
                for size, *key, _ in sets:
                    fresh.append(size > 0 and tuple(key) not in seen)
                    if fresh[-1]:
                        seen.add(tuple(key))
                if len(seen) > 200_000:
                    seen.clear()
                ends = pa.array([0, b - a], pa.int32())
                lists = [batch.column(0).slice(a, b - a), part.take(pa.array(np.arange(b - a), mask=~np.array(fresh, bool)))]
                lists += [pa.array([s[i] for s in sets], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in lists)], schema=schema)
                number += 1

    return run


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block's texts in order, and how many of its sets hold each."""
    sets = list(sets_of(texts, n))
    return np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _count(n: int, bits: int):
    def run(batches):
        for batch in batches:
            for texts in batch.column(0):
                keys, number = _grams(texts.values, n)
                if len(keys):
                    parts, cells = sliced(keys, bits, [keys, number.astype(np.float64)])
                    yield pa.RecordBatch.from_arrays([pa.array(parts), *cells], names=["part", "keys", "x"])

    return run


def _shared(batches):
    """Of each part: the n-grams that more than one text holds, and how many hold each."""
    for part, keys, (number,) in merge(batches, [np.float64], [True]):
        yield row_of(part, [keys[number > 1], number[number > 1]], names=["part", "keys", "x"])


def _ask(n: int, bits: int):
    def run(batches):
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, _ = _grams(texts.values, n)
                if len(keys):
                    parts, (cells,) = sliced(keys, bits, [keys])
                    k = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts), pa.array(np.full(k, block)), pa.array(np.zeros(k, np.int32)), cells, pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())],
                        names=["part", "block", "kind", "keys", "x", "y"],
                    )

    return run


def _postings(n: int, percent: int, salt_rows: int, schema: pa.Schema):
    """A block and the answers to it: the prefix entries of its sets whose n-grams other texts hold as well."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, sids = (left.column(c).combine_chunks().values for c in ("texts", "sids"))
        sets = list(sets_of(texts, n))
        sizes = np.array([len(s) for s in sets])
        _, _, which = distinct(np.concatenate(sets))
        cells = right.column("x").take(pa.array(np.argsort(right.column("part").to_numpy())))
        number = np.concatenate([np.zeros(0), *(np.frombuffer(v.as_buffer(), np.float64) for v in cells)])
        held = number[which]
        common = held > 1
        before = np.concatenate([[0], np.cumsum(common)])
        ends = np.cumsum(sizes)
        alone = sizes - (before[ends] - before[ends - sizes])  # n-grams of one text only, which come first
        out: list[list[np.ndarray]] = [[np.zeros(0, f.type.to_pandas_dtype())] for f in schema]
        keys = sids.to_pylist()
        for i in np.flatnonzero((sizes > 0) & (alone < prefix_length(sizes, percent))).tolist():
            own = slice(ends[i] - sizes[i], ends[i])
            rest, texts_of = sets[i][common[own]], held[own][common[own]]
            order = rare_first(rest, texts_of)[: prefix_length(len(sets[i]), percent) - alone[i]]
            spread = texts_of[order].astype(np.int64) // salt_rows + 1
            salt = np.where(spread > 1, 1 + keys[i] % spread, 0)
            k = len(order)
            for column, value in zip(out, (rest[order].view(np.int64), np.full(k, keys[i]), np.full(k, sizes[i]), alone[i] + np.arange(k), salt), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(np.concatenate(c).astype(f.type.to_pandas_dtype())) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _fits(n1, p1, n2, p2, percent: int, before=None):
    """Length and positional filter of entries at places p1, p2 in sets of sizes n1 <= n2: what both can share before
    the n-gram (``before``, else the smaller place), itself, and the shorter rest bound the intersection."""
    bound = (np.minimum(p1, p2) if before is None else before) + np.minimum(n1 - p1, n2 - p2)
    return (100 * n1 >= percent * n2) & (bound >= least_overlap(n1, n2, percent))


def _stream(percent: int, keep_lists: bool):
    """Over entries sorted by (h, salt, n, sid): candidate pairs of each entry with its predecessor in the list and
    with the list's hub, which is the first entry and moves on when sizes grow out of its reach; and, if wanted, the
    entries of lists that have more than one. Holds one batch and two entries, however long a list is."""

    def run(batches):
        prev, hub, listed_prev = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt, sid, n, pos = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "salt", "sid", "n", "pos"))
            before = [np.concatenate([[c[0] if prev is None else prev[i]], c[:-1]]) for i, c in enumerate((h, salt, sid, n, pos))]
            same = (h == before[0]) & (salt == before[1])
            if prev is None:
                same[0] = False
            chain = same & _fits(before[3], before[4], n, pos, percent)
            a, b = [before[2][chain]], [sid[chain]]
            starts = np.unique(np.concatenate([[0], np.flatnonzero(~same)]))
            ends = np.concatenate([starts[1:], [len(h)]])
            goes_on = bool(same[0])
            for k in np.flatnonzero((ends - starts > 2) | ((starts == 0) & goes_on) | (ends == len(h))).tolist():
                at, end = int(starts[k]), int(ends[k])
                if not (k == 0 and goes_on):
                    hub = (sid[at], n[at], pos[at])
                    at += 1
                while at < end:
                    reach = at + int(np.searchsorted(percent * n[at:end], 100 * hub[1], side="right"))
                    ok = _fits(hub[1], hub[2], n[at:reach], pos[at:reach], percent)
                    b.append(sid[at:reach][ok])
                    a.append(np.full(len(b[-1]), hub[0]))
                    if reach < end:
                        hub = (sid[reach], n[reach], pos[reach])
                    at = reach + 1
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
            if len(pairs):
                none = pa.nulls(len(pairs), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), none, none], names=["a", "b", "h", "n", "pos"])
            if keep_lists:
                follows = np.concatenate([same[1:], [False]])
                listed = same | follows | (salt > 0)
                once = listed & ~(same & (sid == before[2]))  # a set that several tasks have sent stands next to itself
                rows = [c[once] for c in (sid, h, n, pos)]
                if goes_on and not listed_prev:
                    rows = [np.concatenate([[prev[i]], c]) for i, c in zip((2, 0, 3, 4), rows, strict=True)]
                if len(rows[0]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[0]), pa.nulls(len(rows[0]), pa.int64()), pa.array(rows[1]), pa.array(rows[2].astype(np.int32)), pa.array(rows[3].astype(np.int32))],
                        names=["a", "b", "h", "n", "pos"],
                    )
                listed_prev = bool(listed[-1])
            prev = (h[-1], salt[-1], sid[-1], n[-1], pos[-1])

    return run


def _neighbours(percent: int, width: int):
    """Over entries sorted by (h, order): pairs of entries of different components that stand at most ``width``
    places apart in one list. Holds one batch and ``width`` entries."""
    names = ("h", "comp", "sid", "n", "pos", "before", "share")

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            fresh = 0 if kept is None else len(kept[0])  # pairs among the kept entries were formed before
            if kept is not None:
                columns = [np.concatenate([k, c]) for k, c in zip(kept, columns, strict=True)]
            h, comp, sid, n, pos, before, share = columns
            found = []
            for d in range(1, min(width, len(h) - 1) + 1):
                lo = max(0, fresh - d)
                i, j = slice(lo, len(h) - d), slice(lo + d, len(h))
                ok = (h[i] == h[j]) & (share[i] == share[j]) & (comp[i] != comp[j])
                if ok.any():
                    x, y = np.flatnonzero(ok) + lo, np.flatnonzero(ok) + lo + d
                    x, y = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
                    fine = _fits(n[x], pos[x], n[y], pos[y], percent, np.minimum(before[x], before[y]))
                    found.append(np.stack([np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])], 1)[fine])
            kept = [c[-width:] for c in columns]
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


_CANDIDATES = "a long, b long, h long, n int, pos int"


def _sets(n: int, seed: int):
    """The sets of documents that a verification needs, as (sid, set)."""

    def run(batches):
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            sids, blobs, size = [], [], 0
            for sid, s in zip(wanted, sets_of(batch.column(0), n), strict=True):
                if len(s) and set_key(s, seed)[0] == sid:
                    sids.append(sid)
                    blobs.append(s.tobytes())
                    size += len(blobs[-1])
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], names=["sid", "grams"])
                        sids, blobs, size = [], [], 0
            if sids:
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(blobs, pa.binary())], names=["sid", "grams"])

    return run


def _suffix_filter(percent: int):
    """Pairs (a, b) whose signatures leave room for enough shared n-grams."""

    def run(batches):
        for batch in batches:
            need = least_overlap(0, batch.column("nx").to_numpy() + batch.column("ny").to_numpy(), percent).tolist()
            marks = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), need, strict=True)
            keep = pa.array([suffix_bound(x, y) >= n for x, y, n in marks], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


# --- the join ---------------------------------------------------------------------------------------------


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> None:
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        self.labels: DataFrame | None = None
        self.docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        self.seed = 0
        while not self._read():  # two different sets with one key: all keys are drawn anew
            self.seed += 1

    def _read(self) -> bool:
        """Write blocks, members and nodes; whether no two different sets have the same key."""
        lists = [("ids", self.docs.schema[0].dataType), ("texts", T.StringType()), ("ns", T.LongType()), ("sids", T.LongType()), ("checks", T.LongType()), ("marks", T.BinaryType())]
        schema = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(name, T.ArrayType(t)) for name, t in lists)])
        self.blocks = write_table(self.docs.mapInArrow(released(_blocks(self.n, self.seed, to_arrow_schema(schema))), schema), "ngram-blocks", compression="zstd")
        members = self.blocks.select(F.inline(F.arrays_zip("ids", "ns", "sids", "checks", "marks"))).toDF("__id", "n", "sid", "check", "mark")
        self.members = write_table(members, "ngram-members")
        nodes = self.members.where("sid is not null").groupBy("sid")
        told = (F.min("check") != F.max("check")).alias("shared")
        self.nodes = write_table(nodes.agg(F.min("__id").alias("least"), F.max("n").alias("n"), F.max("mark").alias("mark"), told), "ngram-nodes")
        return self.nodes.where("shared").isEmpty()

    def suffix_filter(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a written table) that the signatures of their sets allow."""
        marks = self.nodes.select("sid", "n", "mark")
        both = pairs.join(marks.select(F.col("sid").alias("a"), F.col("n").alias("nx"), F.col("mark").alias("x")), "a").join(
            marks.select(F.col("sid").alias("b"), F.col("n").alias("ny"), F.col("mark").alias("y")), "b"
        )
        return write_table(both.select("a", "b", "nx", "ny", "x", "y").mapInArrow(released(_suffix_filter(self.percent)), "a long, b long"), "ngram-filtered")

    def settle(self, pairs: DataFrame) -> bool:
        """Verify candidate pairs (a written table) as far as they can join components; whether any did.

        The first pass takes each set's smallest partner only, which makes stars of groups that are alike throughout; the
        second takes all pairs whose ends are still apart.
        """
        pairs = self.suffix_filter(pairs)
        first = write_table(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "ngram-first")
        joined = self._link(first)
        apart = pairs.join(first, ["a", "b"], "left_anti")
        if self.labels is not None:
            for end in ("a", "b"):
                apart = apart.join(self.labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
            apart = apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        apart = write_table(apart.select("a", "b"), "ngram-apart")
        joined = self._link(apart) or joined
        for t in (pairs, first, apart):
            drop_table(t)
        return joined

    def _link(self, pairs: DataFrame) -> bool:
        links = self.verify(pairs)
        if links is None or links.isEmpty():
            return False
        if self.labels is None:
            self.labels = components(links)
            return True
        # go on from the components found before: links between these, and to nodes that had none
        old, ends = self.labels, links
        for end in ("a", "b"):
            ends = ends.join(old.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = components(write_table(ends.where("a <> b").distinct(), "ngram-ends"))
        moved = old.join(merged.select(F.col("node").alias("component"), F.col("component").alias("__to")), "component", "left")
        moved = moved.select("node", F.coalesce("__to", "component").alias("component"))
        self.labels = write_table(moved.unionByName(merged.join(old, "node", "left_anti")), "ngram-labels")
        return True

    def verify(self, pairs: DataFrame) -> DataFrame | None:
        """The links among ``pairs`` (a written table). Each pair is looked at once, on whole sets, which are made
        again for the documents concerned only."""
        needed = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        picks = write_table(self.nodes.join(needed, "sid", "left_semi").select("sid", F.col("least").alias("__pick")), "ngram-picks")
        if picks.isEmpty():
            return None
        few = picks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        side = F.broadcast(picks) if few else picks
        texts = self.docs.join(side, F.col("__id").eqNullSafe(F.col("__pick"))).select("__text", "sid")
        sets = write_table(texts.mapInArrow(released(_sets(self.n, self.seed)), "sid long, grams binary").dropDuplicates(["sid"]), "ngram-sets")
        both = (
            pairs.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b")
            .select("a", "b", "x", "y")
        )
        links = write_table(both.mapInArrow(released(_verify(self.percent)), "a long, b long"), "ngram-links")
        drop_table(sets)
        drop_table(picks)
        return links

    def _entries(self) -> DataFrame:
        """The prefix entries of all sets, as (h, sid, n, pos, salt)."""
        total = self.members.agg(F.sum("n").alias("n")).first()["n"] or 0
        bits = max(4, (total // PART_GRAMS).bit_length())
        nothing = F.lit(None).cast("binary")
        blocks = self.blocks.select("block", "texts", "sids")
        counted = by_part(blocks.select("texts").mapInArrow(released(_count(self.n, bits)), "part long, keys binary, x binary"), _shared, "part long, keys binary, x binary")
        counted = write_table(counted, "ngram-counts", compression="zstd")
        asked = blocks.select("block", "texts").mapInArrow(released(_ask(self.n, bits)), "part long, block long, kind int, keys binary, x binary, y binary").unionByName(
            counted.select("part", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), "keys", "x", nothing.alias("y"))
        )
        answers = write_table(by_part(asked, answer, "block long, part long, kind int, x binary, y binary", "block"), "ngram-answers", compression="zstd")
        drop_table(counted)
        schema = T.StructType([T.StructField(c, t) for c, t in zip(("h", "sid", "n", "pos", "salt"), (T.LongType(), T.LongType(), *[T.IntegerType()] * 3), strict=True)])
        run = _postings(self.n, self.percent, SALT_ROWS, to_arrow_schema(schema))
        entries = write_table(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema), "ngram-entries", compression="zstd")
        drop_table(answers)
        drop_table(self.blocks)
        return entries

    def run(self) -> DataFrame | None:
        """(node, component) over set keys with a link to another set; None if there is no link at all."""
        percent = self.percent
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        entries = self._entries()
        ordered = entries.repartition(partitions, "h", "salt").sortWithinPartitions("h", "salt", "n", "sid")
        found = write_table(ordered.mapInArrow(released(_stream(percent, True)), _CANDIDATES), "ngram-candidates")
        lists = found.where("h is not null").select("h", F.col("a").alias("sid"), "n", "pos")
        done = write_table(found.where("h is null").select("a", "b").distinct(), "ngram-pairs")
        more = self.settle(done)
        width = FIRST_WIDTH
        while True:
            labels = self.labels if self.labels is not None else self.spark.createDataFrame([], "node long, component long")
            placed = lists.join(labels.select(F.col("node").alias("sid"), "component"), "sid", "left")
            placed = write_table(placed.select("h", F.coalesce("component", "sid").alias("comp"), "sid", "n", "pos"), "ngram-placed")
            mixed = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("h", "size")
            mixed = write_table(mixed, "ngram-mixed")
            # an n-gram that two sets of different components share before this place is in such a list as well
            earlier = F.row_number().over(Window.partitionBy("sid").orderBy("pos")) - 1
            rows = placed.join(mixed, "h").withColumn("before", earlier)
            last = width > LAST_WIDTH or not more
            if last:
                rows = rows.withColumn("recent", F.collect_list("h").over(Window.partitionBy("sid").orderBy("pos").rowsBetween(-RECENT, -1)))
            rows = write_table(rows, "ngram-open")
            drop_table(placed)
            if last:
                break
            # a long list is dealt over several tasks; what stands next to each other in one of them is paired
            order = F.xxhash64("sid", F.lit(width))
            shuffled = rows.withColumns({"order": order, "share": F.pmod(F.shiftright(order, 8), F.expr(f"size div {SALT_ROWS} + 1"))})
            ordered = shuffled.repartition(partitions, "h", "share").sortWithinPartitions("h", "share", "order")
            fresh = ordered.mapInArrow(released(_neighbours(percent, width)), "a long, b long").distinct()
            fresh = write_table(fresh.join(done, ["a", "b"], "left_anti"), "ngram-pairs")
            lists = rows.select("h", "sid", "n", "pos")  # components only merge, so no other list can be mixed again
            more = self.settle(fresh)
            done = done.unionByName(fresh)
            width *= 4
        # what is left: pairs of different components that share a prefix n-gram
        x, y = rows.alias("x"), rows.alias("y")
        small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
        bound = F.least("x.before", "y.before") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        rest = x.join(
            y,
            (F.col("x.h") == F.col("y.h"))
            & (F.col("x.comp") < F.col("y.comp"))
            & (100 * small >= percent * large)
            & (bound * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))
            & ~F.arrays_overlap("x.recent", "y.recent"),
        ).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
        rest = write_table(rest.distinct().join(done, ["a", "b"], "left_anti"), "ngram-rest")
        self.settle(rest)
        return self.labels


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, ``n_shingles`` and ``component_id``, the smallest id that similarity links reach."""
    join = _Join(docs, id_col, text_col, n, percent)
    labels = join.run()
    if labels is None:
        labels = join.spark.createDataFrame([], "node long, component long")
    # a node's component carries over to all documents with that set; documents without words stay alone
    named = write_table(join.nodes.join(labels.select(F.col("node").alias("sid"), "component"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("comp")), "ngram-named")
    least = write_table(named.groupBy("comp").agg(F.min("least").alias("component_id")), "ngram-least")
    by_set = write_table(named.join(least, "comp").select("sid", "component_id"), "ngram-names")
    own = F.coalesce("sid", F.xxhash64("__id"))  # documents without words spread over all tasks and match nothing
    rows = join.members.drop("mark", "check").withColumn("__key", own).join(by_set.withColumnRenamed("sid", "__key"), "__key", "left")
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("__id")).otherwise(F.col("component_id")).alias("component_id"),
    )
