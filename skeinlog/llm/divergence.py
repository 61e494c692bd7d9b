"""Audit of how far the sources of a language differ in their words.

A term is a run of letters A-Z and of bytes beyond ASCII, with A-Z in lower case. Terms in enough documents of a language are
kept, each group (a language and a source) gets smoothed integer shares p of them, and two things are reported: the sum of
|p - q| over all kept terms for every pair of sources, and for each group the terms that it uses more than its language does.

Kept terms are dealt into blocks by a hash, about ``BLOCK_TERMS`` to a block, and the sources of a language into blocks of
``BLOCK_GROUPS``. A task gets the counts of two blocks of sources at one block of terms, lays them out as dense int64 tiles, and
broadcasts all pairs of rows against each other; partial pair sums are added up over the blocks of terms, and the best terms that each
tile finds for a group are merged by one ranking. So memory is bounded by two tiles whatever the number of terms, sources or
documents. All arithmetic is in whole numbers, with quotients taken in steps of three digits so that 64 bits are enough.

Tokens are counted in Arrow batches before they are shuffled: a term of very many documents is one row for each
language, source and about ``FLUSH_TERMS`` distinct terms of a task.

Defined results: null text, language or source is an empty string; a group without kept terms has an even share of each; with a single
source in a language there is no pair; without kept terms every pair's value is 0; repeated rows count each; very long texts are
counted in slices of ``SLICE_BYTES``; ties go to the item whose UTF-8 comes first; an empty table gives an empty result. Other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm._memory import released
from skeinlog.llm._tables import write_table

LEAST_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
BLOCK_TERMS, BLOCK_GROUPS = 1024, 128
FLUSH_TERMS, SLICE_BYTES = 200_000, 1 << 22

#: Bytes of terms, A-Z as a-z; all others become a space.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists that come from slices of it."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows of a task; a row with a null term for each group."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for group, own in counts.items():
            terms, n = list(own), list(own.values())
            seen = docs[group]
            rows = len(terms) + 1
            cells = [pa.array([g] * rows, pa.string()) for g in group]
            cells += [pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *n], pa.int64()), pa.array([0, *(seen[t] for t in terms)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        texts = pc.fill_null(batch.column(2), "").cast(pa.large_binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            group = (lang, source)
            own, before = counts[group], len(counts[group])
            distinct: set[bytes] = set()
            for terms in term_slices(text.as_py()):
                own.update(terms)
                distinct.update(terms)
            docs[group].update(distinct)
            held += len(own) - before + 1
            if held > FLUSH_TERMS:
                yield from flushed()
                held = 0
    yield from flushed()


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly, for totals below 9 * 10^15."""
    below = total + SMOOTHING * terms
    whole, rest = np.divmod(counts + SMOOTHING, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def pair_sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of |p - q| of all pairs of rows of two tiles; a row at a time is broadcast, so no third dimension is held."""
    return np.stack([np.abs(row[None, :] - y).sum(axis=1, dtype=np.int64) for row in x]) if len(x) else np.zeros((0, len(y)), np.int64)


def _tile(top: int):
    """Over the cells of two blocks of groups (a, b) at one block of terms: partial pair sums, and, where a = b, each group's best terms.

    A cell without a term (``at`` < 0) names a group with its total; all cells carry the language's numbers."""
    names = ["lang", "block", "g", "other", "at", "value"]

    def run(table: pa.Table) -> pa.Table:
        number = lambda c: table.column(c).to_numpy()
        g, at, n, total, lang_n, lang_total = (number(c) for c in ("g", "at", "n", "total", "lang_n", "lang_total"))
        a, b, block, terms, width = (int(table.column(c)[0].as_py()) for c in ("a", "b", "block", "terms", "width"))
        out: list[tuple[np.ndarray, ...]] = []
        heads, totals = g[at < 0], total[at < 0]
        order = np.argsort(heads)
        heads, totals = heads[order], totals[order]
        cell = at >= 0
        dense = np.zeros((len(heads), width), np.int64)
        dense[np.searchsorted(heads, g[cell]), at[cell]] = n[cell]
        p = shares(dense, totals[:, None], terms)
        x, y = heads // BLOCK_GROUPS == a, heads // BLOCK_GROUPS == b
        sums = pair_sums(p[x], p[y])
        i, j = (m.ravel() for m in np.meshgrid(heads[x], heads[y], indexing="ij"))
        apart = i < j
        out.append((i[apart], j[apart], np.full(int(apart.sum()), -1, np.int64), sums.ravel()[apart]))
        if a == b and cell.any():
            own, where = g[cell], at[cell]
            f = p[np.searchsorted(heads, own), where] - shares(lang_n[cell], lang_total[cell], terms)
            more = (f > 0) & (n[cell] > 0)
            own, where, f = own[more], where[more], f[more]
            order = np.lexsort((where, -f, own))
            own, where, f = own[order], where[order], f[order]
            first = np.searchsorted(own, own)  # where each group begins
            best = np.arange(len(own)) - first < top
            out.append((own[best], np.full(int(best.sum()), -1, np.int64), where[best], f[best]))
        g_, other, at_, value = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
        lang = pa.array([table.column("lang")[0].as_py()] * len(g_), pa.string())
        return pa.table([lang, pa.array(np.full(len(g_), block)), pa.array(g_), pa.array(other), pa.array(at_), pa.array(value)], names=names)

    return run


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group all other sources of its language by divergence (part ``pair``), and
    the terms that it overuses most (part ``term``)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(released(_count), "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = write_table(counted, "term-counts", compression="zstd")
    # a term of a language has a row for each source
    everywhere = Window.partitionBy("lang", "term")
    kept = counted.where("term is not null").withColumn("all_docs", F.sum("docs").over(everywhere)).withColumn("lang_n", F.sum("n").over(everywhere))
    kept = write_table(kept.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n"), "term-kept", compression="zstd")

    terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")])
    # one small row for each source of a language, of which there are as many squared in the result
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumns({"g": (F.row_number().over(by_source) - 1).cast("long"), "sources": F.count(F.lit(1)).over(Window.partitionBy("lang"))})
    blocks = F.expr(f"cast(greatest(1, ceil(terms / {BLOCK_TERMS})) as long)")
    groups = write_table(groups.withColumn("blocks", blocks), "term-groups")

    placed = terms.join(groups.where("g = 0").select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    placed = placed.withColumn("at", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).cast("long"))
    placed = write_table(placed.select("lang", "term", "block", "at"), "term-places", compression="zstd")
    widths = placed.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))

    about = ["lang", "source", "g", "sources", "total", "terms", "lang_total"]
    cells = kept.join(placed, ["lang", "term"]).join(groups.select(*about), ["lang", "source"]).select(*about[2:], "lang", "block", "at", "n", "lang_n")
    heads = groups.select(*about[2:], "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("lang_n"))
    own = F.expr(f"g div {BLOCK_GROUPS}")
    partners = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {BLOCK_GROUPS}")))
    tiles = cells.unionByName(heads).withColumn("own", own).withColumn("with", partners)
    tiles = tiles.withColumns({"a": F.least("own", "with"), "b": F.greatest("own", "with")}).drop("own", "with", "sources")
    tiles = tiles.join(widths, ["lang", "block"], "left").withColumn("width", F.coalesce("width", F.lit(0)).cast("long"))
    found = tiles.groupBy("lang", "block", "a", "b").applyInArrow(_tile(top), "lang string, block long, g long, other long, at long, value long")
    found = write_table(found, "term-tiles", compression="zstd")

    names = groups.select("lang", "g", "source")
    sums = found.where("other >= 0").groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("g"), F.col("g").alias("other"), "value"))
    pairs = both.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    ranking = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    result = ["lang", "source", "part", "item", "value", F.row_number().over(ranking).cast("int").alias("rank")]
    pairs = pairs.withColumn("part", F.lit("pair")).select(*result)
    heaps = found.where("other < 0").join(placed.withColumnRenamed("term", "item"), ["lang", "block", "at"]).join(names, ["lang", "g"])
    heaps = heaps.withColumn("part", F.lit("term")).select(*result).where(F.col("rank") <= top)
    return pairs.unionByName(heaps)
