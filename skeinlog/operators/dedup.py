"""Greedy similarity de-duplication and ranking of suggestions.

Items are folded in input order: an item similar to a kept one (the first such) replaces it in place if it is better, and is
dropped if it isn't. An item only ever meets similar ones, so each component of the similarity graph is folded alone (see
``similarity.components_of``), as a stream in order that holds its kept items only; components are dealt over all tasks. Most items of
a large component change nothing: those that do are found by parts of it, in rounds, and are its stream. Places are then
numbered by the items that opened them. The kept items that an item can be similar to are found exactly, by the words and ids that they share.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinlog.functions import text as X
from skeinlog.operators.ranking import numbered
from skeinlog.operators.similarity import ANY_TARGET, SAME_CONTENT, SAME_TARGET, components_of, similar_sets
from skeinlog.sources.scratch import written

PRIORITIES = ["high", "medium", "low"]

#: Components of more rows are folded from the rows that change what is kept; titles and word sets that a fold remembers.
LARGE, FOUND = 20_000, 100_000


def with_words(rows: DataFrame) -> DataFrame:
    """Adds the word sets and the priority's ordinal that the comparison reads."""
    return rows.withColumns(
        {
            "tw": X.title_words(F.col("title")),
            "cw": X.content_words(F.coalesce(F.col("added_text"), F.lit(""))),
            "po": F.coalesce(X.ordinal(F.col("priority"), PRIORITIES), F.lit(len(PRIORITIES))),
        }
    )


class Kept:
    """The kept items of one component, with the words and ids by which similar ones are found. The place found for a title holds
    until another title takes one; those that are opened lie behind it."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.at: dict[tuple, set[int]] = defaultdict(set)
        self.found: dict[tuple, int] = {}

    @staticmethod
    def _keys(x: dict) -> list[tuple]:
        return [*(("t", w) for w in x["tw"] or ()), *(("c", w) for w in x["cw"] or ()), *(("i", i) for i in set(x["source_insight_ids"] or ()) if i is not None)]

    def _put(self, place: int, x: dict) -> None:
        for key in self._keys(x):
            self.at[key].add(place)

    def _shares(self, kind: str, words: Sequence[str], least: float) -> Iterator[tuple[int, float]]:
        """Places and their likeness; all those over ``least`` are among them. They hold one of the words that are in the fewest places."""
        n, field = len(words), f"{kind}w"
        lists = sorted((self.at.get((kind, w), ()) for w in words), key=len)
        own = set(words)
        for place in set().union(*lists[: n - math.floor(least * n - 1e-9)]):
            k = self.items[place][field]
            common = len(own.intersection(k))
            yield place, common / (len(k) + n - common)

    def _by_title(self, x: dict) -> int | None:
        hits = []
        for place, share in self._shares("t", x["tw"] or (), min(SAME_TARGET, ANY_TARGET)):
            k = self.items[place]
            same_place = k["target_file"] == x["target_file"] and k["target_section"] == x["target_section"]
            if share > (SAME_TARGET if same_place else ANY_TARGET):
                hits.append(place)
        return min(hits, default=None)

    def _by_content(self, x: dict) -> int | None:
        return min((place for place, share in self._shares("c", x["cw"] or (), SAME_CONTENT) if share > SAME_CONTENT), default=None)

    def _titled(self, x: dict) -> int | None:
        key = (tuple(x["tw"] or ()), x["target_file"], x["target_section"])
        place = self.found.get(key)
        if place is None and (place := self._by_title(x)) is not None:
            if len(self.found) >= FOUND:
                self.found.clear()
            self.found[key] = place
        return place

    def first_similar(self, x: dict) -> int | None:
        hits = [self._titled(x), self._by_content(x)]
        for i in x["source_insight_ids"] or ():
            if i is not None:
                hits.append(min(self.at.get(("i", i), ()), default=None))
        return min((h for h in hits if h is not None), default=None)

    def add(self, x: dict) -> int | None:
        """The place that the item takes, if it changes anything."""
        place = self.first_similar(x)
        if place is None:
            place = len(self.items)
            self.items.append(x | {"opened": x["at"]})
        elif better(x, self.items[place]):
            old = self.items[place]
            for key in self._keys(old):
                self.at[key].discard(place)
            if any(x[c] != old[c] for c in ("tw", "target_file", "target_section")):
                self.found.clear()
            self.items[place] = x | {"opened": self.items[place]["opened"]}
        else:
            return None
        self._put(place, x)
        return place

    def rerank(self) -> None:
        """Put the kept items in the order of their rank, the earlier opened first where they are equal."""
        self.items.sort(key=lambda x: (x["po"], -(x["confidence"] if x["confidence"] is not None else float("-inf"))))
        self.at.clear()
        self.found.clear()
        for place, x in enumerate(self.items):
            self._put(place, x)


def better(new: dict, old: dict) -> bool:
    if new["po"] != old["po"]:
        return new["po"] < old["po"]
    return new["confidence"] is not None and old["confidence"] is not None and new["confidence"] > old["confidence"]


_COMPARED = ("tw", "cw", "source_insight_ids", "target_file", "target_section", "po", "confidence")


def _fold(order: str, step: str | None, out: pa.Schema):
    """Over rows sorted by component, step and order: the kept rows of each component, with what came first at their places. At the end
    of each step the kept rows are ranked, and those that the step has added are sent as they are then."""

    def rows_of(kept: Kept, final: bool, of: object = None) -> pa.RecordBatch | None:
        chosen = kept.items if final else [x for x in kept.items if x["step"] == of]
        rows = [x["row"] | {"opened": x["opened"][0], "opened_id": x["opened"][1], "final": final} for x in chosen]
        return pa.RecordBatch.from_pylist(rows, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, kept = None, None, Kept()
        names = ("component", order, "id", *_COMPARED, *([step] if step else []))
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            for i in range(batch.num_rows):
                key, own = columns["component"][i], columns[step][i] if step else None
                if kept.items and step and (key, own) != (now, at):
                    yield rows_of(kept, False, at)
                    kept.rerank()
                if key != now:
                    if kept.items:
                        yield rows_of(kept, True)
                    kept = Kept()
                now, at = key, own
                opened = (columns[order][i], columns["id"][i])
                place = kept.add({c: columns[c][i] for c in _COMPARED} | {"at": opened, "step": own})
                if place is not None:
                    kept.items[place]["row"] = batch.slice(i, 1).to_pylist()[0]
        if kept.items:
            if step:
                yield rows_of(kept, False, at)
                kept.rerank()
            yield rows_of(kept, True)

    return run


def _changes(step: str | None):
    """Over rows sorted by component, part, step and order, the known ones among them: those not known that change what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, kept, last, words = None, None, Kept(), None, {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("component", "__part", "__row", "__known", *_COMPARED, *([step] if step else []))}
            for joined in {*columns["tw"], *columns["cw"]} - words.keys():
                words[joined] = joined.split()
            chosen = []
            for i in range(batch.num_rows):
                key, own, row = (columns["component"][i], columns["__part"][i]), columns[step][i] if step else None, columns["__row"][i]
                if key != now:
                    kept, last = Kept(), None
                elif step and own != at:
                    kept.rerank()
                now, at = key, own
                if row == last:  # known, and just added
                    continue
                last = row
                x = {c: columns[c][i] for c in _COMPARED} | {"tw": words[columns["tw"][i]], "cw": words[columns["cw"][i]], "at": row}
                if kept.add(x) is not None and not columns["__known"][i]:
                    chosen.append(i)
            if len(words) > FOUND:
                words.clear()
            yield batch.take(pa.array(chosen, pa.int64()))

    return run


def _changing(staged: DataFrame, large: DataFrame, by: list[str], step: str | None) -> DataFrame:
    """(__row): rows of large components that include all that change what is kept, when all of ``staged`` are folded.

    Rows of a component are dealt over parts. Each part folds its own rows together with the known ones (none at first) and tells
    which of its own change anything. These join the known ones, of which a fold of theirs alone keeps those that change anything, and so on until
    no part finds any. Then the known ones are folded as all rows would be: up to the first row that a part would have to tell of both
    folds are the same. For the same reason each round knows more of the rows from the start, so there is an end.
    """
    plain = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    slim = [*dict.fromkeys(["component", *by, *_COMPARED, "__row"])]
    own = staged.join(F.broadcast(large), "component").withColumns({"tw": plain(F.col("tw")), "cw": plain(F.col("cw"))})
    tasks = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = written(own.select(*slim, F.pmod(F.xxhash64("__row"), F.col("parts")).alias("__part")), "own")
    own = own.withColumn("__known", F.lit(False))

    def told(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(tasks, "component", "__part").sortWithinPartitions("component", "__part", *by, F.col("__known").desc())
        return dealt.mapInArrow(_changes(step), rows.schema).select(*slim)

    known = None
    while True:
        rows = own
        if known is not None:
            each = known.join(F.broadcast(large), "component").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            rows = own.unionByName(each.drop("parts").withColumn("__known", F.lit(True)))
        found = Observation()
        new = written(told(rows).observe(found, F.count(F.lit(1)).alias("n")), "found")
        if not found.get["n"]:
            return known.select("__row")
        both = new if known is None else known.unionByName(new)
        known = written(told(both.withColumns({"__part": F.lit(0).cast("long"), "__known": F.lit(False)})), "known")


def _folded(rows: DataFrame, group: list[str], order: str, step: str | None) -> DataFrame:
    """Kept rows with what opened their places (``opened``, ``opened_id``); ``final`` is false for rows as they were after their step.

    A component of up to ``LARGE`` rows is one stream. Of a larger one only the rows go there that change what is kept."""
    worded = components_of(written(with_words(rows), "worded"), "id", group)
    staged = written(worded.withColumn("__row", F.monotonically_increasing_id()), "staged")
    by = [*([step] if step else []), order, "id", "__row"]
    sizes = staged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
    # as many parts as a part has thousands of rows: both the parts and what they tell of grow with the square root
    large = written(sizes.select("component", F.ceil(F.sqrt(F.col("n") / 1000)).alias("parts")), "large")
    if not large.isEmpty():
        changing = _changing(staged, large, by, step)
        staged = staged.join(F.broadcast(large), "component", "left_anti").unionByName(staged.join(changing, "__row", "left_semi"))
    opened = [T.StructField("opened", rows.schema[order].dataType), T.StructField("opened_id", rows.schema["id"].dataType), T.StructField("final", T.BooleanType())]
    schema = T.StructType([*rows.schema.fields, *opened])
    return staged.repartition("component").sortWithinPartitions("component", *by).mapInArrow(_fold(order, step, to_arrow_schema(schema)), schema)


def dedup(rows: DataFrame, group: Sequence[str] = (), order: str = "ord") -> DataFrame:
    """Kept rows with ``place`` (from 0) within the group, or the whole table; rows of equal ``order`` go by their id."""
    group = list(group)
    names = [order, *[c for c in rows.columns if c not in (*group, order)]]
    kept = _folded(rows, group, order, None)
    by = [F.col("opened").asc(), F.col("opened_id").asc()]
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*by))) if group else numbered(kept, by, "place")
    return placed.select(*group, (F.col("place") - 1).cast("int").alias("place"), *names)


def rank(rows: DataFrame, group: Sequence[str] = (), order: str = "place") -> DataFrame:
    """Adds ``rank`` within the group, or the whole table: by priority, then confidence, then the order given."""
    by = [X.ordinal(F.col("priority"), PRIORITIES).asc_nulls_last(), F.col("confidence").desc(), F.col(order).asc()]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by))) if group else numbered(rows, by)
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def dedup_and_rank(rows: DataFrame, group: Sequence[str] = (), order: str = "ord") -> DataFrame:
    return rank(dedup(rows, group, order), group)


def by_step(rows: DataFrame, step: str, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """The fold step after step (a session's items are a step), with a ranking after each: the ranked rows at the end, and for
    each step its own rows that were kept when it ended.

    An item is compared with kept ones of its component only, so ranking these after each step gives what ranking all would. Rows that
    are equal in rank go by what opened their places.
    """
    folded = written(_folded(rows.withColumn("__at", F.struct(step, order)), [], "__at", step), "folded")
    final = folded.where("final").withColumn("__place", F.struct("opened", "opened_id"))
    return rank(final, (), "__place").select(*rows.columns, "rank"), folded.where("not final").select(*rows.columns)


def incremental(kept: DataFrame, new: DataFrame, group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Kept items in their rank order, followed by the new ones, folded and ranked again; and the new survivors."""
    shape = [c for c in new.columns if c != "ord"]
    before = kept.select(*shape, F.col("rank").cast("long").alias("ord"))
    # ranks are dense, so every new item's order lies behind all of them
    offset = F.lit(1 << 62)
    merged = before.unionByName(new.select(*shape, (F.col("ord") + offset).cast("long").alias("ord")))
    out = dedup_and_rank(merged, group)
    return out, new_only(out, kept)


def new_only(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is not known yet."""
    return rows.join(known.select(key), key, "left_anti")


__all__ = ["better", "by_step", "dedup", "dedup_and_rank", "incremental", "new_only", "rank", "similar_sets", "with_words"]
