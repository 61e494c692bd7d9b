"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target in words: its weight's share of all words, held to ``max_repeats`` times its size, what
is over being shared again by weight. During training (time 0 to 1) a source's rate follows a linear schedule
whose integral over the run is the target; ``ramp`` r gives the rate target * (1 + r * (2t - 1)), so that the
demand up to time t is target * ((1 - r) t + r t^2). Documents supply words in a fixed pseudo-random order, epoch
after epoch. The document copy that supplies a source's word number x is wanted at the time at which the demand
reaches x, which inverts the quadratic; ordering all copies by that time gives the training order.

Everything is DataFrame expressions. A document's place in its source's supply is a prefix sum in two steps: over
``BUCKETS`` slices of the hashed order, then within a slice, so a source that holds most rows is spread over as
many tasks as there are slices.

Defined results: a null text has no words, documents without words are never taken; a null source is a source of
its own and comes last; null ids are ordered as the empty string; rows that repeat an id are ordered by size and
otherwise interchangeable; without any words all targets are 0. The last copy taken of a source may be cut to its first
words, so that the source meets its rounded target exactly; ``mix_documents`` with ``whole`` takes that copy uncut, so
that the source passes its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm._tables import write_table

#: Fixed: a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
RAMPS = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3
#: Slices of the hashed order of a source: three hexadecimal digits.
BUCKET_DIGITS = 3


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[float] = RAMPS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source_size, weight, ramp and target.

    Sources are ordered by code point, null last, and take the weights and ramps in turn. The windows run
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("__turn", turn).withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), F.col("__turn") % len(weights) + 1).cast("long"),
            "ramp": F.element_at(F.array(*map(F.lit, ramps)), F.col("__turn") % len(ramps) + 1).cast("double"),
            "__cap": F.col("source_size") * max_repeats,
        }
    )
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy(F.col("__cap") / F.col("weight"), "__turn")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "__at": F.row_number().over(filled),
            "__level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    free = F.col("__cap").cast("double") > F.col("weight") * F.col("__level")
    first_free = F.min(F.when(free, F.struct("__at", "__level"))).over(everything)
    per = per.withColumn("__free", first_free)
    target = F.when(
        F.col("__free").isNotNull() & (F.col("__at") >= F.col("__free.__at")), F.col("weight") * F.col("__free.__level")
    ).otherwise(F.col("__cap").cast("double"))
    return per.select("source", "source_size", "weight", "ramp", target.alias("target"))


def _time(x: Column, target: Column, ramp: Column) -> Column:
    """When the demand reaches x of target, by the inverse of (1 - r) t + r t^2."""
    u = x / target
    b = 1 - ramp
    return F.when(ramp == 0, u).otherwise((F.sqrt(b * b + 4 * ramp * u) - b) / (2 * ramp))


def assign_demand(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    ramps: Sequence[float] = RAMPS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, ``full_copies``, ``cut_words`` (words
    of one more copy), ``position`` (the time of its first copy, null if none), and ``supply``/``ramp`` behind it."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"), key.alias("__key")
    ).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    sized = write_table(sized, "mix-sizes")
    buckets = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    buckets = write_table(buckets, "mix-buckets")
    targets = source_targets(buckets.withColumnRenamed("__words", "size"), weights, ramps, max_repeats)
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        F.col("source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__words").over(before), F.lit(0)).alias("__before")
    ).join(
        targets.withColumnRenamed("source", "__t"), F.col("__s").eqNullSafe(F.col("__t"))
    )
    rows = sized.join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    own = (
        Window.partitionBy("source", "__bucket").orderBy("__key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    supply = F.col("__before") + F.coalesce(F.sum("size").over(own), F.lit(0))
    demand = F.round("target").cast("long")
    rows = rows.withColumns({"supply": supply, "__demand": demand}).withColumns(
        {
            "full_copies": F.when(F.col("source_size") > 0, F.expr("__demand div source_size")).otherwise(F.lit(0)).cast("long"),
            "__rest": F.when(F.col("source_size") > 0, F.expr("__demand % source_size")).otherwise(F.lit(0)).cast("long"),
        }
    )
    rows = rows.withColumn("cut_words", F.greatest(F.lit(0), F.least("size", F.col("__rest") - F.col("supply"))).cast("long"))
    taken = (F.col("full_copies") * F.col("size") + F.col("cut_words")).cast("long")
    return rows.withColumn("taken", taken).select(
        F.col("__id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "taken",
        "full_copies",
        "cut_words",
        F.when(F.col("taken") > 0, _time(F.col("supply"), F.col("target"), F.col("ramp"))).alias("position"),
        "supply",
        "ramp",
    )


def in_training_order(demand: DataFrame, partitions: int | None = None) -> DataFrame:
    """The documents range-sorted by the position of their first copy, those that are never taken last; ``last_position`` is
    the time of the last copy. Documents of one position are ordered by source and id."""
    last = F.col("full_copies") - F.when(F.col("cut_words") > 0, 0).otherwise(1)
    at = _time(last * F.col("source_size") + F.col("supply"), F.col("target"), F.col("ramp"))
    rest = [F.col(f"`{c}`") for c in demand.columns[:2]]
    n, order = [partitions] if partitions else [], [F.col("position").asc_nulls_last(), *rest]
    return demand.withColumn("last_position", F.when(F.col("taken") > 0, at)).repartitionByRange(*n, *order).sortWithinPartitions(*order)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n), "")


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    ramps: Sequence[float] = RAMPS,
    max_repeats: int = MAX_REPEATS,
    partitions: int | None = None,
    whole: bool = False,
) -> DataFrame:
    """The mixed corpus in training order: the columns of ``docs``, one row per copy taken, range-sorted by position.

    Copies are matched to their documents by (id, source, size); among rows that repeat all three, each is
    taken as often as the first of them.
    """
    demand = assign_demand(docs, id_col, text_col, source_col, weights, ramps, max_repeats)
    own = lambda c: F.col(f"`{c}`")
    # names of this plan's own, whatever the documents' columns are called
    plan = demand.where("taken > 0").select(
        own(id_col).alias("__id"), own(source_col).alias("__source"), F.col("size").alias("__size"),
        *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "full_copies", "cut_words", "supply", "ramp")],
    ).dropDuplicates(["__id", "__source", "__size"])
    whole_rows = docs.select(F.struct("*").alias("__row"), own(text_col).alias("__text"), own(id_col).alias("__own_id"), own(source_col).alias("__own_source"), count_words(own(text_col)).alias("__words"))
    rows = whole_rows.join(
        plan, F.col("__own_id").eqNullSafe(F.col("__id")) & F.col("__own_source").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    )
    last = F.col("__full_copies") - F.when(F.col("__cut_words") > 0, 0).otherwise(1)
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at = _time(F.col("__copy") * F.col("__source_size") + F.col("__supply"), F.col("__target"), F.col("__ramp"))
    uncut = F.lit(whole) | (F.col("__copy") < F.col("__full_copies")) | (F.col("__cut_words") == F.col("__words"))
    text = F.when(uncut, F.col("__text")).otherwise(first_words(F.col("__text"), F.col("__cut_words").cast("int")))
    rows = rows.withColumns({"__position": at, "__text": text})
    n = [partitions] if partitions else []
    ordered = rows.repartitionByRange(*n, "__position", "__source", "__id").sortWithinPartitions("__position", "__source", "__id")
    return ordered.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns])
