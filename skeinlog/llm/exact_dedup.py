"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Each level keeps only the keys that more than one row has, and the next level looks at nothing else: prefixes are
compared only among rows whose length repeats, and a whole text is hashed only if its (length, prefix hash) repeats. The
first two levels run on narrow rows, without the texts. A key table whose size has been counted and is within
``broadcast_keys`` is broadcast, so that the scan of the texts prunes as it goes; a larger one is joined by a shuffle
on the keys. The rows that go on are the same.

Defined results: a null text counts as empty; a null id never wins against a number; rows that repeat both id
and text are one document written twice, so they share one answer (``kept`` is true for each of them when their id
is the largest); very long texts are hashed whole; an empty table gives an empty result. Other columns may have any
names: the operator's own stand beside the documents' rows, not among their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.llm._tables import write_table

PREFIX_CHARS = 256
BROADCAST_KEYS = 200_000
_KEYS = ["__len", "__prefix"]


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return write_table(counted.where("__n > 1").select(*keys), name)


def _hinted(keys: DataFrame, most: int) -> DataFrame:
    """A table of keys, to be broadcast if it has been counted to have few rows."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys.hint("merge")


def full_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """Whole rows as ``__row`` beside their id and the keys of the first two levels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"),
        F.octet_length(text).alias("__len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("__prefix"),
    )


def find_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts with more than one row, ``(__full, __keep, __rows)``, and the (length, prefix hash) keys that
    a text must have to belong to one."""
    rows = _keyed(docs, id_col, text_col, prefix_chars)
    lengths = _repeated(rows, ["__len"], "dedup-lengths")
    narrow = rows.select(*_KEYS).join(_hinted(lengths, broadcast_keys), ["__len"], "left_semi")
    prefixes = _hinted(_repeated(narrow, _KEYS, "dedup-prefixes"), broadcast_keys)
    groups = (
        rows.select("__id", "__text", *_KEYS).join(prefixes, _KEYS, "left_semi")
        .groupBy(*_KEYS, full_hash(F.col("__text")).alias("__full"))
        .agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__rows"))
        .where("__rows > 1")
        .select("__full", "__keep", "__rows")
    )
    return write_table(groups, "dedup-groups"), prefixes


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The last join is on the full hash. Both sides are scanned tables, so a group that holds a large share of all
    rows is split by the adaptive skew join; only ids and hashes move.
    """
    groups, _ = find_groups(docs, id_col, text_col, prefix_chars, broadcast_keys)
    narrow = docs.select(F.col(id_col).alias("__id"), full_hash(F.col(text_col)).alias("text_sha256"))
    joined = narrow.join(groups, F.col("text_sha256") == F.col("__full"), "left")
    keep = F.when(F.col("__full").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return joined.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__rows", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    broadcast_keys: int = BROADCAST_KEYS,
    one_row: bool = False,
) -> DataFrame:
    """The documents without their exact copies, all columns kept.

    Rows whose (length, prefix hash) does not repeat pass straight through; only candidates are hashed whole and joined. With
    ``one_row``, one row of each text stays; without it, all rows with the kept id.
    """
    groups, prefixes = find_groups(docs, id_col, text_col, prefix_chars, broadcast_keys)
    rows = _keyed(docs, id_col, text_col, prefix_chars)
    single = rows.join(prefixes, _KEYS, "left_anti").select("__row")
    candidates = rows.join(prefixes, _KEYS, "left_semi").withColumn("__own", full_hash(F.col("__text")))
    joined = candidates.join(groups, F.col("__own") == F.col("__full"), "left")
    largest = F.col("__id").eqNullSafe(F.col("__keep"))
    if one_row:
        alone = joined.where(F.col("__full").isNull()).select("__row")
        kept = alone.unionByName(joined.where(F.col("__full").isNotNull() & largest).dropDuplicates(["__full"]).select("__row"))
    else:
        kept = joined.where(F.col("__full").isNull() | largest).select("__row")
    return single.unionByName(kept).select("__row.*")
