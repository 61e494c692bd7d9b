"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(scale * x). The stated query rows are taken in blocks of bounded size; each block
is sent to every task, which walks the terms (components) one at a time: the queries' weights for the term are
scattered over the term's postings into a dense score array, and a partition selects each query's best k. The
selections of all tasks are merged by a window per query.

Sums that could pass 64 bits are taken in Python integers instead; a score that passes them is an error, as it is in
the query's SQL.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; a finite component whose
scaled value is no 64-bit integer is an error. Missing trailing components count as zero, so an empty vector scores 0 with everything. Rows that
share the query's id are not its candidates; a query id that occurs in several rows is answered for its smallest
vector. A row with a null id is no query but everyone's candidate. Repeated candidate rows are each ranked. Ties go to the smaller
id, null last. An empty table, or one without queries, gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.llm._memory import released
from skeinlog.llm._tables import write_table

QUERY_BLOCK = 4096
LIMIT = 1 << 63
_TILE_QUERIES, _TILE_ROWS = 128, 4096


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(__id, __v array<long>) of the rows that take part; a filter and a projection, no shuffle."""
    wide = lambda x: x.cast("double") * F.lit(float(scale))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    passed = F.raise_error(F.lit("a component times the scale passes 64 bits; use a smaller scale")).cast("long")
    v = F.transform(F.col(vec_col), lambda x: F.when(F.abs(wide(x)) < F.lit(float(LIMIT)), F.floor(wide(x)).cast("long")).otherwise(passed))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), finite))
    return rows.select(F.col(id_col).cast("long").alias("__id"), v.cast("array<long>").alias("__v"))


def as_matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as one int64 matrix, short rows filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(int(lengths.max(initial=0)), dims or 0)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def accumulate(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores (queries x rows), one term after the other."""
    scores = np.zeros((len(weights), len(rows)), np.int64)
    for term in range(min(weights.shape[1], rows.shape[1])):
        queries = np.flatnonzero(weights[:, term])
        postings = np.flatnonzero(rows[:, term])
        if not len(queries) or not len(postings):
            continue
        part = np.multiply.outer(weights[queries, term], rows[postings, term])
        if len(queries) == len(weights) and len(postings) == len(rows):
            scores += part
        else:
            scores[np.ix_(queries, postings)] += part
    return scores


def largest(rows: np.ndarray) -> np.ndarray:
    """The largest magnitude in each row, never too low."""
    return np.abs(rows.astype(np.float64)).max(axis=1, initial=0) * (1 + 1e-9)


def exact_scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores, as Python integers where a sum of the tile could pass 64 bits."""
    dims = max(min(weights.shape[1], rows.shape[1]), 1)
    wide = np.multiply.outer(largest(weights), largest(rows)) * dims >= 2.0**62
    if not wide.any():
        return accumulate(weights, rows)
    columns, lines = np.flatnonzero(wide.any(axis=0)), np.flatnonzero(wide.any(axis=1))
    narrow, short = rows.copy(), weights.copy()
    if len(columns) <= len(lines):
        narrow[columns] = 0
    else:
        short[lines] = 0
    scores = accumulate(short, narrow).astype(object)
    if len(columns) <= len(lines):
        scores[:, columns] = weights[:, :dims].astype(object) @ rows[columns, :dims].T.astype(object)
    else:
        scores[lines] = weights[lines, :dims].astype(object) @ rows[:, :dims].T.astype(object)
    return scores


def as_long(scores: np.ndarray) -> pa.Array:
    if scores.dtype == object and any(not -LIMIT <= s < LIMIT for s in scores):
        raise OverflowError("an inner product of the scaled vectors passes 64 bits; use a smaller scale")
    return pa.array(scores.astype(np.int64))


def select(scores: np.ndarray, ids: np.ndarray, lost: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, larger score first and then smaller id; those that are ``lost`` have no id and come last of a score."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], lost[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        equal = np.flatnonzero(scores == least)
        need = k - len(above)
        named = equal[~lost[equal]]
        if len(named) > need:
            named = named[np.argpartition(ids[named], need - 1)[:need]] if need else named[:0]
        places = np.concatenate([above, named, equal[lost[equal]][: need - len(named)]])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], lost[places], -scores[places]))]


def _search(query_ids: np.ndarray, weights: np.ndarray, k: int):
    """A task: the k best of its rows for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in query_ids]
        for batch in batches:
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            all_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            matrix = as_matrix(batch.column(1))
            for at in range(0, len(all_ids), _TILE_ROWS):
                ids, lost, rows = (x[at : at + _TILE_ROWS] for x in (all_ids, no_id, matrix))
                for q in range(0, len(query_ids), _TILE_QUERIES):
                    scores = exact_scores(weights[q : q + _TILE_QUERIES], rows)
                    for i, own in enumerate(scores, q):
                        other = lost | (ids != query_ids[i])
                        found = [np.concatenate([b, x[other]]) for b, x in zip(best[i], (own, ids, lost), strict=True)]
                        top = select(*found, k)
                        best[i] = tuple(x[top] for x in found)
        sizes = [len(s) for s, *_ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(query_ids, sizes)),
                    pa.array(np.concatenate([v for _, v, _ in best]), mask=np.concatenate([x for *_, x in best])),
                    as_long(np.concatenate([s for s, *_ in best])),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return run


def exact_top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best candidates, over all rows of ``vectors``.

    ``is_query`` is a condition over the columns of ``vectors``. No more than ``query_block`` queries are held by
    the driver or a task at once; with more, each block's answers are written before the next block starts. The queries are
    found once and written in the order of their ids, so a block reads little besides its own rows.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, id_col, vec_col, scale)
    queries = scaled(vectors.where(is_query & F.col(id_col).isNotNull()), id_col, vec_col, scale).groupBy("__id").agg(F.min("__v").alias("__v"))
    queries = write_table(queries.sort("__id"), "topk-queries")
    schema = "query_id long, vec_id long, score long"
    parts, after = [], None
    while True:
        left = queries if after is None else queries.where(F.col("__id") > after)
        block = left.orderBy("__id").limit(query_block).toArrow()
        if not block.num_rows:
            break
        block = block.combine_chunks()
        ids = block.column(0).to_numpy()
        column = block.column(1).chunk(0) if block.column(1).num_chunks else pa.array([], pa.list_(pa.int64()))
        found = rows.mapInArrow(released(_search(ids, as_matrix(column), k)), schema)
        after = int(ids[-1])
        last = len(ids) < query_block
        parts.append(found if last and not parts else write_table(_merge(found, k), "topk-block"))
        if last:
            break
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*merged.columns))
    return _merge(merged.select("query_id", "vec_id", "score"), k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
