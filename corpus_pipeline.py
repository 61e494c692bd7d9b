"""The corpus pipeline: language identification, exact and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next
one. All but the last return the columns of ``documents``; the last returns the packed pieces.

Defined results: documents without any letter, or with no language more likely than not, are rejected by the first
stage, and a missing language is filled in with the predicted one; of equal texts one row stays, with the largest id; of a
group of near copies one row stays, with the smallest id, whether or not other rows share that id; a document that the mix takes several times appears as
several rows, one that it takes no words of goes, and each source's last copy is taken whole. Rows with null
ids rank behind all others and are kept unless they repeat another row's text or are near copies of it. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm import exact_dedup, langid, mixing, ngram_join, packing
from skeinlog.llm._tables import write_table
from skeinlog.llm.queries import tokenizer_path

#: A prediction below this is a rejection: no language is more likely than not.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, F.lit(True))
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # no name of theirs meets one of ours
    found = langid.predict(numbered, model, numbered.columns, text_col=f"c{docs.columns.index('text')}", names=("pred", "score"))
    kept = found.where((F.col("pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[(F.coalesce(f"c{i}", "pred") if c == "lang" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs, one_row=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by 128 bits of a digest of id and text, which repeat for exact copies only (dropped before)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.struct(half(1).alias("high"), half(17).alias("low")).alias("key"))
    groups = ngram_join.near_duplicate_components(rows, id_col="key").select("key", "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    stay = groups.join(rows.select("key", "doc_id"), "key").groupBy("component_id").agg(least["key"].alias("stay"))
    return rows.join(stay, F.col("key") == F.col("stay"), "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: A trained classifier and a tokenizer are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
