"""Answers that hold findings and the changes that follow from them at once.

An answer is an object with two arrays, ``insights`` and ``suggestions``, whose sources are places in the first; a plain array is findings
alone. Both outputs are read from one kept answer, and places become the ids of the rows that stand there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.operators import insights, suggestions


def parts(answers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two arrays as answers(keys..., value) of their own."""
    v = F.col("value")
    both = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    at = lambda path: F.try_variant_get(v, path, "variant")
    return answers.select(*keys, F.when(both, at("$.insights")).otherwise(v).alias("value")), answers.select(*keys, F.when(both, at("$.suggestions")).alias("value"))


def resolved(said: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``said`` with places in ``source_insight_ids`` as ids of ``found`` (keys..., pos, id); places where no finding stands go, what isn't
    a place stays."""
    held = found.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("string"), "id"))).alias("__ids"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    place = lambda i: i.rlike("^[0-9]+$")
    ids = F.filter(F.transform("source_insight_ids", lambda i: F.when(place(i), F.try_element_at("__ids", i)).otherwise(i)), lambda i: i.isNotNull())
    return said.join(held, on, "left").withColumn("source_insight_ids", F.coalesce(ids, F.array().cast("array<string>"))).select(*said.columns)


def from_answers(answers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Insights and suggestions of combined answers(keys..., value)."""
    first, second = parts(answers, keys)
    found = insights.from_answers(first, keys)
    return found, resolved(suggestions.from_answers(second, keys), found, keys)
