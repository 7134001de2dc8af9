"""Joins of facts with dimensions and of keyed tables with each other.

Dimensions are joined without hints: Spark broadcasts those whose size it knows to be small and shuffles the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def code_label(code: Column, labels: Mapping[int, str], default: str | None = None) -> Column:
    """The label of a code."""
    out = F.lit(default)
    for k, v in labels.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, Mapping[str, str], str]]) -> DataFrame:
    """A fact joined with dimensions, each given with {fact column: dimension column} and the kind of join; the dimension's keys go."""
    for i, (dim, on, how) in enumerate(dims):
        keys = {d: f"_k{i}_{j}" for j, d in enumerate(on.values())}
        right = dim.withColumnsRenamed(keys)
        cond = None
        for f, d in on.items():
            c = F.col(f).cast("string") == F.col(keys[d]).cast("string") if dict(fact.dtypes)[f] != dict(dim.dtypes)[d] else F.col(f) == F.col(keys[d])
            cond = c if cond is None else cond & c
        fact = fact.join(right, cond, how).drop(*keys.values())
    return fact


def unified(sources: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Rows of several sources brought to one schema."""
    out = None
    for df, columns in sources:
        part = df.select(*[c.alias(name) for name, c in columns.items()])
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def enriched(df: DataFrame, known: DataFrame, on: str, column: str) -> DataFrame:
    """A column overridden by the known values that aren't null."""
    right = known.select(F.col(on).alias("_on"), F.col(column).alias("_known"))
    return df.join(right, F.col(on) == F.col("_on"), "left").withColumn(column, F.coalesce("_known", column)).drop("_on", "_known")


def resolved(df: DataFrame, dim: DataFrame, name: str, key: str, as_key: str, dim_name: str = "name") -> DataFrame:
    """Names replaced by keys; rows of unknown names go."""
    return df.join(dim.select(F.col(dim_name).alias(name), F.col(key).alias(as_key)), name).drop(name)


def aligned(now: DataFrame, before: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows of either table by key, with values of both; missing ones are 0."""
    right = before.select(F.col(key).alias("_key"), *[F.col(v).alias(f"before_{v}") for v in values])
    both = now.select(key, *values).join(right, F.col(key) == F.col("_key"), "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(v, F.lit(0)).alias(v) for v in values], *[F.coalesce(f"before_{v}", F.lit(0)).alias(f"before_{v}") for v in values])


def tagged(mappings: DataFrame, reviews: DataFrame, tags: DataFrame, categories: DataFrame) -> DataFrame:
    """Mappings with their review, tag and, where known, category; joined on the review's own id."""
    named = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"), "category_id")
    of = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return mappings.join(reviews, "review_id").join(named, "tag_id").join(of, "category_id", "left")


def mismatched(reviews: DataFrame, summaries: DataFrame) -> DataFrame:
    """Reviews whose company isn't part of their branch's name, nor the name's first word of the company."""
    s = summaries.select(F.col("branch_id").alias("_b"), F.col("branch_name").alias("_name"))
    first = F.split_part(F.col("_name"), F.lit(" "), F.lit(1))
    apart = ~F.expr("_name ILIKE concat('%', company_name, '%')") & ~F.contains(F.lower("company_name"), F.lower(first))
    return reviews.join(s, F.col("branch_id") == F.col("_b")).filter(apart).drop("_b")


def purged(reviews: DataFrame, summaries: DataFrame, key: str = "review_id") -> DataFrame:
    """Reviews without those that ``mismatched`` names; a review stays where company or name is null, or its branch has no summary."""
    return reviews.join(mismatched(reviews, summaries).select(key).distinct(), key, "left_anti")
