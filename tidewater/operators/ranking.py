"""Windows, top-k and similar choices; every order is total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def tfidf(counts: DataFrame, branch: str, tag: str, n: int = 3) -> DataFrame:
    """Top tags of each branch by share of the branch's count times log(branches / branches with the tag) + 1; ties by name."""
    counts = counts.filter("count > 0")
    within = counts.withColumn("tf", F.col("count") / F.sum("count").over(Window.partitionBy(branch)))
    spread = counts.groupBy(tag).agg(F.countDistinct(branch).alias("df"))
    total = counts.agg(F.countDistinct(branch).alias("branches"))
    scored = within.join(spread, tag).join(F.broadcast(total), how="cross")
    scored = scored.withColumn("score", F.round(F.col("tf") * (F.log(F.col("branches") / F.col("df")) + 1), 9))
    return top_n(scored, [branch], [F.desc("score"), F.asc(tag)], n).select(branch, tag, "count", "score", "rank")


def better_percent(df: DataFrame, region: str, rating: str) -> DataFrame:
    """For each row the rounded percent of the region's rows with a better rating, and the region's mean; null and 0 ratings are left out."""
    rated = df.filter(F.col(rating).isNotNull() & (F.col(rating) != 0))
    w = Window.partitionBy(region)
    better = F.rank().over(w.orderBy(F.desc(rating))) - 1
    return rated.withColumns({"region_size": F.count(F.lit(1)).over(w), "better": better}).withColumn("top_percent", numbers.percent(F.col("better"), F.col("region_size")))


def even_sample(df: DataFrame, group: Sequence[str], order: Sequence[Column], newest: int, n: int) -> DataFrame:
    """n rows at even distances among the first rows of each group: those of index floor(i * size / n)."""
    w = Window.partitionBy(*group)
    ranked = top_n(df, group, order, newest, "_rank").withColumn("_size", F.count(F.lit(1)).over(w))
    i = F.col("_rank") - 1
    # The index is wanted if some whole i has floor(i * size / n) equal to it
    first = F.ceil(i * n / F.col("_size"))
    wanted = (F.col("_size") <= n) | ((first < n) & (F.floor(first * F.col("_size") / n) == i))
    return ranked.filter(wanted).drop("_size").withColumnRenamed("_rank", "position")


def latest(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    return top_n(df, key, order, 1, "_rank").drop("_rank")


def first_max(df: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    """Of each key the name of greatest value, the first by name of equals."""
    return top_n(df, key, [F.desc(value), F.asc(name)], 1, "_rank").drop("_rank")


def nearest(vectors: DataFrame, centres: DataFrame, threshold: float, default: str | None) -> DataFrame:
    """For each (id, vector) the most alike centre (name, centre) if alike enough; the centres are a bounded dimension table."""
    table = F.broadcast(centres.agg(F.collect_list(F.struct("name", "centre")).alias("centres")))
    scored = vectors.join(table, how="cross").withColumn("best", F.array_max(F.transform("centres", lambda c: F.struct(F.round(numbers.cosine(F.col("vector"), c["centre"]), 6).alias("score"), c["name"].alias("name")))))
    return scored.select("id", F.when(F.col("best.score") >= threshold, F.col("best.name")).otherwise(F.lit(default)).alias("name"), F.col("best.score").alias("score"))
