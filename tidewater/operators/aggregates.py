"""Grouped counts, means and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers

POLARITIES = ("positive", "negative", "neutral")


def polarity_counts(sentiment: str = "sentiment") -> list[Column]:
    """Counts of the three polarities and of all rows; a null sentiment counts in the total only."""
    return [*[F.count_if(F.col(sentiment) == p).alias(f"{p}_count") for p in POLARITIES], F.count(F.lit(1)).alias("total_count")]


def by_polarity(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(*polarity_counts())


def branch_stats(df: DataFrame, branch: str, ratings: Mapping[str, str]) -> DataFrame:
    """Reviews, polarities and mean ratings of each branch; ratings map a name to a column in tenths."""
    means = [numbers.mean_tenths(F.sum(c), F.count(c)).alias(f"avg_{name}") for name, c in ratings.items()]
    return df.groupBy(branch).agg(*polarity_counts(), *means)


def multi_period(df: DataFrame, date: str, periods: Mapping[str, tuple[object, object]]) -> DataFrame:
    """Rows of each labelled half-open range, counted in one pass."""
    return df.agg(*[F.count_if(dates.half_open(F.col(date), a, b)).alias(f"n_{label}") for label, (a, b) in periods.items()])


def recommended(counts: Sequence[tuple[str, Column]], least: int, fallback: Column) -> Column:
    """The first label whose count is enough."""
    out = fallback
    for label, n in reversed(counts):
        out = F.when(n >= least, F.lit(label)).otherwise(out)
    return out


def monthly(df: DataFrame, date: str, *keys: str) -> DataFrame:
    """Polarity counts by month; what isn't positive or negative is neutral."""
    known = F.when(F.col("sentiment").isin("positive", "negative"), F.col("sentiment")).otherwise("neutral")
    return df.withColumn("sentiment", known).groupBy(*keys, dates.month_key(F.col(date)).alias("period")).agg(*polarity_counts())


def monthly_ratings(df: DataFrame, date: str, branch: str, ratings: Mapping[str, str]) -> DataFrame:
    """Sum and count of the given ratings and the number of reviews by month."""
    sums = [x for name, c in ratings.items() for x in (F.sum(c).alias(f"sum_{name}"), F.count(c).alias(f"n_{name}"))]
    return df.groupBy(branch, dates.month_key(F.col(date)).alias("period")).agg(*sums, F.count(F.lit(1)).alias("review_count"))


def tag_weights(df: DataFrame, as_of: object, date: str, rate: float, *keys: str) -> DataFrame:
    """Polarity counts with the decayed weight of the rows; a weight of 0 gives way to the count."""
    days = F.timestamp_diff("DAY", F.col(date), F.lit(as_of).cast("timestamp_ntz"))
    got = df.groupBy(*keys).agg(*polarity_counts(), F.sum(numbers.decay(days, rate)).alias("weight"))
    return got.withColumn("weight", F.when(F.col("weight") == 0, F.col("total_count").cast("double")).otherwise(F.col("weight")))


def keyword_counts(df: DataFrame, words: Column, date: str | None, *keys: str) -> DataFrame:
    """Occurrences of each word by key, and when it was last seen."""
    seen = [F.max(date).alias("last_seen_at")] if date else []
    return df.select(*keys, *([date] if date else []), F.explode(words).alias("keyword")).groupBy(*keys, "keyword").agg(F.count(F.lit(1)).alias("count"), *seen)


def unmapped_keywords(counts: DataFrame, mapped: DataFrame) -> DataFrame:
    """Totals of the keywords that no mapping names."""
    return counts.join(mapped.select("keyword").distinct(), "keyword", "left_anti").groupBy("keyword").agg(F.sum("count").alias("count"))


def region_stats(df: DataFrame, region: Column, reviews: Column, rating: Column) -> DataFrame:
    """Branches, reviews and mean of the ratings that are neither null nor 0, by region."""
    return df.groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("branch_count"), F.sum(reviews).alias("review_count"), F.round(F.avg(F.nullif(rating, F.lit(0.0))), 2).alias("avg_rating"))


def rollup_categories(tags: DataFrame) -> DataFrame:
    """Tag statistics by category, without empty ones and blank names, with their ratios."""
    kept = tags.filter((F.col("total_count") > 0) & (F.trim(F.coalesce("category", F.lit(""))) != ""))
    sums = kept.groupBy("category").agg(*[F.sum(f"{p}_count").alias(f"{p}_count") for p in (*POLARITIES, "total")])
    return sums.withColumns({f"{p}_ratio": numbers.percent(F.col(f"{p}_count"), F.col("total_count")) for p in POLARITIES})


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """Rows per half-open bucket between edges; the last includes its end."""
    pairs = list(zip(edges[:-1], edges[1:], strict=True))
    cond = [(F.col(column) >= a) & ((F.col(column) <= b) if b == edges[-1] else (F.col(column) < b)) for a, b in pairs]
    return df.agg(*[F.count_if(c).alias(f"bucket_{i}") for i, c in enumerate(cond)])


def with_totals(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], prefixes: bool = False) -> DataFrame:
    """Aggregates by all keys (level 0) and of all rows, with prefixes by each shorter list of keys, too, from one pass and one shuffle.

    level is the number of keys left out, from the right; a key that is null in the data stays at its level.
    """
    sets = [list(keys[:n]) for n in range(len(keys), -1, -1) if prefixes or n in (0, len(keys))]
    level = F.bit_count(F.grouping_id()).cast("int")
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggregates, level.alias("level"))


def page_with_totals(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of groups, each with the number of groups and every aggregate of all rows (as total_...), one pass over df.

    Page and totals read the same groups, which are scanned and shuffled once: both take all columns, and the page's filter stands on a count, so that it
    isn't pushed below the shuffle on one side only.
    """
    groups = with_totals(df, keys, [*aggregates, F.count(F.lit(1)).alias("_n")])
    names = [c for c in groups.columns if c not in (*keys, "_n", "level")]
    single = F.col("level") < F.least(F.col("_n"), F.lit(1))
    overall = groups.agg(F.count_if(single).alias("groups"), *[F.max(F.when(~single, F.col(c))).alias(f"total_{c}") for c in names])
    page = groups.filter(single).drop("level", "_n").orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(overall), how="cross")
