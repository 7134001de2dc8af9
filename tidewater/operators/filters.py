"""Filters and lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text


def all_of(conditions: Sequence[Column | None]) -> Column:
    """Conjunction of the conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def search(df: DataFrame, equal: Mapping[str, object] | None = None, within: Mapping[str, Sequence] | None = None, date: str = "review_date", start: object = None, end: object = None) -> DataFrame:
    """Rows that meet every filter given: equal values, values of a short list, and a half-open range of a date column."""
    parts: list[Column | None] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    parts += [F.col(c).isin(list(v)) for c, v in (within or {}).items() if v is not None]
    parts.append(dates.half_open(F.col(date), start, end) if start is not None or end is not None else None)
    return df.filter(all_of(parts))


def keys_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key, of one or several columns, is in a table."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def keys_not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def in_all(ids: Sequence[DataFrame], on: str) -> DataFrame:
    """Ids that every filter names; one that names none leaves none."""
    return reduce(lambda a, b: a.join(b.select(on).distinct(), on, "left_semi"), ids).select(on).distinct()


def negative_reviews(df: DataFrame, ratings: Sequence[str], at_most: float = 3, content: str | None = None, deleted: str | None = None) -> DataFrame:
    """Negative by sentiment or by any rating; without blank contents and deleted rows where these columns are named."""
    bad = any_of([F.col("sentiment") == "negative", *[F.col(r) <= at_most for r in ratings]])
    extra = [F.trim(content) != "" if content else None, F.col(deleted).isNull() if deleted else None]
    return df.filter(all_of([bad, *extra]))


def named(df: DataFrame, column: str, keyword: str, id_column: str | None = None, prefix: bool = False) -> DataFrame:
    """Rows whose column holds a keyword, in any case; a keyword of digits may also be the id."""
    cond = F.col(column).ilike(f"{keyword}%" if prefix else f"%{keyword}%")
    if id_column and keyword.isdigit():
        cond = cond | (F.col(id_column) == int(keyword))
    return df.filter(cond)


def valid_reviews(df: DataFrame, hidden: Sequence[str] = ("blind", "deleted", "블라인드", "삭제"), least: int = 5) -> DataFrame:
    """Contents of some length that aren't hidden, by their status or, where the table has one, by their flag."""
    blind = F.coalesce(F.col("is_blind").cast("boolean"), F.lit(False)) if "is_blind" in df.columns else F.lit(False)
    return df.filter((F.length(F.trim("content")) >= least) & ~blind & ~F.coalesce(F.lower(F.trim("status")).isin(list(hidden)), F.lit(False)))


def without_words(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Rows whose text holds none of the words; null texts stay."""
    return df.filter(~F.coalesce(text.contains_any(F.col(column), words), F.lit(False)))


def misrouted(df: DataFrame, branch: str, company: str, share: float = 0.8) -> DataFrame:
    """Rows with ``dropped``: true for a branch's other companies where one company has at least that share of those named.

    Of companies with as many rows the first by name leads.  Rows without a branch or a company are never dropped.
    """
    blank = F.trim(F.coalesce(F.col(company).cast("string"), F.lit(""))) == ""
    counts = df.filter(~blank & F.col(branch).isNotNull()).groupBy(F.col(branch).alias("_b"), F.col(company).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    lead = counts.groupBy("_b").agg(F.sum("_n").alias("_all"), F.min_by("_c", F.struct(-F.col("_n"), F.col("_c"))).alias("_top"), F.max("_n").alias("_most"))
    lead = lead.filter(F.col("_most") >= F.lit(share) * F.col("_all")).select("_b", "_top")
    return df.join(lead, F.col(branch) == F.col("_b"), "left").withColumn("dropped", F.coalesce(~blank & (F.col(company) != F.col("_top")), F.lit(False))).drop("_b", "_top")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of a totally ordered result."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page whose rows carry the number of all rows, counted apart from the page."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, offset, limit).join(F.broadcast(total), how="cross")


SORTABLE = {"review_count", "avg_rating", "branch_name", "branch_id"}


def sort_by(df: DataFrame, column: str, descending: bool, allowed: set[str] = frozenset(SORTABLE), default: str = "branch_id") -> DataFrame:  # type: ignore[assignment]
    """Order by a listed column, nulls last either way, then by the default; other names fall back to the default."""
    c = F.col(column if column in allowed else default)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(default).asc_nulls_last())


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.filter(F.col(column) == value).limit(1)


def active(df: DataFrame, column: str = "deleted_at", only: bool = True) -> DataFrame:
    """Rows that aren't soft-deleted, if asked for."""
    return df.filter(F.col(column).isNull()) if only else df


def period_filter(df: DataFrame, date: str, period: str, as_of: dt.date) -> DataFrame:
    first, last = dates.resolve_period(period, as_of)
    return df.filter(dates.half_open(F.col(date), first, last + dt.timedelta(days=1)))


def json_not_empty(document: Column) -> Column:
    """Whether a JSON object has a key; null, broken and empty ones have none."""
    return F.coalesce(F.size(F.json_object_keys(document)) > 0, F.lit(False))
