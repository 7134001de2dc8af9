"""Mutations as functions of tables: each takes a base and a change and gives the new table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str], update: Sequence[str] | None = None, fixed: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of either table by key.  A row in both takes the update columns (by default all) from delta; fixed columns are set on every changed row.

    delta must have a key once.  update=() keeps the base's row, as where a conflict is to do nothing.
    """
    update = [c for c in base.columns if c not in key] if update is None else list(update)
    fixed = fixed or {}
    right = delta.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_n_{c}") for c in delta.columns if c not in key], F.lit(True).alias("_new"))
    cond = [base[k] == right[f"_k_{k}"] for k in key]
    both = base.withColumn("_old", F.lit(True)).join(right, cond, "full_outer")
    out = [F.coalesce(k, f"_k_{k}").alias(k) for k in key]
    for c in base.columns:
        if c in key:
            continue
        value = F.col(c)
        if f"_n_{c}" in right.columns:
            use = F.col("_new").isNotNull() & ((F.lit(c in update)) | F.col("_old").isNull())
            value = F.when(use, F.col(f"_n_{c}")).otherwise(value)
        if c in fixed:
            value = F.when(F.col("_new").isNotNull() & (F.lit(bool(update)) | F.col("_old").isNull()), fixed[c]).otherwise(value)
        out.append(value.alias(c))
    return both.select(*out).select(*base.columns)


def add(base: DataFrame, delta: DataFrame, key: Sequence[str], sums: Sequence[str], latest: Sequence[str] = ()) -> DataFrame:
    """Sums of both tables by key, null as 0, and the latest of other columns."""
    both = base.select(*key, *sums, *latest).unionByName(delta.select(*key, *sums, *latest))
    return both.groupBy(*key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def running_mean(old_mean: Column, old_count: Column, new_sum: Column, new_count: Column) -> Column:
    """Mean after more values, to two digits; null if there are none at all."""
    n = F.coalesce(old_count, F.lit(0)) + F.coalesce(new_count, F.lit(0))
    total = F.coalesce(old_mean, F.lit(0.0)) * F.coalesce(old_count, F.lit(0)) + F.coalesce(new_sum, F.lit(0.0))
    return F.when(n > 0, F.round(total / n, 2))


def insert_missing(master: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """master with the distinct trimmed names it lacks, which get the next keys in order of name."""
    new = names.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct().join(master.select(name), name, "left_anti")
    top = master.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = new.withColumn(key, F.row_number().over(Window.orderBy(name))).join(F.broadcast(top), how="cross").withColumn(key, F.col(key) + F.col("_top"))
    return master.unionByName(numbered.select(*[F.col(c) if c in (name, key) else F.lit(None).alias(c) for c in master.columns]))


def set_values(base: DataFrame, values: DataFrame, on: str, column: str) -> DataFrame:
    """The column of base replaced where values has a row for it."""
    right = values.select(F.col(on).alias("_on"), F.col(column).alias("_v"))
    return base.join(right, F.col(on) == F.col("_on"), "left").withColumn(column, F.coalesce("_v", column)).drop("_on", "_v").select(*base.columns)


def mark_read(base: DataFrame, ids: DataFrame | None = None, key: str = "review_id") -> DataFrame:
    """is_new false everywhere, or for the ids only."""
    if ids is None:
        return base.withColumn("is_new", F.lit(False))
    hit = ids.select(F.col(key).alias("_on")).distinct()
    return base.join(hit, F.col(key) == F.col("_on"), "left").withColumn("is_new", F.col("is_new") & F.col("_on").isNull()).select(*base.columns)


def delete(base: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.join(ids.select(*key).distinct(), list(key), "left_anti")


def delete_cascade(reviews: DataFrame, mappings: DataFrame, ids: DataFrame, key: str = "review_id") -> tuple[DataFrame, DataFrame]:
    return delete(reviews, ids, [key]), delete(mappings, ids, [key])


def ghosts(local: DataFrame, lake: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held here that the lake no longer has."""
    return local.select(*key).distinct().join(lake.select(*key).distinct(), list(key), "left_anti")


def orphan(tags: DataFrame, categories: DataFrame, category_id: int) -> tuple[DataFrame, DataFrame]:
    """Without a category; its tags have none."""
    return tags.withColumn("category_id", F.when(F.col("category_id") != category_id, F.col("category_id"))), categories.filter(F.col("id") != category_id)


def remap(mappings: DataFrame, legacy: DataFrame, key: Sequence[str], column: str, order: Sequence[Column]) -> DataFrame:
    """Old values of a column replaced by new ones (old, new); of rows that then share a key one stays, those that had the new value first."""
    changed = mappings.join(legacy.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(column) == F.col("_old"), "left")
    changed = changed.withColumn("_moved", F.col("_new").isNotNull().cast("int")).withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    rn = F.row_number().over(Window.partitionBy(*key).orderBy("_moved", *order))
    return changed.withColumn("_rn", rn).filter("_rn = 1").drop("_rn", "_moved")


def summary_for(base: DataFrame, period: str, text: Column, when: Column, periods: Sequence[str] = ("1m", "3m", "6m", "1y", "all")) -> DataFrame:
    """One summary column set and the other four emptied, on the rows that the condition names."""
    return base.withColumns({f"summary_{p}": F.when(when, text if p == period else F.lit(None)).otherwise(F.col(f"summary_{p}")) for p in periods})


def pending_set(pending: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(F.coalesce(pending, F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(F.lit(key), value))


def pending_drop(pending: Column, key: str) -> Column:
    return F.map_filter(pending, lambda k, _: k != key)


def expire_jobs(jobs: DataFrame, as_of: Column, keep_days: int = 7, stale_minutes: int = 30) -> DataFrame:
    """Finished jobs older than some days go; those processing for too long have failed."""
    done = F.col("status").isin("completed", "failed") & (F.col("updated_at") < as_of - F.make_interval(days=F.lit(keep_days)))
    stale = (F.col("status") == "processing") & (F.col("updated_at") < as_of - F.make_interval(mins=F.lit(stale_minutes)))
    return jobs.filter(~F.coalesce(done, F.lit(False))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def decayed(branch_tags: DataFrame, rate: float = 0.01, floor: float = 0.01) -> DataFrame:
    """Weights of whole-period tags one day later."""
    return branch_tags.withColumn("weighted_score", F.when(F.col("period_type") == "all", numbers.daily_decay(F.col("weighted_score"), rate, floor)).otherwise(F.col("weighted_score")))


def newly_read(base: DataFrame, ids: DataFrame | None = None, key: str = "review_id") -> DataFrame:
    """One row, changed: how many rows ``mark_read`` touches with the same arguments.

    Without ids these are the rows that are new; with ids all rows of them, new or not.
    """
    hit = base.filter(F.coalesce("is_new", F.lit(False))) if ids is None else base.join(ids.select(key).distinct(), key, "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("changed"))


# Columns of a summary that may be set one by one.
UPDATABLE = ("summary_all", "summary_1y", "summary_6m", "summary_3m", "summary_1m", "status", "keywords")


def patched(base: DataFrame, values: Mapping[str, Column], when: Column, allowed: Sequence[str] = UPDATABLE) -> DataFrame:
    """Some columns set on the rows that a condition holds for; ValueError for a column that may not be set or isn't there."""
    if wrong := [c for c in values if c not in allowed or c not in base.columns]:
        raise ValueError(f"not to be updated: {', '.join(wrong)}")
    hit = F.coalesce(when, F.lit(False))
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})
