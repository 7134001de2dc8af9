"""Report algebra: strengths, trends, rankings, actions and cache policy over tag statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import numbers
from .joins import aligned
from .ranking import first_max, top_n


def with_fallback(period_tags: DataFrame, all_tags: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The period's tag statistics, or those of all time where it has too few tags; only as many rows as decide are counted."""
    return period_tags if period_tags.limit(config.min_tag_rows).count() >= config.min_tag_rows else all_tags


def strengths(categories: DataFrame, n: int = 3, config: EngineConfig = DEFAULT) -> DataFrame:
    """Categories by positive share, best first, whose rounded share is enough; ties by name."""
    share = F.when(F.col("total_count") > 0, F.col("positive_count") / F.col("total_count")).otherwise(0.0)
    return _best(categories, share, "positive_ratio", config.strength_percent, n)


def improvements(categories: DataFrame, n: int = 3, config: EngineConfig = DEFAULT) -> DataFrame:
    share = F.when(F.col("total_count") > 0, F.col("negative_count") / F.col("total_count")).otherwise(0.0)
    return _best(categories, share, "negative_ratio", config.weakness_percent, n)


def _best(categories: DataFrame, share: Column, ratio: str, least: int, n: int) -> DataFrame:
    label = F.concat("category", F.lit("("), F.col(ratio).cast("string"), F.lit("%)"))
    return categories.filter(F.col(ratio) >= least).orderBy(share.desc(), F.asc("category")).limit(n).select("category", F.col(ratio).alias("ratio"), label.alias("label"))


def trend(now: DataFrame, before: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Change of the positive percent of each category against the window before, largest first."""
    both = aligned(now, before, "category", ["positive_count", "total_count"])
    both = both.withColumns({"current_ratio": numbers.percent(F.col("positive_count"), F.col("total_count")), "previous_ratio": numbers.percent(F.col("before_positive_count"), F.col("before_total_count"))})
    change = F.col("current_ratio") - F.col("previous_ratio")
    direction = F.when(change >= config.trend_points, "up").when(change <= -config.trend_points, "down").otherwise("stable")
    return both.select("category", "current_ratio", "previous_ratio", change.alias("change"), direction.alias("direction")).orderBy(F.abs("change").desc(), F.asc("category"))


def top_tags(categories: DataFrame, polarity: str, n: int = 5) -> DataFrame:
    """Categories of most rows of a polarity, with their ratio."""
    c = f"{polarity}_count"
    return categories.filter(F.col(c) > 0).orderBy(F.desc(c), F.asc("category")).limit(n).select("category", F.col(c).alias("count"), F.col(f"{polarity}_ratio").alias("ratio"))


def vehicles(models: DataFrame, tags: DataFrame) -> DataFrame:
    """Per model: mood from 0 to 1, like and dislike percent, and its most praised and most blamed tag.

    models has car_model and polarity counts; tags has them by car_model and tag.
    """
    mood = F.round((F.col("positive_count") - F.col("negative_count")) / F.col("total_count") / 2 + 0.5, 2)
    named = lambda c: F.concat("tag", F.lit("("), F.col(c).cast("string"), F.lit(")"))
    praise = first_max(tags.filter("positive_count > 0"), ["car_model"], "positive_count", "tag").select(F.col("car_model").alias("_p"), named("positive_count").alias("top_praise"))
    issue = first_max(tags.filter("negative_count > 0"), ["car_model"], "negative_count", "tag").select(F.col("car_model").alias("_i"), named("negative_count").alias("top_issue"))
    out = models.join(praise, F.col("car_model") == F.col("_p"), "left").join(issue, F.col("car_model") == F.col("_i"), "left")
    return out.select("car_model", "total_count", mood.alias("mood"), numbers.percent(F.col("positive_count"), F.col("total_count")).alias("like_percent"), numbers.percent(F.col("negative_count"), F.col("total_count")).alias("dislike_percent"), "top_praise", "top_issue")


def vehicle_rankings(tags: DataFrame, polarity: str, n: int = 5, per_model: int = 2) -> DataFrame:
    """Models of most rows of a polarity, each with its first tags, joined in order."""
    c = f"{polarity}_count"
    first = top_n(tags.filter(F.col(c) > 0), ["car_model"], [F.desc(c), F.asc("tag")], per_model)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag", F.col(c).alias("n")))), lambda x: F.concat(x["tag"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", ")
    totals = tags.groupBy("car_model").agg(F.sum(c).alias("count"), F.sum("total_count").alias("total_count"))
    return totals.join(first.groupBy("car_model").agg(text.alias("tags")), "car_model").orderBy(F.desc("count"), F.desc("total_count"), F.asc("car_model")).limit(n)


def priority_actions(categories: DataFrame, tags: DataFrame, texts: dict[str, str], default: str, n: int = 5, config: EngineConfig = DEFAULT) -> DataFrame:
    """Categories with negative rows of enough share, ranked, with their impact, their worst tag and a stated text."""
    worst = first_max(tags.filter("negative_count > 0"), ["category"], "negative_count", "tag").select(F.col("category").alias("_c"), F.col("tag").alias("worst_tag"))
    impact = F.when(F.col("negative_ratio") >= config.action_high, "high").when(F.col("negative_ratio") >= config.action_medium, "medium").otherwise("low")
    action = F.lit(default)
    for name, text in texts.items():
        action = F.when(F.col("category") == name, text).otherwise(action)
    kept = categories.filter((F.col("negative_count") > 0) & (F.col("negative_ratio") >= config.action_percent)).join(worst, F.col("category") == F.col("_c"), "left")
    first = kept.orderBy(F.desc("negative_ratio"), F.asc("category")).limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("negative_ratio"), F.asc("category")))
    return first.select(rank.alias("rank"), "category", "negative_ratio", impact.alias("impact"), "worst_tag", action.alias("action"))


def stale_cache(new_reviews: Column, saved_total: Column, total: Column, saved_positive: Column, positive: Column, config: EngineConfig = DEFAULT) -> Column:
    """Whether a saved report is out of date: enough new reviews and enough change of the tag total or of the positive percent."""
    change = F.abs(total - saved_total) * 100.0 / saved_total
    drift = F.abs(positive * 100.0 / total - saved_positive * 100.0 / saved_total)
    moved = (change >= config.change_percent) | (F.coalesce(drift, F.lit(0.0)) >= config.drift_points)
    return F.when(F.coalesce(saved_total, F.lit(0)) == 0, new_reviews >= config.min_reviews).otherwise((new_reviews >= config.new_reviews) & moved)


def coverage(tagged: Column, total: Column) -> Column:
    return numbers.percent(tagged, total)


def assembled(head: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per row of head, with the rows of each part as a list in order of their columns."""
    out = head
    for name, part in parts.items():
        columns = [c for c in part.columns if c != key]
        rows = part.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, F.col(key) == F.col("_key"), "left").drop("_key")
    return out.select(key, F.to_json(F.struct(*[c for c in out.columns if c != key])).alias("report"))


def windows(reviews: DataFrame, branch: str, date: str, months: Mapping[str, int]) -> DataFrame:
    """For each branch and label: start and end (its day after the last review) of so many months, and before, the start of the equal length ahead of it."""
    last = reviews.filter(F.col(date).isNotNull()).groupBy(branch).agg((F.max(F.col(date).cast("date")) + F.expr("interval 1 day")).cast("date").alias("end"))
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(n).alias("months")) for label, n in months.items()]))
    spans = last.withColumn("w", pairs).select(branch, "w.label", F.add_months("end", -F.col("w.months")).alias("start"), "end")
    return spans.withColumn("before", F.date_sub("start", F.date_diff("end", "start")))


def window_trend(reviews: DataFrame, spans: DataFrame, branch: str, date: str, positive: Column, bucket_days: int = 32, config: EngineConfig = DEFAULT) -> DataFrame:
    """Positive percent of each branch's windows and of the equal lengths ahead of them, with change and direction; all branches and labels in one pass.

    Reviews are counted by day first; a window meets the days of its branch by buckets of days, so the join has only equal keys.  Windows are half-open.
    Without a review ahead of it a window has null for what came before, the change and the direction; without one inside, too.
    """
    days = reviews.filter(F.col(date).isNotNull()).groupBy(branch, F.col(date).cast("date").alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(positive).alias("_p"))
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / bucket_days)
    days = days.withColumn("_bucket", bucket(F.col("_day")))
    wide = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("before")), bucket(F.date_sub("end", 1)))))
    keys = [branch, "label", "start", "end", "before"]
    now, ahead = F.col("_day") >= F.col("start"), F.col("_day") < F.col("start")
    met = wide.join(days, [branch, "_bucket"], "left")
    inside = (F.col("_day") >= F.col("before")) & (F.col("_day") < F.col("end"))
    total = lambda column, when: F.coalesce(F.sum(F.when(inside & when, F.col(column))), F.lit(0))
    got = met.groupBy(*keys).agg(total("_n", now).alias("review_count"), total("_p", now).alias("positive_count"), total("_n", ahead).alias("before_count"), total("_p", ahead).alias("before_positive"))
    known = (F.col("review_count") > 0) & (F.col("before_count") > 0)
    got = got.withColumns({"ratio": numbers.percent(F.col("positive_count"), F.col("review_count")), "before_ratio": F.when(F.col("before_count") > 0, numbers.percent(F.col("before_positive"), F.col("before_count")))})
    got = got.withColumn("change", F.when(known, F.col("ratio") - F.col("before_ratio")))
    direction = F.when(F.col("change") >= config.trend_points, "up").when(F.col("change") <= -config.trend_points, "down").when(F.col("change").isNotNull(), "stable")
    return got.withColumn("direction", direction)


def recommended_window(trends: DataFrame, branch: str, months: Mapping[str, int], config: EngineConfig = DEFAULT) -> DataFrame:
    """Of each branch the shortest window with enough reviews, else 'all'."""
    enough = F.when(F.col("review_count") >= config.min_reviews, F.element_at(F.create_map(*[F.lit(x) for pair in months.items() for x in pair]), F.col("label")))
    return trends.groupBy(branch).agg(F.coalesce(F.min_by("label", enough), F.lit("all")).alias("recommended"))


def grouped_tags(recent: DataFrame, whole: DataFrame, branch: str, config: EngineConfig = DEFAULT, n: int = 15, other: str = "기타") -> DataFrame:
    """Of each branch its n most used tags by category, as rows of category, place and tags (name, positive and negative percent, total).

    recent and whole have branch, tag, category and polarity counts, one row a tag; a branch with too few recent tags shows those of whole instead.
    Categories stand in the order of their first tag, tags by total, then name; a null category is the other one, and tags without a name are left
    out after the cut.
    """
    def summed(df: DataFrame, name: str) -> DataFrame:
        return df.select(branch, "tag", F.coalesce("category", F.lit(other)).alias("category"), "positive_count", "negative_count", "total_count", F.lit(name).alias("_of"))

    enough = recent.groupBy(branch).agg(F.count(F.lit(1)).alias("_tags")).select(F.col(branch).alias("_branch"), F.when(F.col("_tags") >= config.min_tag_rows, "recent").otherwise("whole").alias("_use"))
    both = summed(recent, "recent").unionByName(summed(whole, "whole")).join(enough, F.col(branch).eqNullSafe(F.col("_branch")), "left")
    rows = both.filter(F.col("_of") == F.coalesce("_use", F.lit("whole"))).drop("_branch", "_use", "_of")
    first = top_n(rows, [branch], [F.desc("total_count"), F.asc("tag")], n).filter(F.coalesce("tag", F.lit("")) != "")
    entry = F.struct(
        "rank", F.struct(F.col("tag").alias("name"), numbers.percent(F.col("positive_count"), F.col("total_count")).alias("positive_ratio"), numbers.percent(F.col("negative_count"), F.col("total_count")).alias("negative_ratio"), F.col("total_count").alias("total")).alias("tag"),
    )
    grouped = first.groupBy(branch, "category").agg(F.min("rank").alias("_first"), F.array_sort(F.collect_list(entry)).alias("_tags"))
    place = F.row_number().over(Window.partitionBy(branch).orderBy("_first"))
    return grouped.select(branch, "category", place.alias("place"), F.transform("_tags", lambda x: x["tag"]).alias("tags"))


# Classes of cars, which stand for models where none is known.
CAR_CLASSES = ("경형", "소형", "준중형", "중형", "대형", "SUV", "RV", "수입")


def model_ranking(tags: DataFrame, analysis: DataFrame, categories: Sequence[str], n: int = 5, per_model: int = 2, classes: Sequence[str] = CAR_CLASSES, unit: str = "건") -> DataFrame:
    """The most liked and most disliked models: list, place, model, count, ratio (rows of the polarity) and tags.

    tags has car_model, tag, category and polarity counts, one row a tag of a model; analysis has car_model, count, like_ratio, dislike_ratio, top_praise,
    top_issue.  Of a model only tags of the given categories count, and of these those that aren't named like their category, if it has such ones.  A model's
    count is that of analysis, unless it is 0 or missing.  Where tags are empty or know classes of cars only, everything is taken from analysis, models
    without a name or count left out.  Equal models stand by name.
    """
    known = tags.agg(F.coalesce(F.bool_and(F.col("car_model").isin(*classes)), F.lit(True)).alias("_from_analysis"))
    kept = tags.filter(F.col("category").isin(*categories) & (F.col("total_count") > 0)).withColumn("_sub", F.col("tag") != F.col("category"))
    subs = kept.groupBy(F.col("car_model").alias("_m")).agg(F.bool_or("_sub").alias("_has_sub"))
    shown = kept.join(subs, F.col("car_model") == F.col("_m")).filter(F.col("_sub") | ~F.col("_has_sub"))

    def best(polarity: str) -> DataFrame:
        c = f"{polarity}_count"
        ranked = top_n(shown.filter(F.col(c) > 0), ["car_model"], [F.desc(c), F.asc("tag")], per_model)
        label = F.concat("tag", F.lit("("), F.col(c).cast("string"), F.lit(f"{unit})"))
        return ranked.groupBy(F.col("car_model").alias(f"_{polarity}")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("s")))), lambda x: x["s"]).alias(f"{polarity}_tags"))

    none = F.array().cast("array<string>")
    models = tags.groupBy("car_model").agg(F.sum("total_count").alias("_total"))
    sums = shown.groupBy(F.col("car_model").alias("_s")).agg(F.sum("positive_count").alias("positive"), F.sum("negative_count").alias("negative"))
    own = analysis.select(F.col("car_model").alias("_a"), F.nullif("count", F.lit(0)).alias("_count"))
    raw = models.join(own, F.col("car_model") == F.col("_a"), "left").join(sums, F.col("car_model") == F.col("_s"), "left")
    for p in ("positive", "negative"):
        raw = raw.join(best(p), F.col("car_model") == F.col(f"_{p}"), "left")
    raw = raw.select("car_model", F.coalesce("_count", "_total").alias("count"), *[F.coalesce(p, F.lit(0)).alias(p) for p in ("positive", "negative")], *[F.coalesce(f"{p}_tags", none).alias(f"{p}_tags") for p in ("positive", "negative")])
    share = lambda ratio: F.floor(F.col("count") * F.coalesce(ratio, F.lit(0)) / 100)
    one = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(none)
    plain = analysis.filter((F.coalesce("car_model", F.lit("")) != "") & (F.coalesce("count", F.lit(0)) != 0)).select("car_model", "count", share("like_ratio").alias("positive"), share("dislike_ratio").alias("negative"), one("top_praise").alias("positive_tags"), one("top_issue").alias("negative_tags"))
    items = raw.withColumn("_mine", F.lit(False)).unionByName(plain.withColumn("_mine", F.lit(True))).join(F.broadcast(known), how="cross").filter(F.col("_mine") == F.col("_from_analysis"))

    def top(name: str, polarity: str, rows: DataFrame) -> DataFrame:
        order = [F.desc(polarity), F.desc("count"), F.asc("car_model")]
        first = rows.orderBy(*order).limit(n)
        return first.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("place"), "car_model", "count", F.col(polarity).alias("ratio"), F.col(f"{polarity}_tags").alias("tags"))

    return top("liked", "positive", items).unionByName(top("disliked", "negative", items.filter(F.col("negative") > 0)))
