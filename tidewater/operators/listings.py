"""Listings: pickers, catalogues, jobs and pages, and the aggregates behind them.  Each takes and returns DataFrames; nothing acts on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, sentiment, text
from . import aggregates as agg
from . import merge


def tag_list(tags: DataFrame, group: object = None, category: object = None, active: bool | None = None) -> DataFrame:
    """Tags of a group, or else of a category, by category, display order and name."""
    if group is not None:
        tags = tags.filter(F.col("group_name") == F.lit(group))
    elif category is not None:
        tags = tags.filter(F.col("category") == F.lit(category))
    if active is not None:
        tags = tags.filter(F.col("is_active") == F.lit(active))
    return tags.orderBy(*[F.asc_nulls_last(c) for c in ("category", "display_order", "name")])


def catalogue(df: DataFrame, active: str | None = None, same: Mapping[str, object] | None = None, or_null: Sequence[str] = ()) -> DataFrame:
    """Active entries whose columns have the values given; for some columns null fits every value."""
    if active:
        df = df.filter(F.col(active))
    for column, value in (same or {}).items():
        fits = F.col(column) == F.lit(value)
        df = df.filter(fits | F.col(column).isNull() if column in or_null else fits)
    return df


def untagged(reviews: DataFrame, mappings: DataFrame, key: str, content: str, least: int = 5, deleted: str | None = None) -> DataFrame:
    """Reviews with a content of some length that no mapping names."""
    some = reviews.filter(F.length(content) >= least)
    if deleted:
        some = some.filter(F.col(deleted).isNull())
    return some.join(mappings.select(key).distinct(), key, "left_anti")


def newest_job(jobs: DataFrame, key: Sequence[str], status: str, states: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key, the first job in one of the states."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return jobs.filter(F.col(status).isin(*states)).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def new_or_all(reviews: DataFrame, branch: str, is_new: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of each branch's new reviews, or of all where it has none, with the number of those (total) and whether it fell back.

    Branches are counted first and joined back; the rank alone is a window, which Spark cuts to the page's end in each task before the shuffle, so a
    frequent branch sends no more than that from a task.  A null branch is one of its own.
    """
    counts = reviews.groupBy(F.col(branch).alias("_branch")).agg(F.count_if(F.col(is_new)).alias("_new"), F.count(F.lit(1)).alias("_all"))
    counts = counts.select("_branch", (F.col("_new") == 0).alias("fell_back"), F.when(F.col("_new") == 0, F.col("_all")).otherwise(F.col("_new")).alias("total"))
    shown = reviews.join(counts, F.col(branch).eqNullSafe(F.col("_branch"))).drop("_branch").filter(F.col(is_new) | F.col("fell_back"))
    ranked = shown.withColumn("place", F.row_number().over(Window.partitionBy(branch).orderBy(*order))).filter(F.col("place") <= offset + limit)
    return ranked.filter(F.col("place") > offset)


def pick(branches: DataFrame, key: str, name: str | None = None, region: str | None = None, prefix: str | None = None) -> DataFrame:
    """Branches, of regions that start with a prefix, by name or else by id."""
    if region and prefix is not None:
        branches = branches.filter(F.startswith(region, F.lit(prefix)))
    return branches.orderBy(F.asc_nulls_last(name) if name else F.asc(key), key)


def replaced_targets(targets: DataFrame, group: str, value: object, ids: DataFrame, branches: DataFrame, key: str, name: str) -> DataFrame:
    """Targets with one group's rows replaced by the given ids, with their branch's name."""
    own = ids.select(key).distinct().join(branches.select(key, name), key, "left").withColumn(group, F.lit(value).cast(targets.schema[group].dataType))
    return targets.filter(F.col(group) != F.lit(value)).unionByName(own.select(*targets.columns))


def judged_page(df: DataFrame, column: str, value: str, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of the rows whose computed column has a value, with the exact total: rows are judged first, then counted and cut."""
    kept = df.filter(F.col(column) == value)
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def by_name(mappings: DataFrame, reviews: DataFrame, tags: DataFrame, categories: DataFrame, review: str, tag: str, category: str) -> DataFrame:
    """Mappings with their review and tag, of tags whose category is among some."""
    wanted = tags.join(categories.select(category).distinct(), category, "left_semi")
    return mappings.join(reviews, review).join(wanted, tag)


def model_totals(counts: DataFrame, model: str, tag: str) -> DataFrame:
    """Of each model the totals by polarity and a map from tag to its counts, from rows at any finer key."""
    sums = counts.groupBy(model, tag).agg(*[F.sum(F.coalesce(f"{p}_count", F.lit(0))).alias(p) for p in agg.POLARITIES])
    sums = sums.withColumn("total", sum((F.col(p) for p in agg.POLARITIES), F.lit(0)))
    entry = F.struct(F.col(tag).alias("key"), F.struct(*agg.POLARITIES, "total").alias("value"))
    return sums.groupBy(model).agg(
        F.sum("positive").alias("total_positive"), F.sum("negative").alias("total_negative"), F.sum("total").alias("total_count"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tags")
    )


def with_analysis(raw: DataFrame, analysis: DataFrame, model: str) -> DataFrame:
    """Models' totals with their analysis: its count unless that is 0, and its ratios, or else those of the totals."""
    right = analysis.select(F.col(model).alias("_m"), F.col("count").alias("_count"), F.col("like_ratio").alias("_like"), F.col("dislike_ratio").alias("_dislike"))
    both = raw.join(right, raw[model] == right["_m"], "left")
    ratio = lambda own, part: F.when(F.col("_m").isNull(), numbers.percent(F.col(part), F.col("total_count"))).otherwise(F.col(own))
    return both.withColumns({"count": F.coalesce(F.nullif(F.col("_count"), F.lit(0)), "total_count"), "like_ratio": ratio("_like", "total_positive"), "dislike_ratio": ratio("_dislike", "total_negative")}).drop("_m", "_count", "_like", "_dislike")


def counts_between(df: DataFrame, key: str, dates: Sequence[str], start: object, end: object) -> DataFrame:
    """Rows of each key with each of some dates in a half-open range, in one pass."""
    inside = lambda c: (F.col(c) >= F.lit(start).cast("timestamp_ntz")) & (F.col(c) < F.lit(end).cast("timestamp_ntz"))
    return df.groupBy(key).agg(*[F.count_if(inside(c)).alias(f"n_{c}") for c in dates])


def lake_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key of a table of strings; keys that are no numbers go."""
    number = F.expr(f"try_cast(`{key}` AS BIGINT)")
    return df.select(number.alias(key)).filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def tag_groups(tags: DataFrame, other: str = "기타") -> DataFrame:
    return tags.groupBy(F.coalesce("group_name", F.lit(other)).alias("group_name")).agg(F.min("color").alias("color"), F.count(F.lit(1)).alias("count"))


def routing(df: DataFrame, branch: str, company: str) -> DataFrame:
    """Reviews by branch and company, most first."""
    return df.groupBy(branch, company).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), branch, company)


def period_tags(monthly: DataFrame, branch: str, tag: str, period: str, start: str, n: int = 15, least: int = 3) -> DataFrame:
    """Of each branch with enough tags since a month, its most used ones with their ratios."""
    sums = monthly.filter(F.col(period) >= start).groupBy(branch, tag).agg(*[F.sum(F.coalesce(f"{p}_count", F.lit(0))).alias(p) for p in agg.POLARITIES])
    sums = sums.withColumn("total", sum((F.col(p) for p in agg.POLARITIES), F.lit(0)))
    of = Window.partitionBy(branch)
    ranked = sums.withColumns({"_tags": F.count(F.lit(1)).over(of), "rank": F.row_number().over(of.orderBy(F.desc("total"), tag))})
    kept = ranked.filter((F.col("_tags") >= least) & (F.col("rank") <= n)).drop("_tags")
    return kept.withColumns({f"{p}_ratio": numbers.percent(F.col(p), F.col("total")) for p in ("positive", "negative")})


def rating_stats(df: DataFrame, rating: str, edges: Sequence[float] = (4.5, 4.0, 3.5, 3.0)) -> DataFrame:
    """Least, largest and mean rating, and how many are in each band, from the top down; null ones aren't counted."""
    r = F.col(rating)
    bands, above = {}, None
    for edge in edges:
        bands[f"from_{edge:g}".replace(".", "_")] = F.count_if((r >= edge) & (r < above) if above is not None else r >= edge)
        above = edge
    bands["below"] = F.count_if(r < edges[-1])
    return df.agg(F.min(r).alias("min"), F.max(r).alias("max"), F.avg(r).alias("avg"), F.count(r).alias("total"), *[c.alias(n) for n, c in bands.items()])


def top_vehicles(models: DataFrame, model: str, n: int = 5) -> DataFrame:
    return models.orderBy(F.desc("count"), model).limit(n)


def dated_summaries(summaries: DataFrame, reviews: DataFrame, branch: str, date: str, start: object, end: object) -> DataFrame:
    """Summaries of the branches that have reviews in a range, with those counted instead of all."""
    counted = counts_between(reviews, branch, [date], start, end).filter(F.col(f"n_{date}") > 0).select(F.col(branch).alias("_b"), F.col(f"n_{date}").alias("_n"))
    return summaries.join(counted, summaries[branch] == counted["_b"]).withColumn("review_count", F.col("_n")).drop("_b", "_n")


def model_page(tags: DataFrame, reviews: DataFrame, model: str, tag: str) -> DataFrame:
    """A row for each model: its reviews, and its tags by total, most first."""
    totals = tags.groupBy(model, tag).agg(F.count(F.lit(1)).alias("total"))
    listed = totals.groupBy(model).agg(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), F.col(tag).alias("tag")))).alias("_tags"))
    counted = reviews.groupBy(F.col(model).alias("_m")).agg(F.count(F.lit(1)).alias("review_count"))
    made = F.transform("_tags", lambda x: F.struct(x["tag"].alias("tag"), (-x["o"]).alias("total")))
    return listed.join(counted, listed[model] == counted["_m"], "left").select(model, F.coalesce("review_count", F.lit(0)).alias("review_count"), made.alias("tags")).orderBy(model)


def vehicle_line(models: DataFrame, n: int = 5) -> DataFrame:
    """One text of the most reviewed models: name, reviews, likes, and praise and issue where there are some."""
    likes = F.when(F.col("count") > 0, F.bround(F.col("count") * F.col("like_ratio") / 100)).otherwise(0).cast("long")
    praise = F.when(F.coalesce("top_praise", F.lit("")) != "", F.concat(F.lit(", 강점: "), "top_praise")).otherwise("")
    issue = F.when(F.coalesce("top_issue", F.lit("")) != "", F.concat(F.lit(", 개선: "), "top_issue")).otherwise("")
    line = F.concat("model", F.lit("("), F.col("count").cast("string"), F.lit("건, 호평 "), likes.cast("string"), F.lit("건"), praise, issue, F.lit(")"))
    some = models.orderBy(F.desc("count"), "model").limit(n).select((-F.col("count")).alias("o"), "model", line.alias("line"))
    return some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "model", "line"))), lambda x: x["line"]), ", ").alias("summary"))


def strong_and_weak(tags: DataFrame, key: str, tag: str, strong: int = 60, weak: int = 20) -> DataFrame:
    """Of each key, its tags with a high positive and those with a high negative ratio, as texts by total, and the ratio over all."""
    item = lambda ratio, mark: F.struct((-F.col("total_count")).alias("o"), F.col(tag).alias("t"), F.concat(F.col(tag), F.lit(f" {mark}"), ratio.cast("string"), F.lit("%")).alias("s"))
    up, down = numbers.percent(F.col("positive_count"), F.col("total_count")), numbers.percent(F.col("negative_count"), F.col("total_count"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"]), ", ")
    return tags.groupBy(key).agg(
        joined(F.when(up >= strong, item(up, "+"))).alias("strong"), joined(F.when(down >= weak, item(down, "-"))).alias("weak"),
        numbers.percent(F.sum("positive_count"), F.sum("total_count")).alias("positive_ratio"),
    )


def report_warnings(report: Column, negative_ratio: Column, words: Sequence[str] = ("개선", "부정", "아쉬", "부족", "불만", "낮은", "높은 부정")) -> Column:
    """What a report lacks: a word on what to improve where many are negative, and at least two figures."""
    silent = (negative_ratio >= 20) & ~report.rlike(text.quoted(words))
    bare = F.regexp_count(report, F.lit("(?U)\\d+[%건개]")) < 2
    return F.array_compact(F.array(F.when(silent, "no word on improvement"), F.when(bare, "too few figures")))


def enough(head: DataFrame, reviews: str = "review_count", least: int = 30) -> DataFrame:
    """Those with enough reviews for a report."""
    return head.filter(F.col(reviews) >= least)


def tag_rows(processed: DataFrame, tags: DataFrame, review: str, other: str = "기타") -> DataFrame:
    """(review, tag_id, sentiment, matched_keyword, source) of reviews with a map from tag to keyword lists by polarity."""
    each = processed.filter(F.col(review).isNotNull()).select(review, F.explode("tag_sentiments").alias("name", "found")).filter(F.col("name") != other)
    lists = F.array(*[F.struct(F.lit(p).alias("sentiment"), F.col(f"found.{p}").alias("words")) for p in agg.POLARITIES])
    flat = each.select(review, "name", F.explode(lists).alias("x")).filter(F.size("x.words") > 0)
    known = tags.select(F.col("id").alias("tag_id"), "name")
    return flat.join(known, "name").select(review, "tag_id", F.col("x.sentiment").alias("sentiment"), F.array_join("x.words", ", ").alias("matched_keyword"), F.lit("pipeline").alias("source"))


def save_tags(mappings: DataFrame, rows: DataFrame, review: str) -> DataFrame:
    """Mappings with new rows: a known (review, tag, sentiment) takes their keyword and source."""
    return merge.upsert(mappings, rows, [review, "tag_id", "sentiment"], ["matched_keyword", "source"])


def synced_summaries(summaries: DataFrame, reviews: DataFrame, branch: str) -> DataFrame:
    """Summaries with recounted reviews; names are filled only where there is none; branches without a summary get one."""
    counted = reviews.groupBy(F.col(branch).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.max(text.branch_name(F.col("company_name"), F.col("branch_name"))).alias("_name"))
    both = summaries.join(counted, summaries[branch] == counted["_b"], "full_outer")
    new = {branch: F.coalesce(branch, "_b"), "branch_name": F.coalesce("branch_name", F.nullif(F.col("_name"), F.lit(""))), "review_count": F.coalesce("_n", F.lit(0))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in summaries.columns])


def backfilled(df: DataFrame, column: str, by: str, names: Mapping[str, str]) -> DataFrame:
    """A column filled from a small fixed map where it is null and the map has the row's name."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(by))
    return df.withColumn(column, F.coalesce(column, found))


def resolved_category(tag: Column, stored: Column, of_tag: Mapping[str, str], legacy: Mapping[str, str]) -> Column:
    """A tag's category by the registry, or else the stored one under its present name."""
    look = lambda names, key: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)
    stored = F.coalesce(stored, F.lit(""))
    return F.coalesce(look(of_tag, tag), look(legacy, stored), stored)


def auto_mapped(keywords: DataFrame, tag: Column, category: Column, ids: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """Keywords with the id of their tag, or of their category's default tag; null where both are unknown (skipped)."""
    fallback = F.element_at(F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]), category)
    known, spare = ids.select(F.col("id").alias("_a"), F.col("name").alias("_an")), ids.select(F.col("id").alias("_b"), F.col("name").alias("_bn"))
    wide = keywords.withColumns({"_t": tag, "_d": fallback})
    got = wide.join(known, F.col("_t") == F.col("_an"), "left").join(spare, F.col("_d") == F.col("_bn"), "left")
    return got.withColumn("tag_id", F.coalesce("_a", "_b")).drop("_t", "_d", "_a", "_an", "_b", "_bn")


def beyond(events: DataFrame, ts: str, done: DataFrame) -> DataFrame:
    """Events after the latest one processed; all where none is."""
    mark = done.agg(F.max(ts).alias("_mark"))
    return events.crossJoin(F.broadcast(mark)).filter(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def counted_in(monthly: DataFrame, events: DataFrame, date: str, *keys: str) -> DataFrame:
    """Monthly counts after single events, each a count of one."""
    return merge.add(monthly, agg.monthly(events, date, *keys), [*keys, "period"], [f"{p}_count" for p in (*agg.POLARITIES, "total")])


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def options(branches: DataFrame, companies: DataFrame, region: str, group: Column, key: str, name: str, company: str, order: Sequence[str]) -> DataFrame:
    """What filters offer, as rows of kind, place, value and parent: regions by name, their groups in a given order (regions of other groups have none), companies by name, branches by name with their region.

    Values that are null or empty are no options.  Places are by kind; the lists are of dimensions, not of reviews.
    """
    some = branches.filter(F.coalesce(F.trim(region), F.lit("")) != "")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(g) for g in order]), F.col("value")), F.lit(0)), F.lit(0))
    text = F.lit(None).cast("string")
    rows = lambda df, kind, value, parent, sort: df.select(F.lit(kind).alias("kind"), value.alias("value"), parent.alias("parent"), sort.alias("_sort")).distinct()
    regions = some.select(F.col(region).alias("_region"), group.alias("_group")).distinct()
    groups = rows(regions, "group", F.col("_group"), text, text).withColumn("_at", place).filter(F.col("_at") > 0)
    listed = rows(regions, "region", F.col("_region"), F.col("_group"), F.col("_region"))
    firms = rows(companies.filter(F.coalesce(company, F.lit("")) != ""), "company", F.col(company), text, F.col(company))
    shops = branches.filter(F.col(key).isNotNull())
    shops = rows(shops, "branch", F.col(key).cast("string"), F.col(region), F.concat_ws("|", F.coalesce(name, F.lit("")), F.lpad(F.col(key).cast("string"), 20, "0")))
    plain = listed.unionByName(firms).unionByName(shops).withColumn("_at", F.lit(0).cast("long"))
    ranked = plain.unionByName(groups.withColumn("_at", F.col("_at").cast("long")))
    return ranked.select("kind", F.row_number().over(Window.partitionBy("kind").orderBy("_at", F.asc_nulls_last("_sort"), "value")).alias("place"), "value", "parent")


RATINGS = ("rating_service", "rating_car", "rating_convenience")


def display_rows(df: DataFrame, judged: Column | None = None) -> DataFrame:
    """Reviews as they are shown: names and contents '' for null, ratings as numbers, dates as ISO text, and the sentiment stored, or else worked out from ratings and text.

    judged is the polarity of the text, null where it isn't known.
    """
    ratings = [F.col(c).cast("string").try_cast("double") for c in RATINGS]
    shown = sentiment.shown(F.col("sentiment"), F.lit(None).cast("string") if judged is None else judged, *ratings)
    iso = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss")
    return df.select(
        "review_id", "reservation_id", "branch_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("branch_name", "company_name", "content")], shown.alias("sentiment"),
        *[iso(c).alias(c) for c in ("review_date", "rental_date", "return_date")], *[r.alias(c) for r, c in zip(ratings, RATINGS, strict=True)], "car_model", F.coalesce("is_new", F.lit(False)).alias("is_new"),
    )


def samples(reviews: DataFrame, key: str, content: str, order: Sequence[Column], n: int = 8, most: int = 250) -> DataFrame:
    """Of each key the first n contents that aren't blank, cut to some characters, as an array in order; n and most are the feature."""
    kept = reviews.filter(F.trim(F.coalesce(content, F.lit(""))) != "")
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rank") <= n)
    one = F.struct("_rank", text.excerpt(F.col(content), most).alias("_text"))
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_text"]).alias("samples"))


def with_company(summaries: DataFrame, companies: DataFrame, branch: str, company: str, region: str) -> DataFrame:
    """Summaries that have an id and a name, with their branch's company and region, '' where these aren't known; companies has a branch once."""
    right = companies.select(F.col(branch).alias("_b"), F.col(company).alias("_company"))
    kept = summaries.filter(F.coalesce(branch, F.lit(0)) != 0).filter(F.coalesce("branch_name", F.lit("")) != "")
    return kept.join(right, F.col(branch) == F.col("_b"), "left").select(branch, "branch_name", F.coalesce("_company", F.lit("")).alias(company), F.coalesce(region, F.lit("")).alias(region)).orderBy("branch_name", branch)
