"""Queries of listings, pages, reports and Korean texts, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, packs, polarity, text
from ..operators import aggregates as agg
from ..operators import filters, listings
from ..sources import readers
from ..sources.readers import table
from . import tpch
from .catalogue import _COUNTS, _MONTH, _percent, query


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def active_order_ids(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    return readers.active_ids(orders, "o_orderkey", "o_orderstatus", "F")


_PART_TAGS = "(SELECT p_partkey AS id, p_name AS name, p_type AS category, CASE WHEN p_size >= 10 THEN p_brand END AS group_name, p_size AS display_order, p_size % 2 = 0 AS is_active, p_brand AS color FROM part)"


def _part_tags(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.when(F.col("p_size") >= 10, F.col("p_brand")).alias("group_name"),
        F.col("p_size").alias("display_order"), (F.col("p_size") % 2 == 0).alias("is_active"), F.col("p_brand").alias("color"),
    )


@query(f"SELECT id, name, category, display_order FROM {_PART_TAGS} WHERE group_name = 'Brand#12' AND is_active")
def tag_list(spark: SparkSession, folder: str) -> DataFrame:
    """Active tags of a group; the category is overridden by it."""
    return listings.tag_list(_part_tags(spark, folder), "Brand#12", "STANDARD", True).select("id", "name", "category", "display_order")


@query(f"SELECT coalesce(group_name, '기타') AS group_name, min(color) AS color, count(*) AS count FROM {_PART_TAGS} GROUP BY 1")
def tag_groups(spark: SparkSession, folder: str) -> DataFrame:
    return listings.tag_groups(_part_tags(spark, folder))


@query(f"SELECT id, group_name FROM {_PART_TAGS} WHERE is_active AND (group_name IS NULL OR group_name = 'Brand#21')")
def active_presets(spark: SparkSession, folder: str) -> DataFrame:
    return listings.catalogue(_part_tags(spark, folder), "is_active", {"group_name": "Brand#21"}, ["group_name"]).select("id", "group_name")


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 5 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def retag_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with some text and without a label."""
    return listings.untagged(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id", "text").select("doc_id", "n_chars")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE r = 1")
def newest_open_job(spark: SparkSession, folder: str) -> DataFrame:
    got = listings.newest_job(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus", ["O", "P"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return got.select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    """, marked AS (SELECT branch_id, order_id, line, review_date, price, review_date >= TIMESTAMP '1998-09-01' AS is_new FROM reviews),
    shown AS (SELECT *, NOT bool_or(is_new) OVER (PARTITION BY branch_id) AS fell_back FROM marked)
    SELECT branch_id, order_id, line, total, fell_back, place FROM (SELECT *, count(*) OVER (PARTITION BY branch_id) AS total, row_number() OVER (PARTITION BY branch_id ORDER BY review_date DESC, order_id, line, price) AS place
    FROM shown WHERE is_new OR fell_back) WHERE place <= 3""",
    "reviews",
)
def new_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of each branch's new reviews, or of all where none is new."""
    rows = tpch.reviews(spark, folder).withColumn("is_new", F.col("review_date") >= F.lit("1998-09-01").cast("timestamp_ntz"))
    got = listings.new_or_all(rows, "branch_id", "is_new", [F.desc("review_date"), F.asc("order_id"), F.asc("line"), F.asc("price")], 0, 3)
    return got.select("branch_id", "order_id", "line", F.col("total").cast("long").alias("total"), "fell_back", F.col("place").cast("long").alias("place"))


@query("SELECT branch_id, branch_name FROM branches WHERE region LIKE 'A%'", "branches")
def region_picker(spark: SparkSession, folder: str) -> DataFrame:
    return listings.pick(tpch.branches(spark, folder), "branch_id", "branch_name", "region", "A").select("branch_id", "branch_name")


@query(
    """SELECT s_nationkey AS grp, s_suppkey AS branch_id, s_name AS branch_name FROM supplier WHERE s_nationkey <> 3
    UNION ALL SELECT 3, s_suppkey, s_name FROM supplier WHERE s_acctbal < 0"""
)
def target_replacement(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("branch_id"), F.col("s_name").alias("branch_name"), "s_acctbal")
    targets = supplier.drop("s_acctbal")
    return listings.replaced_targets(targets, "grp", 3, supplier.filter("s_acctbal < 0"), supplier, "branch_id", "branch_name")


_MEANT = "CASE WHEN service10 + car10 + coalesce(conv10, 0) >= 120 THEN 'positive' WHEN service10 + car10 + coalesce(conv10, 0) < 75 THEN 'negative' ELSE 'neutral' END"


@query(f"SELECT order_id, line, price, count(*) OVER () AS total FROM reviews WHERE {_MEANT} = 'negative' ORDER BY review_date DESC, order_id, line, price LIMIT 50", "reviews")
def judged_search(spark: SparkSession, folder: str) -> DataFrame:
    """A page of reviews by a polarity that is computed, with the exact total."""
    points = F.col("service10") + F.col("car10") + F.coalesce("conv10", F.lit(0))
    rows = tpch.reviews(spark, folder).withColumn("meant", F.when(points >= 120, "positive").when(points < 75, "negative").otherwise("neutral"))
    got = listings.judged_page(rows, "meant", "negative", [F.desc("review_date"), F.asc("order_id"), F.asc("line"), F.asc("price")], 0, 50)
    return got.select("order_id", "line", "price", "total")


@query("SELECT tag, count(*) AS mappings FROM tagged WHERE category IN (SELECT p_type FROM part WHERE p_size >= 45) GROUP BY tag", "tagged")
def category_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """Mappings of tags whose category is among some, by a semi join."""
    tags = tpch.parts(spark, folder).select("part_id", "category", F.explode(F.split("part_name", " ")).alias("tag"))
    categories = table(spark, folder, "part").filter("p_size >= 45").select(F.col("p_type").alias("category"))
    reviews = tpch.reviews(spark, folder).withColumn("review", F.struct("order_id", "line"))
    got = listings.by_name(reviews.select("review", "part_id"), reviews.select("review").distinct(), tags, categories, "review", "part_id", "category")
    return got.groupBy("tag").agg(F.count(F.lit(1)).alias("mappings"))


@query(
    f"""SELECT car_model, CAST(sum(positive_count) AS BIGINT) AS total_positive, CAST(sum(negative_count) AS BIGINT) AS total_negative, CAST(sum(total_count) AS BIGINT) AS total_count, count(*) AS tags
    FROM (SELECT car_model, tag, {_COUNTS} FROM tagged GROUP BY car_model, tag) GROUP BY car_model""",
    "tagged",
)
def model_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of each model and the number of its tags, from monthly counts."""
    monthly = agg.monthly(tpch.tagged(spark, folder), "review_date", "car_model", "tag")
    return listings.model_totals(monthly, "car_model", "tag").withColumn("tags", F.size("tags").cast("long"))


@query(
    f""", raw AS (SELECT car_model, {_COUNTS} FROM described GROUP BY car_model),
    seen AS (SELECT car_model, count(*) AS count, {_percent("count(*) FILTER (WHERE sentiment = 'positive')", "count(*)")} AS like_ratio FROM described WHERE price > 90000 AND review_date >= TIMESTAMP '1998-06-01' GROUP BY car_model)
    SELECT r.car_model, coalesce(s.count, r.total_count) AS count, coalesce(s.like_ratio, {_percent("r.positive_count", "r.total_count")}) AS like_ratio FROM raw r LEFT JOIN seen s USING (car_model)""",
    "described",
)
def vehicles_with_analysis(spark: SparkSession, folder: str) -> DataFrame:
    rows = tpch.described(spark, folder)
    raw = agg.by_polarity(rows, "car_model").select("car_model", F.col("positive_count").alias("total_positive"), F.col("negative_count").alias("total_negative"), "total_count")
    late = rows.filter((F.col("price") > 90000) & (F.col("review_date") >= F.lit("1998-06-01").cast("timestamp_ntz")))
    seen = agg.by_polarity(late, "car_model").select("car_model", F.col("total_count").alias("count"), numbers.percent(F.col("positive_count"), F.col("total_count")).alias("like_ratio"), numbers.percent(F.col("negative_count"), F.col("total_count")).alias("dislike_ratio"))
    return listings.with_analysis(raw, seen, "car_model").select("car_model", "count", "like_ratio")


_IN_1997 = "{0} >= TIMESTAMP '1997-01-01' AND {0} < TIMESTAMP '1998-01-01'"


@query(f"SELECT o_custkey, count(*) FILTER (WHERE {_IN_1997.format('l_shipdate')}) AS n_l_shipdate, count(*) FILTER (WHERE {_IN_1997.format('o_orderdate')}) AS n_o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def counts_by_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews of each customer by two dates in one pass."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate").join(orders, "l_orderkey")
    return listings.counts_between(rows, "o_custkey", ["l_shipdate", "o_orderdate"], "1997-01-01", "1998-01-01")


@query("SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey")
def lake_branch_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("l_suppkey"))
    return listings.lake_counts(rows, "l_suppkey")


@query("SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL")
def routing_report(spark: SparkSession, folder: str) -> DataFrame:
    return listings.routing(table(spark, folder, "events"), "user_id", "event_type")


@query("SELECT branch_id, car_model, count(*) AS count FROM described GROUP BY ALL", "described")
def branch_models(spark: SparkSession, folder: str) -> DataFrame:
    return tpch.described(spark, folder).groupBy("branch_id", "car_model").agg(F.count(F.lit(1)).alias("count"))


@query(
    f""", sums AS (SELECT branch_id, tag, {_COUNTS} FROM tagged WHERE strftime(review_date, '%Y-%m') >= '1998-06' GROUP BY branch_id, tag),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY branch_id) AS tags, row_number() OVER (PARTITION BY branch_id ORDER BY total_count DESC, tag) AS rank FROM sums)
    SELECT branch_id, tag, total_count AS total, CAST(rank AS INTEGER) AS rank, {_percent("positive_count", "total_count")} AS positive_ratio, {_percent("negative_count", "total_count")} AS negative_ratio FROM ranked WHERE tags >= 3 AND rank <= 15""",
    "tagged",
)
def period_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Most used tags of each branch since a month, from monthly counts, with ratios."""
    monthly = agg.monthly(tpch.tagged(spark, folder), "review_date", "branch_id", "tag")
    got = listings.period_tags(monthly, "branch_id", "tag", "period", "1998-06")
    return got.select("branch_id", "tag", "total", "rank", "positive_ratio", "negative_ratio")


@query(
    """SELECT min(r) AS min, max(r) AS max, round(avg(r), 9) AS avg, count(r) AS total, count(*) FILTER (WHERE r >= 4.5) AS from_4_5, count(*) FILTER (WHERE r >= 4 AND r < 4.5) AS from_4, count(*) FILTER (WHERE r >= 3.5 AND r < 4) AS from_3_5,
    count(*) FILTER (WHERE r >= 3 AND r < 3.5) AS from_3, count(*) FILTER (WHERE r < 3) AS below FROM (SELECT conv10 / 10.0::DOUBLE AS r FROM reviews)""",
    "reviews",
)
def rating_stats(spark: SparkSession, folder: str) -> DataFrame:
    got = listings.rating_stats(tpch.reviews(spark, folder).select((F.col("conv10") / 10).alias("r")), "r")
    return got.withColumn("avg", F.round("avg", 9))


@query(f"SELECT car_model, total_count AS count, {_percent('positive_count', 'total_count')} AS like_ratio FROM (SELECT car_model, {_COUNTS} FROM described GROUP BY car_model) ORDER BY count DESC, car_model LIMIT 5", "described")
def top_vehicles(spark: SparkSession, folder: str) -> DataFrame:
    got = agg.by_polarity(tpch.described(spark, folder), "car_model")
    return listings.top_vehicles(got.select("car_model", F.col("total_count").alias("count"), numbers.percent(F.col("positive_count"), F.col("total_count")).alias("like_ratio")), "car_model")


@query(
    f"""SELECT string_agg(line, ', ' ORDER BY count DESC, car_model) AS summary FROM (SELECT car_model, total_count AS count,
    car_model || '(' || total_count || '건, 호평 ' || CAST(round_even(total_count * {_percent("positive_count", "total_count")} / 100.0::DOUBLE, 0) AS BIGINT) || '건' || CASE WHEN positive_count > negative_count THEN ', 강점: 친절' ELSE '' END || ')' AS line
    FROM (SELECT car_model, {_COUNTS} FROM described GROUP BY car_model) ORDER BY count DESC, car_model LIMIT 5)""",
    "described",
)
def vehicle_line(spark: SparkSession, folder: str) -> DataFrame:
    got = agg.by_polarity(tpch.described(spark, folder), "car_model")
    return listings.vehicle_line(got.select(
        F.col("car_model").alias("model"), F.col("total_count").alias("count"), numbers.percent(F.col("positive_count"), F.col("total_count")).alias("like_ratio"),
        F.when(F.col("positive_count") > F.col("negative_count"), "친절").alias("top_praise"), F.lit(None).cast("string").alias("top_issue"),
    ))


@query(
    f"""SELECT branch_id, branch_name, n AS review_count FROM branches JOIN (SELECT branch_id, count(*) AS n FROM reviews WHERE {_IN_1997.format('review_date')} GROUP BY branch_id) USING (branch_id)""",
    "branches", "reviews",
)
def dated_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries with the reviews of a range counted instead of all."""
    summaries = tpch.branches(spark, folder).select("branch_id", "branch_name", F.lit(0).cast("long").alias("review_count"))
    return listings.dated_summaries(summaries, tpch.reviews(spark, folder), "branch_id", "review_date", "1997-01-01", "1998-01-01")


@query(
    """, totals AS (SELECT car_model, tag, count(*) AS total FROM tagged GROUP BY car_model, tag)
    SELECT car_model, n AS review_count, string_agg(tag || ':' || total, ',' ORDER BY total DESC, tag) AS tags FROM totals JOIN (SELECT car_model, count(*) AS n FROM described GROUP BY car_model) USING (car_model) GROUP BY car_model, n""",
    "tagged", "described",
)
def model_page(spark: SparkSession, folder: str) -> DataFrame:
    got = listings.model_page(tpch.tagged(spark, folder), tpch.described(spark, folder), "car_model", "tag")
    return got.withColumn("tags", F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["tag"], x["total"].cast("string"))), ","))


@query(
    f""", t AS (SELECT car_model, tag, {_COUNTS} FROM tagged GROUP BY car_model, tag), p AS (SELECT *, {_percent("positive_count", "total_count")} AS up, {_percent("negative_count", "total_count")} AS down FROM t)
    SELECT car_model, coalesce(string_agg(tag || ' +' || up || '%', ', ' ORDER BY total_count DESC, tag) FILTER (WHERE up >= 26), '') AS strong,
    coalesce(string_agg(tag || ' -' || down || '%', ', ' ORDER BY total_count DESC, tag) FILTER (WHERE down >= 25), '') AS weak, {_percent("sum(positive_count)", "sum(total_count)")} AS positive_ratio FROM p GROUP BY car_model""",
    "tagged",
)
def strong_and_weak(spark: SparkSession, folder: str) -> DataFrame:
    got = agg.by_polarity(tpch.tagged(spark, folder), "car_model", "tag")
    return listings.strong_and_weak(got, "car_model", "tag", 26, 25)


@query("SELECT branch_id, CASE WHEN n_1m >= 30 THEN '1m' WHEN n_3m >= 30 THEN '3m' WHEN n_all >= 30 THEN 'all' ELSE 'insufficient' END AS period FROM (SELECT branch_id, count(*) FILTER (WHERE review_date >= TIMESTAMP '1998-11-01') AS n_1m, count(*) FILTER (WHERE review_date >= TIMESTAMP '1998-09-02') AS n_3m, count(*) AS n_all FROM reviews GROUP BY branch_id)", "reviews")
def summary_period(spark: SparkSession, folder: str) -> DataFrame:
    """The first of some 30-day periods with enough reviews, or all, or none."""
    ranges = {"1m": ("1998-11-01", None), "3m": ("1998-09-02", None), "all": (None, None)}
    got = agg.multi_period(tpch.reviews(spark, folder).groupBy("branch_id"), "review_date", ranges)
    return got.select("branch_id", agg.recommended([(p, F.col(f"n_{p}")) for p in ranges], 30, F.lit("insufficient")).alias("period"))


@query(
    """, base AS (SELECT part_id, tag, sentiment, 'old' AS matched_keyword, 'manual' AS source FROM tagged WHERE review_date < TIMESTAMP '1995-01-01' GROUP BY ALL), delta AS (SELECT part_id, tag, sentiment, tag AS matched_keyword, 'pipeline' AS source FROM tagged WHERE review_date >= TIMESTAMP '1995-01-01' GROUP BY ALL)
    SELECT part_id, tag, sentiment, coalesce(d.matched_keyword, b.matched_keyword) AS matched_keyword, coalesce(d.source, b.source) AS source FROM base b FULL JOIN delta d USING (part_id, tag, sentiment)""",
    "tagged",
)
def review_tag_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Tag mappings with newer ones: a known key takes their keyword and source."""
    rows, cut = tpch.tagged(spark, folder), F.lit("1995-01-01").cast("timestamp_ntz")
    base = rows.filter(F.col("review_date") < cut).select("part_id", "tag", "sentiment", F.lit("old").alias("matched_keyword"), F.lit("manual").alias("source")).distinct()
    lists = F.struct(*[F.when(F.col("sentiment") == p, F.array("tag")).otherwise(F.array().cast("array<string>")).alias(p) for p in agg.POLARITIES])
    newer = rows.filter(F.col("review_date") >= cut).select("part_id", "tag", "sentiment").distinct().withColumn("tag_sentiments", F.create_map("tag", lists))
    names = newer.select(F.col("tag").alias("id"), F.col("tag").alias("name")).distinct()
    delta = listings.tag_rows(newer, names, "part_id")
    return listings.save_tags(base.withColumnRenamed("tag", "tag_id"), delta, "part_id").withColumnRenamed("tag_id", "tag")


@query("SELECT branch_id, CASE WHEN rating >= 50 THEN branch_name ELSE left(trim(region || ' ' || nation), 100) END AS branch_name, coalesce(n, 0) AS review_count FROM branches LEFT JOIN (SELECT branch_id, count(*) AS n FROM reviews GROUP BY branch_id) USING (branch_id)", "branches", "reviews")
def synced_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Recounted reviews; names are filled only where there is none."""
    branches = tpch.branches(spark, folder)
    summaries = branches.select("branch_id", F.when(F.col("rating") >= 50, F.col("branch_name")).alias("branch_name"), F.lit(-1).cast("long").alias("review_count"))
    reviews = tpch.reviews(spark, folder).select("branch_id").join(branches.select("branch_id", F.col("region").alias("company_name"), F.col("nation").alias("branch_name")), "branch_id")
    return listings.synced_summaries(summaries, reviews, "branch_id")


@query("SELECT p_partkey, replace(replace(p_type, 'STANDARD', 'plain'), 'PROMO', 'offer') AS kind FROM part")
def renamed_in_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.replaced(F.col("p_type"), {"STANDARD": "plain", "PROMO": "offer"}).alias("kind"))


@query("SELECT n_nationkey, coalesce(CASE WHEN n_regionkey > 1 THEN r_name END, CASE r_name WHEN 'AFRICA' THEN 'south' WHEN 'AMERICA' THEN 'west' END) AS area FROM nation JOIN region ON n_regionkey = r_regionkey")
def backfilled_area(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.withColumn("area", F.when(F.col("n_regionkey") > 1, F.col("r_name")))
    return listings.backfilled(rows, "area", "r_name", {"AFRICA": "south", "AMERICA": "west"}).select("n_nationkey", "area")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE user_id < 50)")
def high_water_mark(spark: SparkSession, folder: str) -> DataFrame:
    """Events after the latest one that is done: those of some users stand for the processed ones."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return listings.beyond(events, "ts", events.filter("user_id < 50")).select("event_id")


@query(f"SELECT branch_id, {_MONTH}, {_COUNTS} FROM reviews GROUP BY branch_id, period", "reviews")
def single_events(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly counts of all but the latest reviews, with those counted in one by one."""
    rows, cut = tpch.reviews(spark, folder), F.lit("1998-08-15").cast("timestamp_ntz")
    before = agg.monthly(rows.filter(F.col("review_date") < cut), "review_date", "branch_id")
    return listings.counted_in(before, rows.filter(F.col("review_date") >= cut), "review_date", "branch_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'closed' WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE o_orderstatus END AS summary FROM orders")
def first_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The first summary that isn't blank."""
    month = F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"), "closed").otherwise("  ")
    return table(spark, folder, "orders").select("o_orderkey", text.first_non_blank(month, F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.col("o_orderstatus")).alias("summary"))


@query("SELECT o_orderkey, sha256(o_orderstatus || chr(31) || o_orderpriority) AS cache_key FROM orders")
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", listings.cache_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("cache_key"))


@query("SELECT CASE WHEN p_brand LIKE 'Brand#1_' THEN 'one' WHEN p_brand LIKE 'Brand#2_' THEN 'two' ELSE p_brand END AS category, count(*) AS parts FROM part GROUP BY 1")
def resolved_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The category that a tag's name gives, or else a stored one under its present name."""
    old = {f"Brand#2{i}": "two" for i in range(10)}
    category = listings.resolved_category(F.col("p_brand"), F.col("p_brand"), {f"Brand#1{i}": "one" for i in range(10)}, old)
    return table(spark, folder, "part").groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    """SELECT doc_id, list_filter([CASE WHEN quality = 0 AND NOT regexp_matches(text, 'improve|poor') THEN 'no word on improvement' END, CASE WHEN len(regexp_extract_all(text, '[0-9]+[%건개]')) < 2 THEN 'too few figures' END], lambda x: x IS NOT NULL)::VARCHAR AS warnings
    FROM documents JOIN labels USING (doc_id)"""
)
def report_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What labelled texts lack as reports."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "quality")
    found = listings.report_warnings(F.col("text"), F.when(F.col("quality") == 0, 20).otherwise(0), ["improve", "poor"])
    return docs.join(labels, "doc_id").select("doc_id", F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("warnings"))


@query()
def report_marks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without report marks; look-around has no SQL form there, a test compares it with Python's."""
    return table(spark, folder, "documents").select("doc_id", text.strip_report_marks(F.col("text")).alias("plain"))


# Korean texts: the test tables have none, so parts of a document's words choose which of some reviews it says

REVIEWS = (
    "직원분이 정말 친절하셨고 차량도 깨끗해서 만족합니다", "가격은 저렴한데 차가 너무 더러웠어요. 담배냄새가 심했습니다", "배차가 늦어서 한참을 기다렸습니다. 직원도 불친절했어요", "걱정했는데 괜한 걱정이었어요. 깨끗하고 친절해서 감사합니다",
    "안심하고 이용했어요", "보험이 있어서 안심했어요", "처리가 빠르네요", "카톡 문의주세요", "",
)
#: A small registry of aspects; a full one is a parameter.
REGISTRY = {
    "직원친절": ("친절", "불친절", "상냥", "직원", "응대"), "청결": ("깨끗", "청결", "더러", "냄새", "담배"), "가격": ("가격", "저렴", "비싸", "비싼"),
    "배달/배차": ("배차", "배달", "픽업", "기다"), "사고 처리": ("사고", "보험", "면책"),
}


#: A text that holds the part at a place says the review at that place.
_PARTS = ("tion", "que", "sch", "ño", "ing", "ver", "é", "ta", "#")


def _korean(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, each as the reviews that parts of its words choose, in the order of the list; a null text says nothing."""
    said = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(part)), F.lit(review)) for part, review in zip(_PARTS, REVIEWS, strict=True)]))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), F.array_join(said, ". ").alias("content"))


def _judged_once(rows: DataFrame, judged: Column) -> DataFrame:
    """review_id and what a column makes of content, worked out once for each different content."""
    found = rows.select("content").distinct().withColumn("s", judged).withColumnRenamed("content", "_content")
    return rows.join(found, F.col("content").eqNullSafe(F.col("_content"))).select("review_id", "s")


@query()
def korean_text_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Polarity of whole texts."""
    return _judged_once(_korean(spark, folder), polarity.of_text(F.col("content"))).select("review_id", "s.sentiment", F.round("s.confidence", 6).alias("confidence"))


@query()
def korean_rated_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Polarity of texts with their ratings: three digits of the id stand for them, 0 for none."""
    digit = lambda n: F.when(F.floor(F.col("review_id") / n) % 6 > 0, F.floor(F.col("review_id") / n) % 6)
    known = _judged_once(_korean(spark, folder), polarity.unified(F.col("content"), REGISTRY))
    rated = known.select("review_id", polarity.corrected(F.col("s"), digit(1), digit(6), digit(36)).alias("s"))
    return rated.select("review_id", "s.sentiment", F.round("s.confidence", 6).alias("confidence"), "s.method")


@query()
def korean_aspects(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each review and aspect, with its opinion, polarity and keywords."""
    return _judged_once(_korean(spark, folder), polarity.analysed(F.col("content"), REGISTRY)).select("review_id", F.inline("s")).withColumn("keywords", F.array_join("keywords", ","))


@query()
def korean_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of each review with further keywords, and the overall polarity."""
    tags = polarity.hybrid(F.col("content"), text.keywords(F.col("content")), lambda w: polarity.rule_tag(w, w, REGISTRY), REGISTRY)
    view = _judged_once(_korean(spark, folder), tags).withColumn("o", polarity.overview(F.col("s")))
    return view.select("review_id", "o.overall", "o.sentiment", "o.confidence", F.array_join("o.aspects", ",").alias("aspects"), F.size("s").alias("n_tags"))


@query()
def korean_hygiene(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews without abuse and advertising."""
    return filters.without_words(_korean(spark, folder), "content", [*packs.PROFANITY, *packs.ADVERTISING]).select("review_id")
