"""The review model bound to the order tables: line items are reviews, suppliers branches, part names tags, part types categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

_FLAGS = {"A": "positive", "R": "negative"}


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """branch_id, review_date, sentiment and three ratings in tenths, of which the last is null for every tenth quantity."""
    items = table(spark, folder, "lineitem")
    sentiment = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral")
    tenths = lambda x: F.round(x).cast("long")
    return items.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("branch_id"), F.col("l_shipdate").alias("review_date"), sentiment.alias("sentiment"),
        tenths(50 - 400 * F.col("l_discount")).alias("service10"), tenths(50 - 500 * F.col("l_tax")).alias("car10"),
        F.when(F.col("l_quantity") % 10 != 0, tenths(F.col("l_quantity"))).alias("conv10"), F.col("l_extendedprice").alias("price"),
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("part_name"), F.col("p_brand").alias("car_model"), F.col("p_type").alias("category"))


def described(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews with their parts, by a merge join: parts grow with the reviews, and files of repeated values are far smaller than their rows in a broadcast."""
    return reviews(spark, folder).join(parts(spark, folder).hint("merge"), "part_id")


def tagged(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each review and word of its part's name; the words are split off the smaller table before the join, which merges as above."""
    tags = parts(spark, folder).select("part_id", "car_model", "category", F.explode(F.split("part_name", " ")).alias("tag"))
    return reviews(spark, folder).join(tags.hint("merge"), "part_id")


def branches(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers with nation, region and a rating from the balance."""
    supplier, nation, region = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("branch_id"), F.col("s_name").alias("branch_name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.round(F.col("s_acctbal") / 100).cast("long").alias("rating"))


#: The same tables for DuckDB.
CTES = {
    "reviews": """reviews AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS branch_id, l_shipdate AS review_date,
      CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS sentiment,
      CAST(round(50 - 400 * l_discount) AS BIGINT) AS service10, CAST(round(50 - 500 * l_tax) AS BIGINT) AS car10,
      CASE WHEN l_quantity % 10 <> 0 THEN CAST(round(l_quantity) AS BIGINT) END AS conv10, l_extendedprice AS price FROM lineitem)""",
    "parts": "parts AS (SELECT p_partkey AS part_id, p_name AS part_name, p_brand AS car_model, p_type AS category FROM part)",
    "described": "described AS (SELECT r.*, p.part_name, p.car_model, p.category FROM reviews r JOIN parts p USING (part_id))",
    "tagged": "tagged AS (SELECT d.*, t.car_model, t.category, t.tag FROM (SELECT *, unnest(string_split(part_name, ' ')) AS tag FROM parts) t JOIN reviews d USING (part_id))",
    "branches": """branches AS (SELECT s_suppkey AS branch_id, s_name AS branch_name, n_name AS nation, r_name AS region, CAST(round(s_acctbal / 100) AS BIGINT) AS rating
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "words": r"words AS (SELECT source, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS keyword FROM documents)",
}
_NEEDS = {"described": ("reviews", "parts"), "tagged": ("reviews", "parts")}


def sql(body: str, *names: str) -> str:
    """A statement over some of the tables above."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, ()), name) if n not in order]
    head = ", ".join(CTES[n] for n in order)
    if body.startswith(","):
        return f"WITH {head} {body}"
    return f"WITH {head} {body}" if head else body
