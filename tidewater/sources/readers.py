"""Sources: tables, uploads and partner records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .versioned import work_folder

# Upload headers, Korean and English.
UPLOAD_HEADERS = {
    "리뷰번호": "review_id", "지점번호": "branch_id", "리뷰내용": "content", "예약_지점명": "branch_name", "예약_업체명": "company_name",
    "지점평점(친절/편의성)": "rating_service", "차량평점": "rating_car", "인수/반납편의성": "rating_convenience", "도움돼요수": "helpful_count",
    "등록일시": "review_date", "리뷰상태": "status", "차량모델": "car_type", "렌트타입": "rent_type",
}
STATUSES = {"정상": "normal", "블라인드": "blind", "삭제": "deleted"}
REQUIRED = ("review_id", "branch_id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every value a string, quotes doubled, lines inside quotes, a byte-order mark dropped.

    As lines may stand inside quotes, a file is read by one task: many rows should come as many files.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to a new shared folder and read back: what reads them often computes them once."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Rows with their place in the order of the partitions.  Places inside a partition are its own; only one row a partition is summed in one task.

    The rows are written with their places once, so that both sides of the join see the same ones.
    """
    spread = df.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    spread = written(spread)
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    return spread.join(counts, "_p").withColumn(name, F.col("_before") + F.col("_i") + first).drop("_m", "_p", "_i", "_before")


def renamed(df: DataFrame, headers: Mapping[str, str] = UPLOAD_HEADERS, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Columns by their common names; ValueError where a required one is missing."""
    out = df.withColumnsRenamed({k: v for k, v in headers.items() if k in df.columns})
    if missing := [c for c in required if c not in out.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def checked(df: DataFrame, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows with ``error``: null, or what is wrong with the ids; ids become numbers."""
    error = F.lit(None).cast("string")
    for c in reversed(required):
        number = F.expr(f"try_cast(trim(`{c}`) AS BIGINT)")
        error = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} is missing")).when(number.isNull(), F.lit(f"{c} is not a number")).otherwise(error)
    return df.withColumn("error", error).withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS BIGINT)") for c in required})


def upload(df: DataFrame) -> DataFrame:
    """An uploaded table under the common names, with row (the header is row 1) and error: null, or which id is missing.

    Ids stay strings here.  Contents lose tags and NUL; statuses get their English names; under Korean headers other columns are trimmed
    and a missing count of helpful marks is 0.
    """
    korean = "리뷰번호" in df.columns
    rows = renamed(numbered(df, "row", 2))
    new = {"content": text.strip_html(F.coalesce("content", F.lit("")))} if "content" in rows.columns else {}
    if korean:
        for c in (c for c in rows.columns if c not in ("row", "content")):
            new[c] = F.trim(F.coalesce(c, F.lit("0" if c == "helpful_count" else "")))
        if "helpful_count" in new:
            new["helpful_count"] = F.when(new["helpful_count"] == "", "0").otherwise(new["helpful_count"])
        if "status" in new:
            new["status"] = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair]), new["status"]), new["status"])
    out = rows.withColumns(new)
    error = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        error = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} is missing")).otherwise(error)
    return out.withColumn("error", error)


def active_ids(df: DataFrame, key: str, status: str, active: object = "1") -> DataFrame:
    """Distinct ids, as numbers, of the rows of one status; ids that don't parse go."""
    return df.filter(F.col(status) == F.lit(active)).select(F.expr(f"try_cast(`{key}` AS BIGINT)").alias(key)).filter(F.col(key).isNotNull()).distinct()


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("error").isNull()).drop("error"), df.filter(F.col("error").isNotNull())


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Strings as the types of a schema; what doesn't parse is null, and columns that are missing are."""
    return df.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def review_rows(df: DataFrame) -> DataFrame:
    """Lake rows in the shape of reviews: ids that don't parse drop the row, the model comes from the type of car, status 1 by default."""
    as_long = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    out = df.withColumns({"review_id": as_long("review_id"), "branch_id": as_long("branch_id"), "status": F.coalesce("status", F.lit("1")), "car_model": F.col("car_type"), "review_date": F.expr("try_to_timestamp(review_date)")})
    return out.filter(F.col("review_id").isNotNull())


def partner(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Nested JSON records of a partner as columns."""
    return df.select(F.from_json(payload, schema).alias("r")).select("r.*")


def json_map(column: Column) -> Column:
    return F.from_json(column, "map<string,string>")


def newest_non_blank(df: DataFrame, text: str, order: Column, n: int) -> DataFrame:
    """Non-blank texts among the newest n rows: the limit comes first."""
    return df.orderBy(order).limit(n).filter(F.trim(text) != "")


def review_records(df: DataFrame) -> DataFrame:
    """Stored rows as reviews: each column from the first of its names that has a value, with defaults where none has.

    Names that the table lacks count as null.  Dates that don't parse are null.
    """
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    text_of = lambda name: F.coalesce(first(name).cast("string"), F.lit(""))
    date = F.nullif(first("review_date").cast("string"), F.lit(""))
    return df.select(
        first("id", "review_id").cast("long").alias("id"), F.coalesce(first("branch_id").cast("long"), F.lit(0)).alias("branch_id"), text_of("content").alias("content"), text_of("branch_name").alias("branch_name"),
        first("rating_service", "rating").cast("double").alias("rating"), F.try_to_timestamp(F.coalesce(date, first("created_at").cast("string"))).alias("created_at"),
        F.coalesce(first("helpful_count", "like_count").cast("long"), F.lit(0)).alias("like_count"), F.coalesce(first("is_blind").cast("boolean"), F.lit(False)).alias("is_blind"),
        text_of("car_model").alias("car_model"), text_of("company_name").alias("company_name"), F.coalesce(F.nullif(first("status").cast("string"), F.lit("")), F.lit("normal")).alias("status"),
    )


AFFILIATE = "id string, name string, location struct<address:string,latitude:string,longitude:string>, tel struct<number:string>"


def affiliates(df: DataFrame, payload: str, kind: str = "PARTNERS") -> DataFrame:
    """Partner records, a JSON object a row, as affiliates: place and telephone from their own objects, '' where they are missing, places that are no numbers null.

    Records that aren't JSON have a null id.
    """
    r = F.from_json(payload, AFFILIATE)
    blank = lambda c: F.coalesce(c, F.lit(""))
    number = lambda c: F.nullif(c, F.lit("")).try_cast("double")
    return df.withColumn("_r", r).select(
        F.col("_r.id").try_cast("long").alias("affiliate_index"), blank(F.col("_r.name")).alias("name"), F.lit(kind).alias("location_type"), blank(F.col("_r.location.address")).alias("address"), blank(F.col("_r.tel.number")).alias("phone"),
        number(F.col("_r.location.latitude")).alias("latitude"), number(F.col("_r.location.longitude")).alias("longitude"), F.lit(True).alias("is_active"), F.col(payload).alias("raw_data"),
    )
