"""Sinks: exports and stored reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of exported columns.
EXPORT_LABELS = {
    "review_id": "리뷰번호", "branch_id": "지점번호", "branch_name": "지점명", "company_name": "회사명", "content": "리뷰내용",
    "car_model": "차량모델", "sentiment": "감성", "rating_service": "서비스 평점", "rating_car": "차량 평점", "review_date": "작성일",
}


def export(df: DataFrame, order: list[Column], limit: int = 1000, labels: Mapping[str, str] = EXPORT_LABELS) -> DataFrame:
    """The labelled columns that df has, of the first rows; the page limit is the feature."""
    return df.orderBy(*order).limit(limit).select(*[F.col(c).alias(name) for c, name in labels.items() if c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def spread(df: DataFrame, array: str, n: int, name: str) -> DataFrame:
    """The first n values of an array as columns, '' where there are fewer."""
    return df.select(*[c for c in df.columns if c != array], *[F.coalesce(F.get(array, F.lit(i)), F.lit("")).alias(f"{name}{i + 1}") for i in range(n)])


def load_report(document: Column, schema: str, old: str = "top_keywords", new: str = "top_tags") -> Column:
    """A stored report, whose list may stand under its old name."""
    return F.from_json(F.regexp_replace(document, f'"{old}"\\s*:', f'"{new}":'), schema)


def replace(df: DataFrame, path: str) -> None:
    """Write a table beside the old one and then put it in its place by a rename; readers of the old files must reopen."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
