"""Listings, uploads and text repairs on small tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from tidewater.functions import packs, text
from tidewater.operators import filters, joins, listings, merge, ranking, reports
from tidewater.sources import readers


def test_uploads(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("﻿리뷰번호,지점번호,리뷰내용,예약_지점명,차량모델,리뷰상태,도움돼요수\n1,100,<b>좋아요</b>  네, 강남 ,K5,블라인드,\n,200,별로,,,정상,3\nx7, ,a,,,새것,1\n", encoding="utf-8")
    got = {r.row: r for r in readers.upload(readers.csv(spark, str(path))).collect()}
    assert (got[2].review_id, got[2].content, got[2].branch_name, got[2].car_type, got[2].status, got[2].helpful_count, got[2].error) == ("1", "좋아요 네", "강남", "K5", "blind", "0", None)
    assert (got[3].error, got[4].error, got[4].status) == ("review_id is missing", "branch_id is missing", "새것")
    english = readers.upload(spark.createDataFrame([("1", "2", "<i>a</i>")], "review_id string, branch_id string, content string")).first()
    assert (english.content, english.error) == ("a", None)


def test_row_numbers_follow_partitions(spark):
    got = readers.numbered(spark.range(0, 50, 1, 7), "row", 2).collect()
    assert {r.id + 2: r.row for r in got} == {i: i for i in range(2, 52)}


def test_active_ids(spark):
    df = spark.createDataFrame([("1", "1"), ("1", "1"), ("x", "1"), ("3", "0"), (None, "1")], "id string, status string")
    assert [r.id for r in readers.active_ids(df, "id", "status").collect()] == [1]


def python_marks(t: str) -> str:
    for pattern, new, flags in (
        (r"\[([^\]]+)\]", r"\1", 0), (r"\*\*([^*]+)\*\*", r"\1", 0), (r"(?<!\w)\*([^*]+)\*(?!\w)", r"\1", 0), (r"^\s*[-*•]\s+", "", re.M), (r"^\s*\d+\.\s+", "", re.M), (r"^#+\s+", "", re.M), (r"\n{2,}", "\n", 0), (r"  +", " ", 0),
    ):
        t = re.sub(pattern, new, t, flags=flags)
    return t.strip()


def test_report_marks_against_python(spark):
    given = ["[핵심 요약]\n# 제목\n\n\n- **굵게** 그리고 *기울임*\n1. 하나\n  2.  둘", "a*b*c *d* 한*글*", "", "•  점\n\n* 별\n[x](y)  [ ]", "plain", "#no\n## yes", "　- 넓은 칸　"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    assert {r.i: r.p for r in df.select("i", text.strip_report_marks(F.col("t")).alias("p")).collect()} == {i: python_marks(t) for i, t in enumerate(given)}


def test_corrected_numbers(spark):
    given = ["총 1,010건 중 98건과 9건, 500건", "없음", "12건", None]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    known = F.array(F.lit(1000), F.lit(100), F.lit(9), F.lit(5))
    assert [r[0] for r in df.select(text.corrected_numbers(F.col("t"), known)).collect()] == ["총 1,000건 중 100건과 9건, 500건", "없음", "12건", None]


def test_small_text_forms(spark):
    df = spark.createDataFrame([("BMWBMW 5", " "), ("현대쏘나타", "x"), ("기아", None), ("볼보 S", "\t\n")], "m string, a string")
    got = df.select(text.split_brand(F.col("m"), packs.BRANDS).alias("m"), text.first_non_blank(F.col("a"), F.lit("y")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("BMW 5", "y"), ("현대 쏘나타", "x"), ("기아", "y"), ("볼보 S", "y")]
    one = spark.createDataFrame([("[직원이 친절함, 배달]", "직원이 친절함", ""), ("다른", "몰라", "배달"), ("새", "친절", None)], "t string, tag string, stored string")
    assert [r[0] for r in one.select(text.replaced(F.col("t"), {"직원이 친절함": "직원친절"})).collect()] == ["[직원친절, 배달]", "다른", "새"]
    category = listings.resolved_category(F.col("tag"), F.col("stored"), {"친절": "직원친절"}, packs.LEGACY_CATEGORIES)
    assert [r[0] for r in one.select(category).collect()] == ["", "배달/배차", "직원친절"]


def test_tag_rows_and_upsert(spark):
    tags = "map<string,struct<positive:array<string>,negative:array<string>,neutral:array<string>>>"
    processed = spark.createDataFrame([(1, {"친절": (["a", "b"], [], ["c"]), "기타": (["d"], [], []), "모름": (["e"], [], [])}), (None, {"친절": (["x"], [], [])}), (2, {})], f"review_id long, tag_sentiments {tags}")
    rows = listings.tag_rows(processed, spark.createDataFrame([(7, "친절")], "id int, name string"), "review_id")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 7, "neutral", "c", "pipeline"), (1, 7, "positive", "a, b", "pipeline")]
    old = spark.createDataFrame([(1, 7, "positive", "old", "manual"), (9, 7, "negative", "z", "manual")], rows.schema)
    assert sorted(tuple(r) for r in listings.save_tags(old, rows, "review_id").collect()) == [(1, 7, "neutral", "c", "pipeline"), (1, 7, "positive", "a, b", "pipeline"), (9, 7, "negative", "z", "manual")]


def test_auto_mapping_skips_unknown_categories(spark):
    words = spark.createDataFrame([("a", "친절", "직원친절"), ("b", "없음", "직원친절"), ("c", None, "기타")], "keyword string, t string, c string")
    ids = spark.createDataFrame([(1, "친절"), (2, "서비스")], "id int, name string")
    got = {r.keyword: r.tag_id for r in listings.auto_mapped(words, F.col("t"), F.col("c"), ids, {"직원친절": "서비스"}).collect()}
    assert got == {"a": 1, "b": 2, "c": None}


def test_report_warnings_and_enough(spark):
    df = spark.createDataFrame([("개선 3건 20%", 30.0, 30), ("좋음 1건", 30.0, 29), ("좋음 1건 2개", 0.0, None)], "t string, n double, review_count int")
    assert [len(r[0]) for r in df.select(listings.report_warnings(F.col("t"), F.col("n"))).collect()] == [0, 2, 0]
    assert listings.enough(df).count() == 1


def test_marks_and_events_replayed(spark):
    events = spark.createDataFrame([(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 2)), (3, dt.datetime(2026, 1, 2))], "id int, ts timestamp_ntz")
    assert {r.id for r in listings.beyond(events, "ts", events.filter("id = 1")).collect()} == {2, 3}
    assert listings.beyond(events, "ts", events.filter("id = 2")).count() == 0  # a replay finds nothing more
    assert listings.beyond(events, "ts", events.limit(0)).count() == 3


def test_operators_that_had_no_test(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    b = spark.createDataFrame([(1, "new"), (3, "other")], "id long, name string")
    assert {r.id: r.name for r in merge.set_values(a, b, "id", "name").collect()} == {1: "new", 2: None}
    rows = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 1, "c")], "k int, o int, v string")
    assert {r.k: r.v for r in ranking.latest(rows, ["k"], F.desc("o")).collect()} == {1: "b", 2: "c"}
    assert [r.v for r in filters.lookup(rows, "v", "c").collect()] == ["c"]
    texts = spark.createDataFrame([(3, "  "), (2, "b"), (1, "c")], "o int, t string")
    assert [r.t for r in readers.newest_non_blank(texts, "t", F.desc("o"), 2).collect()] == ["b"]
    nested = spark.createDataFrame([('{"location": {"lat": 1.5}, "tel": "1"}',), ("bad",)], "p string")
    got = readers.partner(nested, "p", "location struct<lat:double>, tel string").collect()
    assert (got[0].location.lat, got[0].tel, got[1].tel) == (1.5, "1", None)
    lake = spark.createDataFrame([("1", "2", None, "K5", "2026-01-01"), ("x", "2", "0", "K3", "bad")], "review_id string, branch_id string, status string, car_type string, review_date string")
    r = readers.review_rows(lake).collect()
    assert [(x.review_id, x.status, x.car_model) for x in r] == [(1, "1", "K5")]
    tags = spark.createDataFrame([(1, 10.0, "all"), (2, 10.0, "1m")], "id int, weighted_score double, period_type string")
    after = {x.id: x.weighted_score for x in merge.decayed(tags).collect()}
    assert after[1] < 10.0
    assert after[2] == 10.0
    head = spark.createDataFrame([(1, "h")], "k int, n string")
    part = spark.createDataFrame([(1, "p"), (1, "q")], "k int, v string")
    assert [(r.k, r.report) for r in reports.assembled(head, "k", {"parts": part}).collect()] == [(1, '{"n":"h","parts":[{"v":"p"},{"v":"q"}]}')]
    known = spark.createDataFrame([(1, "seen")], "id long, name string")
    assert {r.id: r.name for r in joins.enriched(a.withColumn("name", F.lit(None).cast("string")), known, "id", "name").collect()} == {1: "seen", 2: None}
