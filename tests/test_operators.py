import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates, filters, joins, merge, ranking, reports
from tidewater.sources import readers, sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.mark.parametrize(("companies", "dropped"), [("A" * 9 + "B", 1), ("A" * 4 + "B", 1), ("AAABC", 0), ("AAAD", 0)])
def test_misrouted_by_share(spark, companies, dropped):
    df = spark.createDataFrame([(100, c) for c in companies], "branch long, company string")
    assert filters.misrouted(df, "branch", "company").filter("dropped").count() == dropped


def test_misrouted_passes_blank_rows(spark):
    df = spark.createDataFrame([(100, "A")] * 9 + [(100, " "), (100, None), (None, "B")], "branch long, company string")
    got = filters.misrouted(df, "branch", "company")
    assert got.count() == 12 and got.filter("dropped").count() == 0
    assert filters.misrouted(df.limit(0), "branch", "company").count() == 0


def test_search_ignores_what_is_not_given(spark):
    df = spark.createDataFrame([(1, "positive", dt.datetime(2026, 1, 1)), (2, "negative", dt.datetime(2026, 1, 2))], "branch_id long, sentiment string, review_date timestamp_ntz")
    assert filters.search(df).count() == 2
    assert rows(filters.search(df, {"sentiment": None}, {"branch_id": [2, 3]}, start="2026-01-02"), "branch_id") == [(2,)]


def test_in_all_needs_every_filter(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert rows(filters.in_all([a, b], "id")) == [(2,)]
    assert rows(filters.in_all([a, b.limit(0)], "id")) == []


def test_valid_reviews(spark):
    df = spark.createDataFrame([("좋아요 정말", "1"), ("짧다", "1"), ("삭제된 리뷰입니다", "삭제"), ("status is null", None)], "content string, status string")
    assert filters.valid_reviews(df).count() == 2


def test_page_past_the_end_is_empty(spark):
    df = spark.range(5)
    assert filters.page_with_total(df, [F.asc("id")], 10, 5).count() == 0
    assert filters.page_with_total(df, [F.asc("id")], 3, 5).collect()[0]["total"] == 5


def test_sorting_falls_back_and_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 4.0)], "branch_id long, avg_rating double")
    assert [r[0] for r in filters.sort_by(df, "avg_rating", True).collect()] == [3, 2, 1]
    assert [r[0] for r in filters.sort_by(df, "avg_rating", False).collect()] == [2, 3, 1]
    assert [r[0] for r in filters.sort_by(df, "drop table", False).collect()] == [1, 2, 3]


def test_upsert_policies(spark):
    base = spark.createDataFrame([(1, "a", 10, True), (2, "b", 20, True)], "id long, name string, n int, is_new boolean")
    delta = spark.createDataFrame([(2, "B", 21), (3, "C", 31)], "id long, name string, n int")
    assert rows(merge.upsert(base, delta, ["id"], ["n"]), "id", "name", "n") == [(1, "a", 10), (2, "b", 21), (3, "C", 31)]
    assert rows(merge.upsert(base, delta, ["id"], []), "id", "name", "n") == [(1, "a", 10), (2, "b", 20), (3, "C", 31)]
    got = merge.upsert(base, delta, ["id"], fixed={"is_new": F.lit(False)})
    assert rows(got, "id", "is_new") == [(1, True), (2, False), (3, False)]


def test_upsert_of_nothing_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a")], "id long, name string")
    assert rows(merge.upsert(base, base.limit(0), ["id"])) == [(1, "a")]


def test_running_mean(spark):
    df = spark.createDataFrame([(4.0, 2, 5.0, 1), (None, 0, 9.0, 2), (None, None, None, None)], "a double, n long, s double, m long")
    assert [r[0] for r in df.select(merge.running_mean(F.col("a"), F.col("n"), F.col("s"), F.col("m"))).collect()] == [4.33, 4.5, None]


def test_insert_missing_numbers_on(spark):
    master = spark.createDataFrame([(7, "K3")], "id long, name string")
    names = spark.createDataFrame([(" K5 ",), ("K3",), ("K5",), ("",), ("A1",)], "name string")
    assert rows(merge.insert_missing(master, names, "name", "id"), "id", "name") == [(7, "K3"), (8, "A1"), (9, "K5")]


def test_remap_keeps_one_of_each_key(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 10, "c")], "review long, tag long, word string")
    legacy = spark.createDataFrame([(10, 20)], "old long, new long")
    assert rows(merge.remap(df, legacy, ["review", "tag"], "tag", [F.asc("word")]), "review", "tag", "word") == [(1, 20, "b"), (2, 20, "c")]


def test_cascade_and_ghosts(spark):
    reviews, mappings = spark.createDataFrame([(1,), (2,)], "review_id long"), spark.createDataFrame([(1, 5), (2, 6)], "review_id long, tag_id long")
    gone = merge.ghosts(reviews, spark.createDataFrame([(2,)], "review_id long"), ["review_id"])
    left = merge.delete_cascade(reviews, mappings, gone)
    assert rows(left[0]) == [(2,)] and rows(left[1]) == [(2, 6)]


def test_orphan_and_read_marks(spark):
    tags, categories = spark.createDataFrame([(1, 9), (2, 8)], "id long, category_id long"), spark.createDataFrame([(8,), (9,)], "id long")
    t, c = merge.orphan(tags, categories, 9)
    assert rows(t) == [(1, None), (2, 8)] and rows(c) == [(8,)]
    df = spark.createDataFrame([(1, True), (2, True)], "review_id long, is_new boolean")
    assert rows(merge.mark_read(df, df.filter("review_id = 1"))) == [(1, False), (2, True)]
    assert rows(merge.mark_read(df)) == [(1, False), (2, False)]


def test_pending_map(spark):
    df = spark.createDataFrame([({"1m": "x"},), (None,)], "p map<string,string>")
    assert [r[0] for r in df.select(merge.pending_set(F.col("p"), "1m", F.lit("y"))).collect()] == [{"1m": "y"}, {"1m": "y"}]
    assert df.select(merge.pending_drop(F.col("p"), "1m")).first()[0] == {}


def test_summary_for_empties_the_others(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", "d", "e")], "branch_id long, summary_1m string, summary_3m string, summary_6m string, summary_1y string, summary_all string")
    assert tuple(merge.summary_for(df, "3m", F.lit("new"), F.col("branch_id") == 1).first()) == (1, None, "new", None, None, None)


TAGS = [("친절한 직원", "서비스", 80, 5, 10), ("깨끗한 차량", "청결", 60, 20, 5), ("비싼 가격", "가격", 5, 50, 10), ("빠른 출고", "서비스", 40, 3, 2), ("냄새", "청결", 2, 30, 5)]


def tags(spark):
    df = spark.createDataFrame(TAGS, "tag string, category string, positive_count long, negative_count long, neutral_count long")
    return df.withColumn("total_count", F.col("positive_count") + F.col("negative_count") + F.col("neutral_count"))


def test_category_rollup_and_strengths(spark):
    cats = aggregates.rollup_categories(tags(spark))
    assert rows(cats, "category", "positive_count", "negative_count", "total_count") == [("가격", 5, 50, 65), ("서비스", 120, 8, 140), ("청결", 62, 50, 122)]
    assert [r["label"] for r in reports.strengths(cats).collect()] == ["서비스(86%)"]
    assert [r["category"] for r in reports.improvements(cats).collect()] == ["가격", "청결"]


@pytest.mark.parametrize(("now", "before", "want"), [(53, 50, "up"), (47, 50, "down"), (70, 72, "stable")])
def test_trend_at_its_bounds(spark, now, before, want):
    make = lambda n: spark.createDataFrame([("청결", n, 100)], "category string, positive_count long, total_count long")
    assert reports.trend(make(now), make(before)).first()["direction"] == want


def test_actions_name_the_worst_tag(spark):
    got = reports.priority_actions(aggregates.rollup_categories(tags(spark)), tags(spark), {"가격": "review prices"}, "look").collect()
    assert [(r["rank"], r["category"], r["impact"], r["worst_tag"], r["action"]) for r in got] == [(1, "가격", "high", "비싼 가격", "review prices"), (2, "청결", "high", "냄새", "look")]


def test_vehicle_rankings(spark):
    data = [("K3", "외관", 5, 2, 7), ("K3", "차량외관", 3, 1, 4), ("K3", "신차", 2, 0, 2), ("K5", "청결", 0, 4, 4)]
    df = spark.createDataFrame(data, "car_model string, tag string, positive_count long, negative_count long, total_count long")
    assert [tuple(r) for r in reports.vehicle_rankings(df, "positive").collect()] == [("K3", 10, 13, "외관(5), 차량외관(3)")]


def test_fallback_where_tags_are_few(spark):
    few, many = tags(spark).limit(2), tags(spark)
    assert reports.with_fallback(few, many).count() == 5 and reports.with_fallback(many, few).count() == 5


def test_tfidf_prefers_rare_tags(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (2, "a", 5)], "branch long, tag string, count long")
    assert [(r["tag"], r["rank"]) for r in ranking.tfidf(df, "branch", "tag", 1).filter("branch = 1").collect()] == [("b", 1)]


def test_even_sample_indices(spark):
    df = spark.range(40).withColumn("g", F.lit(1))
    got = [r["position"] - 1 for r in ranking.even_sample(df, ["g"], [F.asc("id")], 30, 4).collect()]
    assert sorted(got) == [int(i * 30 / 4) for i in range(4)]
    assert ranking.even_sample(df.limit(3), ["g"], [F.asc("id")], 30, 5).count() == 3


def test_better_percent_leaves_out_unrated(spark):
    df = spark.createDataFrame([(1, "r", 5.0), (2, "r", 4.0), (3, "r", 4.0), (4, "r", 0.0), (5, "r", None)], "id long, region string, rating double")
    assert rows(ranking.better_percent(df, "region", "rating"), "id", "better", "top_percent") == [(1, 0, 0), (2, 1, 33), (3, 1, 33)]


def test_nearest_needs_likeness(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "id long, vector array<double>")
    c = spark.createDataFrame([("x", [1.0, 0.1]), ("y", [0.0, 1.0])], "name string, centre array<double>")
    assert rows(ranking.nearest(v, c, 0.5, "기타"), "id", "name") == [(1, "x"), (2, "기타")]


def test_star_casts_keys_of_different_types(spark):
    fact, dim = spark.createDataFrame([("1",), ("x",)], "k string"), spark.createDataFrame([(1, "one")], "id long, name string")
    assert rows(joins.star(fact, [(dim, {"k": "id"}, "left")])) == [("1", "one"), ("x", None)]


def test_aligned_fills_missing_sides(spark):
    a, b = spark.createDataFrame([("x", 1)], "k string, n long"), spark.createDataFrame([("y", 2)], "k string, n long")
    assert rows(joins.aligned(a, b, "k", ["n"])) == [("x", 1, 0), ("y", 0, 2)]


def test_upload(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text('﻿리뷰번호,지점번호,리뷰내용\n1,100,좋아요\n2,x,"여러\n줄"\n,3,별로\n', encoding="utf-8")
    good, bad = readers.split_errors(readers.checked(readers.renamed(readers.csv(spark, str(path)))))
    assert rows(good, "review_id", "branch_id", "content") == [(1, 100, "좋아요")]
    assert sorted(r["error"] for r in bad.collect()) == ["branch_id is not a number", "review_id is missing"]
    with pytest.raises(ValueError):
        readers.renamed(spark.createDataFrame([("1",)], "`리뷰번호` string"))


def test_spread_and_report(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b", "c"])], "id long, words array<string>")
    assert rows(sinks.spread(df, "words", 2, "word")) == [(1, "a", ""), (2, "a", "b")]
    doc = spark.createDataFrame([('{"top_keywords": ["x"]}',)], "d string").select(sinks.load_report(F.col("d"), "top_tags array<string>").alias("r"))
    assert doc.first()["r"]["top_tags"] == ["x"]


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2):
        sinks.replace(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
