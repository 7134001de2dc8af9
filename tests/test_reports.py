"""Reports by category and model, summary checks, regions, options and small operators, against plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewater.functions import dates, regions, sentiment, summaries
from tidewater.operators import filters, joins, listings, merge, reports, tagging
from tidewater.sources import readers, sinks

TAGS = "branch long, tag string, category string, positive_count long, negative_count long, total_count long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_tags_by_category(spark):
    whole = [(1, f"t{i:02}", f"c{i % 4}" if i % 5 else None, i, 1, 2 * i + 1) for i in range(20)] + [(2, "a", "x", 1, 0, 1), (None, "n", "x", 0, 0, 0)]
    recent = [(1, "r1", "c", 3, 0, 3), (1, "r2", "d", 1, 4, 5), (1, "r3", "c", 2, 2, 4), (1, "", "d", 9, 0, 9), (2, "only", "x", 1, 0, 1), (2, "two", "x", 1, 0, 1)]
    got = {(r.branch, r.category): (r.place, [tuple(t) for t in r.tags]) for r in reports.grouped_tags(spark.createDataFrame(recent, TAGS), spark.createDataFrame(whole, TAGS), "branch").collect()}
    assert got[1, "d"] == (1, [("r2", 20, 80, 5)]) and got[1, "c"] == (2, [("r3", 50, 50, 4), ("r1", 100, 0, 3)])
    assert got[2, "x"] == (1, [("a", 100, 0, 1)]) and got[None, "x"] == (1, [("n", 0, 0, 0)])
    alone = reports.grouped_tags(spark.createDataFrame([], TAGS), spark.createDataFrame(whole, TAGS), "branch").filter("branch = 1").collect()
    assert sum(len(r.tags) for r in alone) == 15 and {r.category for r in alone} == {"c0", "c1", "c2", "c3", "기타"}
    assert [r.place for r in sorted(alone, key=lambda r: -max(t.total for t in r.tags))] == [1, 2, 3, 4, 5]


MODEL_TAGS = "car_model string, tag string, category string, positive_count long, negative_count long, total_count long"
ANALYSIS = "car_model string, count long, like_ratio long, dislike_ratio long, top_praise string, top_issue string"


def test_models_by_tags_of_their_own(spark):
    tags = [
        ("K5", "청결", "청결", 9, 9, 18), ("K5", "냄새", "청결", 2, 5, 7), ("K5", "시트", "청결", 2, 0, 2), ("K5", "트렁크", "청결", 1, 0, 1), ("K5", "친절", "직원친절", 50, 50, 100), ("K3", "외관", "외관", 4, 0, 4),
        ("K7", "신차", "외관", 0, 0, 0), ("A", "냄새", "청결", 0, 5, 5), ("B", "냄새", "청결", 5, 0, 5),
    ]
    analysis = [("K5", 30, 10, 10, "x", "y"), ("K3", 0, 1, 1, None, None), ("other", 9, 99, 99, "p", "q")]
    got = reports.model_ranking(spark.createDataFrame(tags, MODEL_TAGS), spark.createDataFrame(analysis, ANALYSIS), ["청결", "외관"])
    assert [tuple(r) for r in got.filter("list = 'liked'").orderBy("place").collect()] == [
        ("liked", 1, "K5", 30, 5, ["냄새(2건)", "시트(2건)"]), ("liked", 2, "B", 5, 5, ["냄새(5건)"]), ("liked", 3, "K3", 4, 4, ["외관(4건)"]), ("liked", 4, "A", 5, 0, []), ("liked", 5, "K7", 0, 0, []),
    ]
    assert [tuple(r) for r in got.filter("list = 'disliked'").orderBy("place").collect()] == [("disliked", 1, "K5", 30, 5, ["냄새(5건)"]), ("disliked", 2, "A", 5, 5, ["냄새(5건)"])]


def test_models_from_the_analysis(spark):
    analysis = spark.createDataFrame([("K5", 30, 55, 10, "좋음(3)", ""), ("K3", 10, 90, 0, None, "나쁨(1)"), ("", 99, 99, 99, "", ""), ("K0", 0, 99, 99, "", "")], ANALYSIS)
    for tags in ([], [("SUV", "냄새", "청결", 9, 9, 18)]):
        got = reports.model_ranking(spark.createDataFrame(tags, MODEL_TAGS), analysis, ["청결"])
        assert rows(got) == sorted([("liked", 1, "K5", 30, 16, ["좋음(3)"]), ("liked", 2, "K3", 10, 9, []), ("disliked", 1, "K5", 30, 3, [])], key=repr)


def test_weights_of_keyword_arrays(spark):
    sides = "struct<positive:array<string>,negative:array<string>,neutral:array<string>>"
    data = [(1, 0, {"a": (["x", "y"], None, []), "기타": (["z"], [], [])}), (1, 10, {"a": ([], ["x"], [])}), (1, -5, {"b": ([], [], [])}), (2, None, {"a": (None, None, ["q"])}), (2, 1, None)]
    df = spark.createDataFrame(data, f"branch long, days int, tags map<string,{sides}>")
    got = {(r.branch, r.tag): (r.positive_count, r.negative_count, r.neutral_count, r.total_count, round(r.weight, 6)) for r in tagging.array_weights(df, ["branch"], F.col("days"), skip="기타").collect()}
    assert got == {(1, "a"): (2, 1, 0, 3, round(2 + 2.718281828459045**-0.1, 6)), (1, "b"): (0, 0, 0, 0, 0.0), (2, "a"): (0, 0, 1, 1, 1.0)}


MARKS = (r"\*\*[^*]+\*\*", r"__[^_]+__", r"(?<!\w)\*[^*]+\*(?!\w)", r"#+\s+\w", r"\[.+\]\(.+\)", r"`[^`]+`", r"^\s*[-*•]\s+", r"^\s*\d+\.\s+", r"\[[^\]]{2,}\]")


def test_what_summaries_lack(spark):
    rng = random.Random(4)
    texts = ["", None, " \n", "좋은 지점. " * 30, "최고의 짱 지점. " * 10, "a **b** c. d. e. " + "x" * 100, "first. second. third. 😀 " + "y" * 100, "1. one\n2. two. three. four." + "z" * 90, "a*b*c. d. e. " + "x" * 100, "é*b* c. d. e. " + "x" * 100]
    texts += ["".join(rng.choice("ab*_#[]()`- •1.\n😀☀é ") for _ in range(rng.choice([8, 120, 400]))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for mode, b in summaries.BOUNDS.items():
        for r in df.select("id", summaries.errors(F.col("text"), mode).alias("e")).collect():
            t = (texts[r.id] or "").strip()
            if not t:
                assert r.e == ["empty"]
                continue
            n = len([s for s in t.split(".") if s.strip()])
            want = [f"few sentences: {n}"] if n < b.least_sentences else [f"many sentences: {n}"] if n > b.most_sentences else []
            want += [f"few characters: {len(t)}"] if len(t) < b.least_chars else [f"many characters: {len(t)}"] if len(t) > b.most_chars else []
            bad = [w for w in summaries.FORBIDDEN if w in t.lower()]
            want += [f"forbidden: {', '.join(bad)}"] if bad else []
            want += ["marks"] if any(re.search(p, t, re.M) for p in MARKS) or re.search("[😀☀]", t) else []
            assert r.e == want, (t, r.e, want)


def test_regions_of_names(spark):
    names = ["제주공항점", "제주 서귀포", "강남 본점", "INCHEON 공항", "", None, "부산 김해공항", "서울 강남구", "해외 괌", "도쿄"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", regions.kind(F.col("n")).alias("k"), regions.region_in(F.col("n")).alias("r"), regions.group(F.col("n")).alias("g")).collect()
    assert [r.k for r in got] == ["airport", "tourist", "city", "airport", "default", "default", "airport", "city", "city", "city"]
    assert [r.r for r in got] == ["제주공항", "제주", "강남", None, None, None, "김해공항", "강남", None, None]
    assert [r.g for r in got] == ["해외", "제주도", "서울", "해외", "해외", "해외", "경상도", "서울", "해외", "해외"]
    assert set(regions.GROUPS.values()) == set(regions.GROUP_ORDER)


def test_options_of_filters(spark):
    branches = spark.createDataFrame([(2, "나", "서울 강남"), (1, "가", "제주 시내"), (3, "가", None), (4, None, " "), (5, "다", "화성")], "branch_id long, branch_name string, region string")
    companies = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("a",)], "company string")
    got = listings.options(branches, companies, "region", regions.group(F.col("region")), "branch_id", "branch_name", "company", regions.GROUP_ORDER)
    listed = {k: [(r.value, r.parent) for r in sorted((r for r in got.collect() if r.kind == k), key=lambda r: r.place)] for k in ("group", "region", "company", "branch")}
    assert listed["group"] == [("서울", None), ("제주도", None), ("해외", None)] and listed["company"] == [("a", None), ("b", None)]
    assert listed["region"] == [("서울 강남", "서울"), ("제주 시내", "제주도"), ("화성", "해외")]
    assert [v for v, _ in listed["branch"]] == ["4", "1", "3", "2", "5"]
    summaries_ = spark.createDataFrame([(1, "나", "서울"), (2, "가", None), (0, "x", "y"), (3, "", "z"), (None, "w", "v")], "branch_id long, branch_name string, region string")
    assert [tuple(r) for r in listings.with_company(summaries_, spark.createDataFrame([(1, "c")], "branch_id long, company string"), "branch_id", "company", "region").collect()] == [(2, "가", "", ""), (1, "나", "c", "서울")]


def test_stored_rows_and_partner_records(spark):
    df = spark.createDataFrame([(None, 7, None, None, 4.5, "2026-01-02 03:04:05", "bad", None, 3, None, ""), (1, 2, 5, "x", None, None, None, 9, None, True, "normal")], "id long, review_id long, branch_id long, content string, rating double, review_date string, created_at string, helpful_count long, like_count long, is_blind boolean, status string")
    a, b = readers.review_records(df).orderBy("branch_id").collect()
    assert (a.id, a.branch_id, a.content, a.rating, a.created_at, a.like_count, a.is_blind, a.status, a.car_model) == (7, 0, "", 4.5, dt.datetime(2026, 1, 2, 3, 4, 5), 3, False, "normal", "")
    assert (b.id, b.branch_id, b.rating, b.created_at, b.like_count, b.is_blind) == (1, 5, None, None, 9, True)
    raw = [('{"id": "12", "name": "N", "location": {"address": "A", "latitude": "33.5", "longitude": ""}, "tel": {"number": "064"}}',), ('{"id": 13, "tel": null}',), ("broken",), (None,)]
    got = [tuple(r)[:7] for r in readers.affiliates(spark.createDataFrame(raw, "p string"), "p").collect()]
    assert got == [(12, "N", "PARTNERS", "A", "064", 33.5, None), (13, "", "PARTNERS", "", "", None, None), (None, "", "PARTNERS", "", "", None, None), (None, "", "PARTNERS", "", "", None, None)]


def test_shown_sentiments_and_rows(spark):
    data = [(1, "positive", 1.0, None), (2, None, 2.0, None), (3, "", 5.0, "negative"), (4, None, 4.0, None), (5, "x", 3.2, None), (6, None, 3.0, "positive"), (7, None, None, None)]
    df = spark.createDataFrame(data, "review_id long, sentiment string, r double, judged string")
    none = F.lit(None).cast("double")
    got = {r.review_id: r.s for r in df.select("review_id", sentiment.shown(F.col("sentiment"), F.col("judged"), F.col("r"), none, none).alias("s")).collect()}
    assert got == {1: "positive", 2: "negative", 3: "neutral", 4: "positive", 5: "neutral", 6: "neutral", 7: "neutral"}
    text = F.lit(None).cast("string")
    wide = df.select("review_id", "sentiment", F.col("r").cast("string").alias("rating_service"), F.lit("bad").alias("rating_car"), text.alias("rating_convenience"), *[text.alias(c) for c in ("reservation_id", "branch_id", "branch_name", "company_name", "content", "car_model")], *[F.lit("2026-01-02 03:04:05").cast("timestamp").alias(c) for c in ("review_date", "rental_date", "return_date")], F.lit(None).cast("boolean").alias("is_new"))
    shown = {r.review_id: r for r in listings.display_rows(wide).collect()}
    assert {i: shown[i].sentiment for i in (1, 2, 4, 7)} == {1: "positive", 2: "negative", 4: "positive", 7: "neutral"}
    assert (shown[1].branch_name, shown[1].rating_car, shown[1].review_date, shown[1].is_new) == ("", None, "2026-01-02T03:04:05", False)


def test_filters_and_marks(spark):
    docs = spark.createDataFrame([("{}",), ('{"a": 1}',), ("",), (None,), ("[1]",), ("broken",)], "d string")
    assert [r.d for r in docs.filter(filters.json_not_empty(F.col("d"))).collect()] == ['{"a": 1}']
    reviews = spark.createDataFrame([("long enough", "normal", False), ("long enough", "blind", False), ("long enough", "삭제", None), ("long enough", None, True), ("abc ", "normal", False), (None, None, None), ("12345", None, None)], "content string, status string, is_blind boolean")
    assert [r.content for r in filters.valid_reviews(reviews).collect()] == ["long enough", "12345"]
    base = spark.createDataFrame([(1, True), (2, False), (3, None), (2, True)], "review_id long, is_new boolean")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "review_id long")
    assert merge.newly_read(base).first().changed == 2 and merge.newly_read(base, ids).first().changed == 2
    s = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "branch_id long, summary_all string, owner string")
    assert rows(merge.patched(s, {"summary_all": F.lit("new")}, F.col("branch_id") == 2)) == [(1, "a", "x"), (2, "new", "y")]
    for wrong in ("owner", "summary_1m"):
        with pytest.raises(ValueError):
            merge.patched(s, {wrong: F.lit("z")}, F.lit(True))
    assert spark.range(1).select(dates.korean_day(F.lit(dt.date(2026, 3, 4))).alias("d")).first().d == "2026년 03월 04일"


def test_samples_of_each_key(spark):
    df = spark.createDataFrame([(1, i, f"{i}" * 300) for i in range(12)] + [(1, 99, " "), (2, 1, None), (None, 1, "x")], "k long, o long, t string")
    got = {r.k: r.samples for r in listings.samples(df, "k", "t", [F.desc("o")]).collect()}
    assert set(got) == {1, None} and len(got[1]) == 8 and [len(s) for s in got[1]] == [250] * 8 and got[1][0].startswith("1111") and got[None] == ["x"]


def test_jobs_joins_and_exports(spark, tmp_path):
    now = dt.datetime(2026, 1, 10)
    jobs = spark.createDataFrame([(1, "completed", dt.datetime(2026, 1, 1)), (2, "failed", dt.datetime(2026, 1, 9)), (3, "processing", dt.datetime(2026, 1, 9, 23)), (4, "processing", dt.datetime(2026, 1, 9, 23, 45)), (5, None, None)], "id long, status string, updated_at timestamp_ntz")
    assert {r.id: r.status for r in merge.expire_jobs(jobs, F.lit(now)).collect()} == {2: "failed", 3: "failed", 4: "processing", 5: None}
    mappings = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 99)], "review_id long, tag_id long")
    reviews = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "review_id long, content string")
    named = spark.createDataFrame([(10, "a", 5), (11, "b", None), (12, "c", 6)], "id long, name string, category_id long")
    cats = spark.createDataFrame([(5, "cat")], "id long, name string")
    assert rows(joins.tagged(mappings, reviews, named, cats).select("review_id", "content", "tag", "category")) == [(1, "r1", "a", "cat"), (1, "r1", "b", None), (2, "r2", "c", None)]
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "name string, id long")
    facts = spark.createDataFrame([("a", 5), ("z", 6)], "tag string, n long")
    assert [r.asDict() for r in joins.resolved(facts, dim, "tag", "id", "tag_id").collect()] == [{"n": 5, "tag_id": 1}]
    assert [r.asDict() for r in joins.resolved(facts, dim.withColumnRenamed("name", "title"), "tag", "id", "tag_id", "title").collect()] == [{"n": 5, "tag_id": 1}]
    out = sinks.export(spark.createDataFrame([(i, f"r{i}", 'say "hi"') for i in range(5)], "review_id long, other string, content string"), [F.desc("review_id")], 3)
    sinks.write_csv(out, str(tmp_path / "x"))
    assert out.columns == ["리뷰번호", "리뷰내용"] and [r[0] for r in out.collect()] == [4, 3, 2]
    assert rows(readers.csv(spark, str(tmp_path / "x"))) == [("2", 'say "hi"'), ("3", 'say "hi"'), ("4", 'say "hi"')]


def test_reports_of_branches_with_enough_reviews(spark):
    head = spark.createDataFrame([(1, "A", 30), (2, "B", 29)], "branch_id long, name string, review_count long")
    tags = spark.createDataFrame([(1, "t2", 5), (1, "t1", 7), (2, "t3", 1)], "branch_id long, tag string, n long")
    got = reports.assembled(listings.enough(head), "branch_id", {"tags": tags, "none": tags.limit(0)}).collect()
    assert [(r.branch_id, r.report) for r in got] == [(1, '{"name":"A","review_count":30,"tags":[{"tag":"t1","n":7},{"tag":"t2","n":5}]}')]
