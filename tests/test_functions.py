import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import dates, numbers, sentiment, text


def value(spark, expr, *rows, schema):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expr).collect()]


def test_percent_rounds_halves_to_even(spark):
    got = value(spark, numbers.percent(F.col("a"), F.col("b")), (5, 8), (1, 8), (0, 0), (2, 3), schema="a long, b long")
    assert got == [62, 12, 0, 67]


def test_mean_of_tenths_rounds_away_from_zero(spark):
    got = value(spark, numbers.mean_tenths(F.col("a"), F.col("b")), (45, 10), (9, 2), (0, 0), schema="a long, b long")
    assert got == [0.5, 0.5, None]


def test_truthy_chain(spark):
    got = value(spark, numbers.first_truthy(F.col("a"), F.col("b")), (0.0, 4.5), (3.0, 4.0), (None, None), schema="a double, b double")
    assert got == [4.5, 3.0, None]


def test_decay(spark):
    got = value(spark, F.round(numbers.decay(F.col("d")), 4), (0,), (100,), (-5,), (None,), schema="d int")
    assert got == [1.0, 0.3679, 1.0, 1.0]
    assert value(spark, numbers.daily_decay(F.col("s")), (0.001,), schema="s double") == [0.01]


def test_periods():
    assert dates.resolve_period("1m", dt.date(2026, 3, 31)) == (dt.date(2026, 2, 28), dt.date(2026, 3, 31))
    assert dates.resolve_period("1y", dt.date(2026, 1, 15)) == (dt.date(2025, 1, 15), dt.date(2026, 1, 15))
    assert dates.resolve_period("all", dt.date(2026, 1, 15))[0] == dt.date(2020, 1, 1)
    with pytest.raises(ValueError):
        dates.parse_day("2026-2-1")
    with pytest.raises(ValueError):
        dates.check_range(dt.date(2026, 2, 1), dt.date(2026, 1, 1))


def test_ranges_at_their_ends(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1),), (dt.datetime(2026, 1, 2),), (dt.datetime(2026, 1, 2, 23, 59, 59),)], "t timestamp_ntz")
    assert df.filter(dates.half_open(F.col("t"), "2026-01-01", "2026-01-02")).count() == 1
    assert df.filter(dates.since_until(F.col("t"), "2026-01-01", "2026-01-02")).count() == 1
    assert df.filter(dates.whole_days(F.col("t"), dt.date(2026, 1, 1), dt.date(2026, 1, 2))).count() == 3
    assert [str(r[0]) for r in df.select(dates.day_chunk(F.col("t"))).collect()] == ["2025-12-31", "2026-01-01", "2026-01-02"]


def test_local_midnight_is_utc_the_day_before(spark):
    got = spark.createDataFrame([("2026-03-01",)], "d string").select(dates.local_midnight(F.col("d")).cast("string"), dates.end_of_local_day(F.col("d")).cast("string")).first()
    assert tuple(got) == ("2026-02-28 15:00:00", "2026-03-01 15:00:00")


def test_rent_class_counts_whole_days(spark):
    rows = [(dt.datetime(2026, 1, 1, 23), dt.datetime(2026, 1, 16, 1)), (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 16)), (dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 31)), (None, dt.datetime(2026, 1, 1))]
    assert value(spark, dates.rent_class(F.col("a"), F.col("b")), *rows, schema="a timestamp_ntz, b timestamp_ntz") == ["SHORT", "MONTH", "SUBSCRIPTION", None]


def test_html_and_markdown(spark):
    assert value(spark, text.strip_html(F.col("t")), ("<p>a</p>  <b>b</b>\0c",), ("",), (None,), schema="t string") == ["a b c", "", None]
    assert value(spark, text.strip_markdown(F.col("t")), ("## Head\n- **x** and `y` [z](u)",), schema="t string") == ["Head\nx and y z"]


def test_keywords(spark):
    assert value(spark, text.keywords(F.col("t"), stop=["정말"]), ("친절한 직원 정말 a 차",), schema="t string") == [["친절한", "직원"]]


@pytest.mark.parametrize(("given", "want"), [("좋았어요 그리고 차도 깨끗했어요", ["좋았어요", "차도 깨끗했어요"]), ("차는 좋지만 가격이 비싸요", ["차는 좋지만", "가격이 비싸요"]), ("ab", []), ("abc", ["abc"]), ("", [])])
def test_clauses(spark, given, want):
    assert value(spark, text.clauses(F.col("t"), ["그리고", "하지만"], ["지만", "는데", "고"]), (given,), schema="t string") == [want]


def test_clauses_keep_digits_like_their_place(spark):
    assert value(spark, text.clauses(F.col("t"), ["그리고"]), (" 00 그리고 101 그리고 202 ",), schema="t string") == [["101", "202"]]
    assert value(spark, text.clauses(F.col("t"), ["그리고"]), ("0점 입니다 그리고 1점 입니다 11",), schema="t string") == [["0점 입니다", "1점 입니다 11"]]


def test_stem_takes_the_longest_suffix_that_leaves_a_character(spark):
    got = value(spark, text.stem(F.col("w"), ["한", "하는", "는", "합니다"]), ("친절하는",), ("하는",), ("친절한",), ("한",), (" ",), schema="w string")
    assert got == ["친절", "하", "친절", "한", " "]


def test_negated_only(spark):
    got = value(spark, text.negated_only(F.lit("친절"), F.col("t"), ["불"]), ("불친절",), ("불친절 아니고 친절",), ("친절",), schema="t string")
    assert got == [True, False, False]


def test_counts_and_names(spark):
    assert value(spark, text.count_of(F.col("t"), "ab"), ("ababxab",), schema="t string") == [3]
    assert value(spark, text.sentences(F.col("t")), ("a. b.  . c",), schema="t string") == [3]
    assert value(spark, text.first_containing(F.col("t"), ["제주", "서울"], "기타"), ("서울 제주",), ("x",), schema="t string") == ["제주", "기타"]


RATINGS = "a double, b double, c double"


def test_rating_tiers(spark):
    cols = [F.col(c) for c in "abc"]
    rows = [(5.0, 2.5, 4.0), (5.0, 5.0, 5.0), (3.5, 3.5, 3.5), (3.0, 3.0, 3.0), (None, None, None)]
    assert value(spark, sentiment.from_ratings(*cols)["sentiment"], *rows, schema=RATINGS) == ["negative", "positive", "positive", "neutral", "neutral"]
    assert value(spark, sentiment.short_text(*cols), *rows, schema=RATINGS) == ["neutral", "positive", "positive", "neutral", "neutral"]


@pytest.mark.parametrize(
    ("kind", "ratings", "want"),
    [("negative", (3.0, 3.0, 3.0), "negative"), ("negative", (4.5, 4.0, 5.0), "neutral"), ("positive", (3.5, 3.5, 3.5), "positive"), ("positive", (5.0, 2.5, 4.0), "neutral"), ("negative", (3.5, 3.5, 3.5), "negative")],
)
def test_text_with_ratings(spark, kind, ratings, want):
    got = value(spark, sentiment.with_ratings(F.lit(kind), F.lit(0.8), *[F.col(c) for c in "abc"])["sentiment"], ratings, schema=RATINGS)
    assert got == [want]


def test_conflicts_leave_one_pole_and_settle_once(spark):
    tags = {"직원친절": (["친절", "상냥"], ["불친절"], []), "청결": (["깨끗"], ["더러", "냄새"], []), "가격": ([], [], [])}
    df = spark.createDataFrame([(tags, False), (tags, True)], "t map<string,struct<positive:array<string>,negative:array<string>,neutral:array<string>>>, c boolean")
    once = df.withColumn("t", sentiment.resolve_conflicts(F.col("t"), F.col("c")))
    twice = once.withColumn("t", sentiment.resolve_conflicts(F.col("t"), F.col("c")))
    a, b = once.collect()
    assert once.collect() == twice.collect()
    assert set(a["t"]) == {"직원친절", "청결"}
    assert a["t"]["직원친절"]["negative"] == [] and a["t"]["청결"]["positive"] == []
    assert b["t"]["청결"]["positive"] == []  # two negative words outweigh a concession


def test_markdown_strip_takes_every_document(spark, tmp_path):
    import re

    from tidewater.plans import catalogue

    passes = (
        (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"`([^`]+)`", r"\1"),
        (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?m)^[-*+]\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^-{3,}$", ""),
    )
    rows = [None, "", "plain", "# Head\ntext", "- a\n- b", "> quoted\n> more", "one\n---\ntwo", "see [this](http://x.y/z) and **b** `c` *d*", "### A\n\n* x\n+ y\n>z\n----"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def plain(t):
        for pattern, new in passes:
            t = re.sub(pattern, new, t)
        return t.strip(" ")

    got = {r.doc_id: r.plain for r in catalogue.markdown_strip(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else plain(t) for i, t in enumerate(rows)}
