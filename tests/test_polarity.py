"""Korean rules: texts, clauses by aspect, keywords in context."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewater.functions import packs, polarity, sentiment
from tidewater.plans import pages

REGISTRY = pages.REGISTRY


def rows(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


@pytest.mark.parametrize(
    ("text", "sentiment", "confidence"),
    [
        (None, "neutral", 0.0), ("", "neutral", 0.0), (" \t\n", "neutral", 0.0),
        ("불편하지 않았어요", "positive", 0.95),  # a complaint denied
        ("친절하지 않았습니다", "negative", 0.85),  # praise denied
        ("최악이고 실망했어요", "negative", 0.8),  # two strong complaints
        ("틀림없는 곳", "positive", 0.8),
        ("설명이 하나 없이 차만 주고 가는 곳이었고 정말로 그랬습니다", "negative", 0.9),
        ("냄새가 나요", "negative", 0.7), ("최고", "positive", 0.85), ("잘 이용했습니다", "positive", 0.8),
        ("최고최고최고", "positive", 0.85), ("가" * 10000, "neutral", 0.4), ("ㅠㅠ", "negative", 0.5), ("'; DROP TABLE x; --", "neutral", 0.4),
    ],
)
def test_text(spark, text, sentiment, confidence):
    got = rows(spark, text).select(polarity.of_text(F.col("t")).alias("s")).first().s
    assert (got.sentiment, round(got.confidence, 6)) == (sentiment, confidence)


def test_repetition_makes_surer(spark):
    long = "정말로 이곳은 언제 가더라도 참으로 대단한 곳이라 생각합니다 "
    got = [r.s.confidence for r in rows(spark, long + "친절 친절 친절", long + "친절 깨끗 저렴").select(polarity.of_text(F.col("t")).alias("s")).collect()]
    assert [round(c, 6) for c in got] == [0.95, 0.9]


def test_reviews_by_aspect(spark):
    want = {
        "직원분이 정말 친절하셨고 차량도 깨끗해서 만족합니다": ({"직원친절", "청결"}, "positive"),
        "가격은 저렴한데 차가 너무 더러웠어요. 담배냄새가 심했습니다": ({"가격", "청결"}, "mixed"),
        "배차가 늦어서 한참을 기다렸습니다. 직원도 불친절했어요": ({"배달/배차", "직원친절"}, "negative"),
        "걱정했는데 괜한 걱정이었어요. 깨끗하고 친절해서 감사합니다": ({"청결", "직원친절"}, "positive"),
    }
    got = rows(spark, *want).select("t", polarity.analysed(F.col("t"), REGISTRY).alias("a"), polarity.overview(polarity.classified(F.col("t"), REGISTRY)).alias("o")).collect()
    for r in got:
        assert want[r.t][0] <= {x.aspect for x in r.a}
        assert r.o.overall == want[r.t][1]


def test_keywords_that_need_a_context(spark):
    got = rows(spark, "안심하고 이용했어요", "보험이 있어서 안심했어요", "처리가 빠르네요").select(polarity.analysed(F.col("t"), REGISTRY).alias("a")).collect()
    assert ["사고 처리" in {x.aspect for x in r.a} for r in got] == [False, True, False]


def test_negating_prefix(spark):
    got = rows(spark, "불친절했어요", "불친절하지만 친절한 분도").select(polarity.aspects(F.col("t"), {"직원친절": ("친절",)}).alias("a")).collect()
    assert [len(r.a) for r in got] == [0, 1]


@pytest.mark.parametrize(
    ("word", "context", "want"),
    [
        ("친절", None, "positive"), ("불친절", "", "negative"), ("차량", "다른 말", "neutral"), ("친절", "직원이 불친절했어요", "negative"), ("친절", "친절했지만 차가 더러웠어요", "positive"),
        ("차량", "친절했지만 차량이 더러웠어요", "negative"), ("깨끗", "깨끗하지 않았어요", "negative"), ("냄새", "냄새가 전혀 없었어요", "positive"), ("차량", "나빠요 " + "가" * 60 + "차량", "neutral"),
    ],
)
def test_keyword_in_context(spark, word, context, want):
    df = spark.createDataFrame([(word, context)], "w string, c string")
    assert df.select(polarity.of_keyword_in(F.col("w"), F.col("c"))).first()[0] == want


def test_own_clause_takes_the_nearest_mark(spark):
    df = rows(spark, "가지만 나는데 다")
    assert [df.select(polarity.own_clause(F.col("t"), F.lit(i))).first()[0] for i in (0, 4, 8)] == ["가", "가지만 나", " 다"]


def test_hybrid_adds_tagged_keywords_and_caps(spark):
    tag = lambda w: polarity.rule_tag(w, w, {"차": ("차량", "바퀴"), "유리": ("유리",)})
    df = rows(spark, "친절한 직원 응대 상냥 차량 바퀴 유리")
    got = df.select(polarity.hybrid(F.col("t"), F.array(*[F.lit(w) for w in ("차량", "직원", "바퀴", "모름")]), tag, REGISTRY).alias("h")).first().h
    assert got["차"].positive == ["차량", "바퀴"]
    assert len(got["직원친절"].positive) == 3
    assert set(got) == {"차", "직원친절"}


def test_rule_tag_exact_stem_contained(spark):
    df = spark.createDataFrame([("친절", ""), ("깨끗한", "깨끗"), ("새차냄새", ""), ("없음", "")], "w string, s string")
    got = [r[0] for r in df.select(polarity.rule_tag(F.col("w"), F.col("s"), {"a": ("친절",), "b": ("깨끗",), "c": ("냄새",)})).collect()]
    assert got == ["a", "b", "c", None]


def test_unified_and_conflicts(spark):
    got = rows(spark, "직원이 친절했어요", None).select(polarity.unified(F.col("t"), REGISTRY).alias("u")).collect()
    assert [(r.u.sentiment, r.u.method) for r in got] == [("positive", "agreed"), ("neutral", "empty")]
    tags = "map<string,struct<positive:array<string>,negative:array<string>,neutral:array<string>>>"
    df = spark.createDataFrame([({"직원친절": (["친절", "상냥"], ["불친절"], []), "청결": (["깨끗"], ["더러", "냄새"], [])},)], f"t {tags}")
    once = sentiment.resolve_conflicts(F.col("t"), F.lit(False))
    twice = sentiment.resolve_conflicts(once, F.lit(False))
    r = df.select(once.alias("a"), twice.alias("b")).first()
    assert r.a == r.b
    assert (r.a["직원친절"].negative, r.a["청결"].positive) == ([], [])


def test_fixed_tables_are_patterns():
    assert all(len(x) < 200 for x in (packs.NEGATIVE, packs.POSITIVE, packs.DOUBLE_NEGATION, packs.EXCEPTIONS))
    assert len(packs.CONJUNCTIONS) == 17
