"""Keyword resolution, roll-down, and texts with ratings, against plain Python."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.functions import polarity, tags
from tidewater.operators import tagging

REGISTRY = [
    ("직원친절", "친절", "친절"), ("직원친절", "친절", "불친절"), ("직원친절", "고객응대", "직원"), ("외관", "차종", "차종"), ("청결", "냄새", "담배냄새"), ("청결", "냄새", "냄새"),
    ("배달/배차", "배차/시간", "배차"), ("배달/배차", "대기시간", "기다"), ("사고 처리", "대차", "배차"), ("가격", "가격", "저렴한"), ("가격", "할인", "hot deal"), ("가격", "요금", ""), ("가격", "요금", None),
]
WORDS = ["친절", "친절한", "친절했습니다", "정말친절해", "배차가", "배차", "담배냄새가", "저렴", "저렴한", "저렴하고", "HOT DEAL", " 차종 ", "x", "", "  ", None, "하다", "친절", "기다림"]


def registry(spark, rows=REGISTRY):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "category string, tag string, keyword string, position long")


def stem(word, suffixes=tags.SUFFIXES):
    return next((word[: -len(s)] for s in suffixes if word.endswith(s) and len(word) > len(s)), word)


def expected(words, rows, last, suffixes=tags.SUFFIXES):
    entries = {}
    for category, tag, keyword in rows:
        if not keyword:
            continue
        if last:
            entries[keyword] = (tag, category)
            entries.setdefault(stem(keyword, suffixes), (tag, category))
        else:
            entries.setdefault(keyword, (tag, category))
    out = {}
    for keyword in {w for w in words if w and w.strip(" ")}:
        word = keyword.lower().strip(" ")
        inside = next((e for e in entries if e in word), None)
        for how, key in (("exact", word), ("stem", stem(word, suffixes)), ("inside", inside)):
            if key in entries:
                out[keyword] = (*entries[key], how)
                break
        else:
            out[keyword] = (None, None, None)
    return out


def resolved(spark, words, rows, last, **options):
    entries = (tagging.last_wins if last else tagging.first_wins)(registry(spark, rows))
    got = tagging.resolve(spark.createDataFrame([(w,) for w in words], "keyword string"), entries, **options).collect()
    assert len({r.keyword for r in got}) == len(got)
    return {r.keyword: (r.tag, r.category, r.how) for r in got}


def test_the_fixed_categories():
    assert (len(tags.CATEGORIES), sum(len(c[2]) for c in tags.CATEGORIES.values())) == (9, 52)
    assert all(default in names for _, default, names in tags.CATEGORIES.values())


def test_keywords_by_equality_stem_and_part(spark):
    for last in (False, True):
        assert resolved(spark, WORDS, REGISTRY, last) == expected(WORDS, REGISTRY, last)
    first = resolved(spark, WORDS, REGISTRY, False)
    assert first["배차"] == ("배차/시간", "배달/배차", "exact") and first["정말친절해"] == ("친절", "직원친절", "inside") and first["친절한"][2] == "stem"
    assert resolved(spark, WORDS, REGISTRY, True)["배차"][0] == "대차"


def test_random_registries_in_small_blocks(spark):
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("abcé가") for _ in range(n))
    rows = [("c", f"t{rng.randrange(9)}", made(rng.randint(1, 4))) for _ in range(60)]
    words = [made(rng.randint(1, 12)) for _ in range(300)] + ["z" * 5000 + rows[-1][2]]
    for size in (8, 1 << 16):
        assert resolved(spark, words, rows, False, block_bytes=size) == expected(words, rows, False)


def test_automaton_finds_the_first_entry():
    rng = random.Random(6)
    entries = [("".join(rng.choice("ab") for _ in range(rng.randint(1, 6))).encode(), i) for i in range(40)]
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(400)]
    a = tagging.Automaton(entries)
    want = [min((i for e, i in entries if e in w.encode()), default=tagging.NONE) for w in words]
    assert a.first_inside(pa.array(words)).tolist() == want
    assert a.first_inside(pa.array(words).slice(7, 50)).tolist() == want[7:57]
    assert len(a.first_inside(pa.array([], pa.string()))) == 0 and a.nbytes == a.step.nbytes + a.best.nbytes + np.dtype(np.int32).itemsize * 256


def test_empty_registry_and_no_words(spark):
    assert resolved(spark, ["a"], [], False) == {"a": (None, None, None)}
    assert resolved(spark, [None, ""], REGISTRY, True) == {}


def test_no_list_of_entries_is_searched_word_by_word(spark):
    got = tagging.resolve(spark.createDataFrame([("a",)], "keyword string"), tagging.first_wins(registry(spark)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Contains" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_classified_keywords_keep_their_rows(spark):
    rows = [(1, "친절한", "직원이 친절한 편"), (1, "친절한", None), (2, None, "x"), (3, "", "y"), (4, "모름", "z")]
    df = spark.createDataFrame(rows, "id long, keyword string, context string")
    alone = tagging.classify(df, tagging.first_wins(registry(spark)), polarity.of_keyword(F.col("keyword"))).collect()
    assert sorted((r.id, r.tag, r.polarity) for r in alone if r.keyword) == [(1, "친절", "positive"), (1, "친절", "positive"), (4, None, "neutral")]
    assert len(alone) == 5
    inside = tagging.classify(df, tagging.first_wins(registry(spark)), polarity.of_keyword_in(F.col("keyword"), F.col("context"))).collect()
    assert {r.polarity for r in inside if r.id == 1} == {"positive"}


def test_roll_down(spark):
    sides = "struct<positive:array<string>,negative:array<string>,neutral:array<string>>"
    rows = [
        ("A", "2026-01", {"청결": (["냄새", "담배냄새가"], [], None), "가격": ([], [], []), "기타": (["배차"], [], [])}),
        ("A", "2026-01", {"청결": (["깨끗"], ["냄새", "냄새"], ["배차가"])}), ("B", None, {"냄새": (["냄새"], None, [])}), ("B", "2026-01", None), ("B", "2026-01", {}),
    ]
    df = spark.createDataFrame(rows, f"model string, period string, tags map<string,{sides}>")
    words = spark.createDataFrame([("냄새",), ("담배냄새가",), ("깨끗",), ("배차가",)], "keyword string")
    subtags = tagging.resolve(words, tagging.last_wins(registry(spark))).select("keyword", "tag")
    got = {(r.model, r.period, r.tag): (r.positive_count, r.negative_count, r.neutral_count) for r in tagging.roll_down(df, ["model", "period"], subtags).collect()}
    assert got == {("A", "2026-01", "청결"): (3, 2, 1), ("A", "2026-01", "가격"): (0, 0, 0), ("A", "2026-01", "냄새"): (2, 2, 0), ("A", "2026-01", "대차"): (0, 0, 1), ("B", None, "냄새"): (1, 0, 0)}
    plain = {(r.model, r.tag): r.positive_count for r in tagging.roll_down(df, ["model"], None).collect()}
    assert plain == {("A", "청결"): 3, ("A", "가격"): 0, ("B", "냄새"): 1}


def test_texts_with_ratings(spark):
    rules = {"직원친절": ("친절", "불친절"), "청결": ("깨끗", "더러")}
    rows = [
        (1, "직원분이 친절하고 깨끗해서 좋았어요", 5.0, 5.0, None), (2, "직원분이 친절하고 깨끗해서 좋았어요", 2.0, 3.0, 3.0), (3, "직원분이 친절하고 깨끗해서 좋았어요", None, None, None),
        (4, "불친절하고 더러웠어요", 5.0, 5.0, 5.0), (5, "직원분이 친절하고 깨끗해서 좋았어요", 3.0, 3.0, 3.0), (6, "", 5.0, 5.0, 5.0), (7, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, text string, a double, b double, c double")
    got = {r.id: r for r in df.select("id", polarity.rated(F.col("text"), rules, F.col("a"), F.col("b"), F.col("c")).alias("s"), polarity.unified(F.col("text"), rules).alias("u")).select("id", "s.*", F.col("u.sentiment").alias("alone")).collect()}
    assert [got[i].sentiment for i in range(1, 8)] == ["positive", "negative", "positive", "neutral", "neutral", "neutral", "neutral"]
    assert got[2].confidence == 0.95 and got[4].method == "conflict" and got[4].confidence == 0.7 and got[5].confidence == 0.6 and got[7].confidence == 0.0
    assert got[3].sentiment == got[3].alone and got[7].method == "empty"
