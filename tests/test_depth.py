"""Skewed and substring joins, totals, pending values and windows of branches, against plain Python."""

import datetime as dt
import random
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates, history, joins, reports, skew


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_aqe(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def skewed(spark, n=30000):
    """A third of the rows has one key, a third none, the others are spread."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") + 1000).alias("k"), F.col("id").alias("v"), F.lit("x").alias("text"))


def test_no_task_of_a_salted_join_is_large(no_aqe):
    fact = skewed(no_aqe)
    dim = no_aqe.range(0, 40000, 2).select((F.col("id") + F.lit(1)).cast("string").alias("key"), (F.col("id") * 10).alias("w"))
    on = {"k": (F.col("k"), F.col("key"))}
    plain = fact.join(dim, F.col("k").cast("string") == F.col("key"), "left")
    got = skew.salted(fact, dim, on)
    assert rows(got) == rows(plain.select(*got.columns))
    most = lambda df: max(Counter(r.p for r in df.filter(F.col("k").isNotNull()).select(F.spark_partition_id().alias("p")).collect()).values())
    assert most(plain) > 10000 and most(got) < 20000 * 0.05
    assert rows(skew.salted(fact, dim, on, "inner")) == rows(plain.filter(F.col("key").isNotNull()).select(*got.columns))


def test_salted_keys_that_are_null_cast_or_repeated(spark):
    fact = spark.createDataFrame([(1, "1"), (1, "x"), (2, "2"), (None, "1"), (1, None), (1, "1")], "a long, code string")
    dim = spark.createDataFrame([("1", 1, "p"), ("1", 1, "q"), ("2", 2, "r"), (None, 1, "s"), ("9", 9, "t")], "serial string, type int, name string")
    on = {"serial": (F.col("a"), F.col("serial")), "type": (F.col("code").try_cast("int"), F.col("type"))}
    for share in (0.3, 0.01):
        got = skew.salted(fact, dim, on, share=share)
        assert rows(got.select("a", "code", "name")) == sorted([(1, "1", "p"), (1, "1", "q"), (1, "1", "p"), (1, "1", "q"), (1, "x", None), (2, "2", "r"), (None, "1", None), (1, None, None)], key=repr)
    assert rows(skew.salted(fact.limit(0), dim, on)) == [] and len(rows(skew.salted(fact, dim.limit(0), on))) == 6
    with pytest.raises(ValueError):
        skew.salted(fact, dim, on, "full")
    with pytest.raises(ValueError):
        skew.hot_keys(fact, "code", 0.0001)


def test_words_inside_texts(spark):
    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abé\n.가") for _ in range(n))
    texts = [(i, made(rng.randint(0, 60))) for i in range(80)] + [(1, "same"), (1, "same"), (None, "a b"), (5, None), (6, ""), (7, "z" * 50000 + "needle" + "z" * 50000)]
    words = [made(rng.randint(1, 6)) for _ in range(60)] + ["needle", "am", "same", "", None, "absent", "needle", "a.b", "zzzz"]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "id long, text string, _gram2 string")
    got = skew.containing(df, "text", spark.createDataFrame([(w,) for w in words], "word string"), "word")
    want = [(i, w) for i, t in texts for w in {w for w in words if w} if t is not None and w in t]
    assert rows(got.select("id", "word")) == sorted(want, key=repr) and got.columns == [*df.columns, "word"]
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    small = skew.containing(df, "text", spark.createDataFrame([(w,) for w in words], "word string"), "word", block=16)
    assert rows(small.select("id", "word")) == sorted(want, key=repr)
    assert rows(skew.containing(df, "text", spark.createDataFrame([("",)], "word string"), "word")) == []


def test_words_are_compared_in_place(spark, monkeypatch):
    rng = random.Random(8)
    made = lambda n: "".join(rng.choice("ab\0\U0010ffff😀é ") for _ in range(n))
    texts = ["", "a", "ab", "abab", "ba\0", "\0ab", None, "x" * 300 + "end", "en", "d", *[made(rng.randint(0, 40)) for _ in range(120)]]
    words = sorted({"a", "b", "ab", "\0", "\0\0", "a\0b", "abab", "x" * 299 + "end", "end", "xend", "y" * 400, *[made(rng.randint(1, 5)) for _ in range(80)]})
    want = [[w for w in words if t and w in t] for t in texts]
    for chars in (1, 50, 1 << 19):
        monkeypatch.setattr(skew, "CHARS", chars)
        got = [x for batch in skew._finder(SimpleNamespace(value=words))(iter([pa.array(texts), pa.array([], pa.string())])) for x in batch.to_pylist()]
        assert [sorted(x) for x in got] == want
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for block in (1 << 17, 20):
        made_of = skew.containing(df, "t", spark.createDataFrame([(w,) for w in words], "word string"), "word", block=block)
        assert rows(made_of) == sorted(((t, w) for t, ws in zip(texts, want, strict=True) for w in ws), key=repr)
        assert "Join" not in plan(made_of) and "Exchange" not in plan(made_of), "the work grows with the texts"


def test_mismatched_reviews_are_purged(spark):
    reviews = spark.createDataFrame([(1, 1, "Alpha"), (2, 1, "beta"), (3, 1, "ALPHA rent"), (4, 2, "gamma"), (5, 3, "x"), (6, 1, None), (7, None, "x"), (2, 1, "beta")], "review_id long, branch_id long, company_name string")
    names = spark.createDataFrame([(1, "Alpha Jeju"), (2, "The gamma shop"), (4, "x")], "branch_id long, branch_name string")
    assert rows(joins.purged(reviews, names).select("review_id")) == [(1,), (3,), (4,), (5,), (6,), (7,)]
    assert rows(joins.mismatched(reviews, names).select("review_id")) == [(2,), (2,)]


def test_totals_and_groups_from_one_shuffle(spark):
    data = [("e", "a", 1), ("e", "a", 2), ("e", None, 4), (None, "a", 8), ("w", "b", 16)]
    df = spark.createDataFrame(data, "region string, nation string, n long")
    got = aggregates.with_totals(df, ["region", "nation"], [F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")], prefixes=True)
    assert rows(got) == sorted([("e", "a", 3, 2, 0), ("e", None, 4, 1, 0), (None, "a", 8, 1, 0), ("w", "b", 16, 1, 0), ("e", None, 7, 3, 1), (None, None, 8, 1, 1), ("w", None, 16, 1, 1), (None, None, 31, 5, 2)], key=repr)
    page = aggregates.page_with_totals(df, ["region"], [F.sum("n").alias("n")], [F.desc("n"), F.asc("region")], 1, 1)
    assert rows(page) == [(None, 8, 3, 31)]
    assert rows(aggregates.page_with_totals(df.limit(0), ["region"], [F.sum("n").alias("n")], [F.desc("n")], 0, 5)) == []


def test_a_page_with_totals_scans_and_shuffles_once(spark, tmp_path):
    skewed(spark, 1000).write.parquet(str(tmp_path / "t"))
    page = aggregates.page_with_totals(spark.read.parquet(str(tmp_path / "t")), ["k"], [F.count(F.lit(1)).alias("n")], [F.desc("n"), F.asc("k")], 0, 3)
    page.collect()
    final = plan(page).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("+- Exchange hashpartitioning") == 1 and "ReusedExchange" in final, final
    assert page.first()["groups"] == 335


SLOTS = ("1m", "3m", "all")


def replay(events):
    """Pending and current values by key, and the versions, event by event."""
    state, versions = {}, []
    for key, seq, action, slot, value in sorted((e for e in events if e[0] is not None and e[1] is not None), key=lambda e: (e[0], e[1])):
        s = state.setdefault(key, {"pending": {}, "current": {}, "seen": set(), "n": 0})
        touched = set(SLOTS) if action in ("approve", "reject") else {slot} & set(SLOTS) if action in ("set", "apply", "discard") else set()
        s["seen"] |= touched
        if action == "set" and touched:
            s["pending"][slot] = value
        elif action == "apply" and slot in s["pending"] and touched:
            s["current"][slot] = s["pending"].pop(slot)
        elif action == "discard":
            s["pending"].pop(slot, None)
        elif action == "approve":
            if s["pending"]:
                s["n"] += 1
                versions.append((key, seq, *[s["current"].get(x) for x in SLOTS], s["n"]))
                s["current"] |= {k: v for k, v in s["pending"].items() if v}
            s["pending"] = {}
        elif action == "reject":
            s["pending"] = {}
    final = [(k, x, s["current"].get(x), s["pending"].get(x), x in s["pending"]) for k, s in state.items() for x in s["seen"]]
    return sorted(final, key=repr), sorted(versions, key=repr)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_pending_values_by_chunks(spark, chunk):
    rng = random.Random(chunk)
    actions = ("set", "set", "set", "apply", "discard", "approve", "reject", "unknown", None)
    events = [(rng.randrange(4) if i % 50 else None, i if i % 33 else None, rng.choice(actions), rng.choice([*SLOTS, "other", None]), rng.choice(["", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame([(*e, "clash") for e in events], "key long, seq long, action string, slot string, value string, pending string").repartition(3)
    final, versions = replay(events)
    assert rows(history.state(df, "key", SLOTS, chunk)) == final
    got = rows(history.versions(df, "key", SLOTS, chunk))
    assert got == versions and len(got) > 5
    assert rows(history.state(df.limit(0), "key", SLOTS, chunk)) == [] == rows(history.versions(df.limit(0), "key", SLOTS, chunk))


def test_windows_of_each_branch(spark):
    rng = random.Random(9)
    day = dt.date(2026, 1, 31)
    data = [(b, dt.datetime.combine(day - dt.timedelta(days=rng.randrange(800 if b else 20)), dt.time(rng.randrange(24))), rng.choice(["positive", "negative", None])) for b in range(4) for _ in range(60)]
    data += [(9, dt.datetime(2024, 2, 29, 12), "positive"), (8, None, "positive"), (None, dt.datetime(2026, 1, 1), "positive")]
    df = spark.createDataFrame(data, "branch long, at timestamp_ntz, sentiment string")
    months = {"1m": 1, "3m": 3, "12m": 12}
    for bucket in (1, 32, 1000):
        spans = reports.windows(df, "branch", "at", months)
        got = reports.window_trend(df, spans, "branch", "at", F.col("sentiment") == "positive", bucket).collect()
        assert len(got) == 3 * 6
        for r in (r for r in got if r.branch is not None):
            mine = [(t.date(), s) for b, t, s in data if b == r.branch and t is not None]
            assert r.end == max(t for t, _ in mine) + dt.timedelta(days=1) and (r.start - r.before) == (r.end - r.start)
            inside = [s for t, s in mine if r.start <= t < r.end]
            ahead = [s for t, s in mine if r.before <= t < r.start]
            assert (r.review_count, r.positive_count, r.before_count, r.before_positive) == (len(inside), inside.count("positive"), len(ahead), ahead.count("positive"))
            assert (r.change is None) == (not ahead) and (r.direction is None) == (not ahead) and (r.before_ratio is None) == (not ahead)
        assert "NestedLoop" not in plan(reports.window_trend(df, spans, "branch", "at", F.col("sentiment") == "positive", bucket))
    leap = next(r for r in got if r.branch == 9 and r.label == "12m")
    assert (leap.start, leap.end) == (dt.date(2023, 3, 1), dt.date(2024, 3, 1)) and leap.before_count == 0 and leap.ratio == 100
    best = {r.branch: r.recommended for r in reports.recommended_window(spark.createDataFrame(got), "branch", months).collect()}
    assert best[0] == "1m" and best[9] == "all"
