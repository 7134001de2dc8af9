"""Substring and suffix-array dedup against brute force."""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import arrays, repeats, substring_dedup, suffix_dedup

from .fixtures import table, texts

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words_left(rows: list[tuple[int | None, str | None]], n: int) -> list[tuple]:
    key = lambda i: -(2**63) if i is None else i
    split = [SPACE.findall((t or "").encode()) for _, t in rows]
    least: dict[tuple, int] = {}
    for (i, _), words in zip(rows, split, strict=True):
        for a in range(len(words) - n + 1):
            w = tuple(words[a : a + n])
            least[w] = min(least.get(w, 2**63), key(i))
    out = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = set()
        for a in range(len(words) - n + 1):
            if least[tuple(words[a : a + n])] < key(i):
                gone |= set(range(a, a + n))
        out.append((i, len(words), len(gone), " ".join(w.decode() for j, w in enumerate(words) if j not in gone)))
    return out


def bytes_left(rows: list[tuple[int | None, str | None]], n: int) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[a : a + n] for d in data for a in range(len(d) - n + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, dtype=bool)
        for a in range(len(d) - n + 1):
            if seen[d[a : a + n]] > 1:
                gone[a : a + n] = True
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(d) else 0
        out.append((i, len(d), int(gone.sum()), runs, bytes(b for b, g in zip(d, gone, strict=False) if not g)))
    return out


def same(got, want) -> None:  # noqa: ANN001
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("n", [5, 13])
def test_words(spark, n):
    rows = list(zip([7 * i % 1009 for i in range(500)], texts(), strict=False))
    got = substring_dedup.remove_repeats(table(spark, [t for _, t in rows]), n=n).collect() if n == 13 else None
    if got is None:
        rule = repeats.Rule(words=True, n=5, m=2, earlier=True)
        masked = repeats.repeated_windows(table(spark, [t for _, t in rows]), rule, substring_dedup._kernel(5)).mapInArrow(substring_dedup._clean(5), "doc_id long, n_words long, n_removed long, kept string")
        got = masked.collect()
    same(got, words_left(rows, n))


def test_words_ties_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long), (5, long), (None, long + " tail"), (3, None), (3, ""), (9, "new " + long)]
    same(substring_dedup.remove_repeats(table(spark, [t for _, t in rows], [i for i, _ in rows]), n=13).collect(), words_left(rows, 13))


def test_automaton_shards_are_streamed_through_each(monkeypatch, spark):
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", 40)
    words = [b"a b c d e f g h", b"c d e f g h i j", b"x c d e f g y"]
    got = substring_dedup._kernel(4)(np.zeros(3, np.int64), words, np.array([1, 2, 3]), np.ones(3, np.int64))
    assert [g.tolist() for g in got] == [[1] * 5, [1, 1, 1, 2, 2], [3, 1, 1, 3]]


def test_known_reference_is_broadcast(monkeypatch, spark):
    monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", 60)
    rows, known = texts(), [t for t in texts()[60:90]]
    windows = {tuple(w[a : a + 13]) for t in known for w in [SPACE.findall((t or "").encode())] for a in range(len(w) - 12)}
    got = {r.doc_id: r for r in substring_dedup.remove_known(table(spark, rows), table(spark, known)).collect()}
    for i, text in enumerate(rows):
        words = SPACE.findall((text or "").encode())
        gone = {b for a in range(len(words) - 12) if tuple(words[a : a + 13]) in windows for b in range(a, a + 13)}
        assert (got[7 * i].n_removed, got[7 * i].kept) == (len(gone), b" ".join(w for b, w in enumerate(words) if b not in gone).decode())
    with pytest.raises(ValueError, match="bytes"):
        substring_dedup.remove_known(table(spark, rows), table(spark, known), most_bytes=10)


def test_nothing_but_the_kernel_removes(spark):
    """With kernels that know nothing, no word and no byte goes."""
    docs = table(spark, texts())
    nobody = lambda n, value: lambda anchors, contents, ids, times: [np.full(len(c) + 1, value) for c in contents]  # noqa: ARG005, E731
    for rule, value in ((repeats.Rule(words=True, n=13, m=5, earlier=True), substring_dedup.NOBODY), (repeats.Rule(words=False, n=60, m=20, earlier=False), 1)):
        assert repeats.repeated_windows(docs, rule, nobody(rule.n, value)).filter("spans is not null").count() == 0


def test_split_anchors(monkeypatch, spark):
    """A passage that many texts have between words of their own: its anchors are split, and nothing changes."""
    monkeypatch.setattr(repeats, "HOT", 3)
    split, having = [], repeats._having
    monkeypatch.setattr(repeats, "_having", lambda known: (split.append(len(known)), having(known))[1])
    rows = [(i, f"own{i} w{i} {' '.join(f'p{x}' for x in range(40))} tail{i} v{i % 3} z z z z z z z z z z z z") for i in range(40)] + list(zip([7 * i % 1009 + 50 for i in range(500)], texts(), strict=False))
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    same(substring_dedup.remove_repeats(docs).collect(), words_left(rows, 13))
    got = suffix_dedup.remove_long_repeats(docs, n=60, m=20).collect()
    same([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], bytes_left(rows, 60))
    assert len(split) == 2 and min(split) > 3


def test_texts_are_dealt_once(spark):
    """The exchange of the texts serves both joins."""
    out = repeats.repeated_windows(table(spark, texts()), repeats.Rule(words=True, n=13, m=5, earlier=True), substring_dedup._kernel(13))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_many_shards_and_texts_without_ids(spark):
    """Work follows the shards that are there, and texts of one id, or of none, are told apart."""
    rows = [(None, t) for t in texts()] + [(4, t) for t in texts(2)]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    rule = repeats.Rule(words=True, n=13, m=5, earlier=True)
    run = repeats.anchors_out(rule, 10**6)
    batch = pa.RecordBatch.from_pydict({"text": [t or "" for _, t in rows], "j": list(range(len(rows)))})
    began = time.perf_counter()
    assert sum(b.num_rows for b in run(iter([batch]))) > 1000
    assert time.perf_counter() - began < 10
    same(substring_dedup.remove_repeats(docs).collect(), words_left(rows, 13))
    got = suffix_dedup.remove_long_repeats(docs, n=60, m=20).collect()
    same([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], bytes_left(rows, 60))


def test_very_long_text(spark):
    """Over a million code points, so that chunks of hashes are joined, with a passage of a short text far inside."""
    rng = np.random.Generator(np.random.PCG64(2))
    words = [f"w{x}" for x in rng.integers(0, 10**9, 150_000)]
    rows = [(1, " ".join(words[70_000:70_040])), (2, " ".join(words)), (3, " ".join(words[149_000:]))]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, [t for _, t in rows], [1, 2, 3])).collect()}
    assert [(got[i].n_words, got[i].n_removed) for i in (1, 2, 3)] == [(40, 0), (150_000, 40), (1000, 1000)]
    found = {r.doc_id: r for r in suffix_dedup.remove_long_repeats(table(spark, [t for _, t in rows], [1, 2, 3])).collect()}
    assert [(found[i].n_spans, found[i].n_removed) for i in (1, 2, 3)] == [(1, len(rows[0][1])), (2, len(rows[0][1]) + len(rows[2][1])), (1, len(rows[2][1]))]


def test_bytes(spark):
    rows = list(zip([7 * i % 1009 for i in range(500)], texts(), strict=False))
    got = suffix_dedup.remove_long_repeats(table(spark, [t for _, t in rows]), n=60, m=20).collect()
    same([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], bytes_left(rows, 60))


def test_bytes_ties_and_nulls(spark):
    rows = [(5, "é" * 130), (5, "é" * 130), (None, "z" * 450), (2, None), (2, ""), (4, "abc" * 100)]
    got = suffix_dedup.remove_long_repeats(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    same([(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got], bytes_left(rows, 200))


@pytest.mark.parametrize("run", [substring_dedup.remove_repeats, suffix_dedup.remove_long_repeats])
def test_empty_table(spark, run):
    assert run(table(spark, ["a"]).limit(0)).count() == 0


def test_run_length_index_against_brute_force():
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(40):
        contents = list({bytes(rng.integers(97, 100, rng.integers(1, 40)).tolist()) for _ in range(rng.integers(1, 6))})
        times = rng.integers(1, 4, len(contents))
        every = [c for c, t in zip(contents, times, strict=True) for _ in range(t)]
        count = lambda p: sum(c[i : i + len(p)] == p for c in every for i in range(len(c) - len(p) + 1))  # noqa: B023, E731
        index = suffix_dedup.RunLengthIndex.build(contents, times)
        for length in (1, 3, 8):
            patterns = [bytes(rng.integers(97, 101, length).tolist()) for _ in range(15)]
            assert index.occurrences(patterns).tolist() == [count(p) for p in patterns]
        for n in (2, 5, 9):
            got = suffix_dedup._indexed(contents, times, n)
            assert [g.tolist() for g in got] == [[min(2, count(c[a : a + n])) for a in range(len(c) - n + 1)] for c in contents]


def test_equal_windows_have_equal_anchors():
    rng = np.random.Generator(np.random.PCG64(9))
    units = rng.integers(0, 4, 400).astype(np.uint64)
    grams, first, last = arrays.segments(units, 12, 4)
    anchor: dict[bytes, int] = {}
    for g, a, b in zip(grams.tolist(), first.tolist(), last.tolist(), strict=True):
        for w in range(a, b + 1):
            assert anchor.setdefault(units[w : w + 12].tobytes(), g) == g
    assert int((last - first + 1).sum()) == 400 - 12 + 1
