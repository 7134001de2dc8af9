"""Similarity joins and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tidewater.llm import components, jaccard_join, spotsigs

from .fixtures import WORDS, prose, table, texts


def shingles(text: str | None) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows: list[tuple[int, str | None]]) -> set[tuple]:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return {(d, len(s), least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def near_group(rng: random.Random, copies: int, words: int, with_base: bool) -> list[str]:
    base = prose(rng, words).split()
    out = [" ".join(base)] if with_base else []
    for i in range(copies):
        mine = list(base)
        for _ in range(rng.randint(1, 5)):
            mine[rng.randrange(words)] = f"own{i}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize(("many", "with_base"), [(24, True), (4, True), (4, False), (3, False)])
def test_components(spark, many, with_base):
    rng = random.Random(4)
    rows = texts() + near_group(rng, 50, 120, with_base) + near_group(rng, 30, 40, with_base)
    rows = [(13 * i % 997, t) for i, t in enumerate(rows)]
    got = jaccard_join.classes(table(spark, [t for _, t in rows], [i for i, _ in rows]), many=many).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows)


def test_limits_of_likeness(spark):
    """Sets of 8 of 10 and of 79 of 100 in common."""
    a = [f"a{i}" for i in range(104)]
    rows = [(1, " ".join(a[:14])), (2, " ".join(a[1:15])), (3, " ".join(["q", *a[20:120]])), (4, " ".join(a[20:100]))]
    assert {tuple(r) for r in jaccard_join.classes(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()} == brute(rows)


def test_null_and_repeated_ids(spark):
    rows = table(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "", "  "], [None, 4, 4, 5, None, 6])
    got = sorted((r.n_shingles, r.doc_id or -1, r.component_id or -1) for r in jaccard_join.classes(rows).collect())
    assert got == [(0, -1, -1), (0, 5, 5), (0, 6, 6), (2, -1, -1), (2, 4, -1), (2, 4, -1)]
    assert jaccard_join.classes(rows.limit(0)).count() == 0


def test_parity_marks_bound_the_difference():
    rng = np.random.Generator(np.random.PCG64(2))
    sets = [np.unique(rng.integers(0, 2**63, int(n), dtype=np.uint64)) for n in (20, 200, 900, 3000, 6000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, 30, dtype=np.uint64)])) for s in sets]
    marks = jaccard_join._Marks([jaccard_join.parity_mark(s) for s in sets])
    for i, a in enumerate(sets):
        got = marks.apart(i, np.arange(len(sets)))
        assert all(g <= len(np.setxor1d(a, b)) for g, b in zip(got.tolist(), sets, strict=True))
    assert marks.apart(1, np.array([2]))[0] > 300


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_edited_and_next(spark):
    rng = random.Random(8)
    rows = texts(3, 30)
    ids = [11 * i % 499 for i in range(len(rows))]
    got = {r.doc_id: r for r in spotsigs.edited_and_next(table(spark, rows, ids), bytes_per_part=2000).collect()}
    assert len(got) == len(rows)
    order = sorted(zip(ids, rows, strict=True), reverse=True)
    for (doc_id, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sets = [set(spotsigs.signatures(t).tolist()) for t in (text, edited, after)]
        want = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert [r.near_edited, r.near_next] == pytest.approx(want)
        assert r.fingerprint == spotsigs._coded(spotsigs.signatures(text))
    assert rng and spotsigs.edited_and_next(table(spark, rows, ids).limit(0)).count() == 0


def test_signatures():
    assert len(spotsigs.signatures(None)) == len(spotsigs.signatures("")) == 0
    assert len(spotsigs.signatures("!!")) == 1
    a, b = (spotsigs.signatures(f"the quick brown fox is {x} and the lazy dog of {' '.join(WORDS[:9])}") for x in ("here", "there"))
    assert 0 < spotsigs.likeness(a, b) < 1
    assert spotsigs.likeness(a, b[:1], least=0.9) == 0.0


def test_signature_classes(spark):
    text = "the sea is calm and a boat was at the pier with no crew for days " * 3
    got = {r.doc_id: r.component_id for r in spotsigs.classes(table(spark, [text, text + "indeed", "a wholly other text that is in the box by the door"], [3, 9, 1])).collect()}
    assert got == {3: 3, 9: 3, 1: 1}
