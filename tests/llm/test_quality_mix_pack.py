"""Quality rules, source mixing and packing."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm import arrays, mixing, packing, quality, queries

from .fixtures import prose, table, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def base_rules(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)


def test_quality_counts(spark):
    rows = [*texts(), "# a|b <c> $5 & 10% *\nsame line\nsame line\n\n\n same line", "é ü\u00a0ß " * 20]
    docs = table(spark, rows)
    got = quality.score(docs)
    assert set(docs.columns) - {"n_words", "kept"} <= set(got.columns)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = {r.doc_id: r for r in got.collect()}
    for i, text in enumerate(rows):
        r = found[7 * i % 1009]
        assert tuple(r[c] for c in names) == base_rules(text)
        assert not (r.base_failed and r.kept)
    assert quality.score(docs.limit(0)).count() == 0


def test_longest_repeats_against_brute_force():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 2, 30, 90):
        units = rng.integers(0, 4, n).astype(np.uint64)
        size = quality.longest_repeats(units)
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or units[i + k] != units[j + k]), n)  # noqa: B023, E731
        want = [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]
        assert size.tolist() == want
        a, b = quality.maximal_repeats(units, 3)
        mask = np.zeros(n, dtype=bool)
        for i, w in enumerate(want):
            if w >= 3:
                mask[i : i + w] = True
        assert np.array_equal(arrays.covered(a, b, n), mask)


def test_very_repetitive_text_in_bounded_memory():
    phrase = np.random.Generator(np.random.PCG64(6)).integers(1, 2**62, 500).astype(np.uint64)
    tracemalloc.start()
    size = quality.longest_repeats(np.tile(phrase, 400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size[:3].tolist() == [200_000 - 500, 200_000 - 501, 200_000 - 502]
    assert peak < 200_000 * 8 * 20  # arrays of the text's length, whatever it repeats


def test_quality_verdicts():
    rng = random.Random(3)
    unique = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    passage = unique(70)
    limits = quality.Limits()
    assert quality.measure(unique(200), limits)[-1]
    assert not quality.measure(f"{passage} {unique(500)} {passage}", limits)[-1]
    assert quality.measure(f"{passage} {unique(2000)} {passage}", limits)[-1]
    assert not quality.measure(None, limits)[-1]
    with pytest.raises(ValueError, match="repeat_words"):
        quality.Limits and quality.score(None, quality.Limits(repeat_words=2))


def test_repeats_reject_texts_that_pass_the_base_rules():
    rng = random.Random(8)
    unique = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    limits = quality.Limits()
    long, short = unique(480), unique(40)
    for text, kept in (
        (f"{long} {unique(4000)} {long}", False),  # 19.4% repeated
        (f"{unique(9)} {long} {unique(40000)} {long}", False),  # 2.3%: the passage alone is too long
        (f"{short} {unique(430)} {short}", False),  # 15.7% repeated, in short passages
        (f"{short} {unique(800)} {short}", True),
        (f"{unique(100)} {short} {unique(5000)} {short}", True),
        (" ".join(f"{unique(40)} it is as we have said" for _ in range(9)), True),  # phrases under 8 words
        (unique(500), True),
    ):
        *_, failed, got = quality.measure(text, limits)
        assert not failed
        assert got == kept


def test_mixing_matches_sql_and_targets(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice((0, 3, 10, 50, 400))) if i % 17 else None, rng.choice(["b", "a", None, "c c", "z"]) if i % 3 else "a") for i in range(400)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_source_mixing(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    source = {i: s for i, _, s in rows}
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
        assert r.taken <= 2 * r.size
        assert r.target <= 2 * r.source_size + 1e-6
    assert all(abs(taken[s] - target[s]) <= 2 * longest[s] for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    again = queries.op7_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(again) == sorted(got)
    copies = {r.doc_id: r.copies for r in got}
    mixed = Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    assert mixed == Counter({i: c for i, c in copies.items() if c})


def test_mixing_edges(spark):
    fields = "doc_id long, text string, source string"
    assert mixing.copies(spark.createDataFrame([], fields)).count() == 0
    got = mixing.copies(spark.createDataFrame([(1, None, None), (1, None, None), (2, "", "a")], fields)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
    one = mixing.copies(spark.createDataFrame([(None, "a b c", "s")], fields)).collect()
    assert (one[0].source_size, one[0].target) == (3, 4.5)


def test_packing_round_trip(spark):
    rows = [*texts(), "Don't <|endoftext|> STOP!! now...", prose(random.Random(1), 9000)]
    got = packing.pack(table(spark, rows), PATH).collect()
    plain = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, text in enumerate(rows):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        mine = sorted(pieces.pop(7 * i % 1009), key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [(p, a, min(2048, len(ids) - a)) for p, a in enumerate(range(0, len(ids), 2048))]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
    assert not pieces
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(table(spark, rows).limit(0), PATH).count() == 0


def test_tokenizers_that_depend_on_white_space_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = ["a b  c\nd", None, "İ. İ, ..? x\u0301 \u0301y. E\u0301! 한국. don't.", "Σς. ΑΣ! " * 3, prose(random.Random(2), 50)]
    for file in (path, PATH):
        plain = Tokenizer.from_file(file)
        got = {r.doc_id: r for r in packing.pack(table(spark, rows), file).collect()}
        for i, text in enumerate(rows):
            ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert (got[7 * i].length, got[7 * i].ids_crc32) == (len(ids), zlib.crc32(ids))
    assert [packing.Encoder(f).by_word for f in (path, PATH)] == [False, True]


def test_sum_of_squares_choice():
    rng = np.random.Generator(np.random.PCG64(4))
    sizes = rng.integers(1, 64, 300)
    number, offset = packing.sum_of_squares(sizes, 64)
    gaps: dict[int, int] = {}
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        counts = Counter(g for g in gaps.values() if g)
        fits = sorted({g for g in gaps.values() if g >= size})
        if fits:
            cost = lambda g: sum(c * c for x, c in (counts - Counter([g]) + Counter([g - size] if g > size else [])).items())  # noqa: B023, E731
            best = min(fits, key=lambda g: (cost(g), g))
            assert gaps[int(number[i])] == best
            assert offset[i] == 64 - best
        gaps[int(number[i])] = gaps.get(int(number[i]), 64) - size
        assert gaps[int(number[i])] >= 0
