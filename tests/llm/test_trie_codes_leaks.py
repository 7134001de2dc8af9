"""Prefix tries, vector codes and decontamination against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidewater.llm import decontam, prefix_trie, queries, vector_codes

from .fixtures import CLASHES, prose, table, texts

CLASH = ", ".join(f"{c} string" for c in (*CLASHES, "seq", "sizes", "base", "range", "slot", "label2", "whole", "codes"))
CLASHED = tuple("clash" for _ in CLASH.split(", "))


def run_sql(sql, **tables):
    c = duckdb.connect()
    for name, path in tables.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return sorted((tuple(x[names.index(n)] for n in sorted(names)) for x in r.fetchall()), key=repr)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


# Conversations


def conversations(seed=1, count=60):
    rng = random.Random(seed)
    lines = [prose(rng, rng.randint(0, 6)) for _ in range(5)]
    out = []
    for c in [*range(count), 700, 701, 1003]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 12])):
            out.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(lines)))
    out += [(5, None, None, None), (5, None, "user", "first"), (6, 0, "user", "tie b"), (6, 0, "user", "tie a"), (6, 0, "user", "tie a"), (7, 0, None, ""), (None, 0, "user", "no id")]
    out += [(2000 + 5 * i, t, "user", f"hot {t}") for i in range(40) for t in range(3)]
    out += [(4000, t, "user", "é" * 7) for t in range(700)] + [(4001, t, "user", "é" * 7) for t in range(699)]
    rng.shuffle(out)
    return out


def trie(turns):
    own = {}
    for c, turn, role, text in sorted((t for t in turns if t[0] is not None), key=lambda t: (t[0], t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, m in members.items():
        cost = (len(m) - 1) * len(path[-1][1].encode()) if path else 0
        for e in range(len(path) + 1):
            saved[path[:e]] = saved.get(path[:e], 0) + cost
            leaves[path[:e]] = leaves.get(path[:e], 0) + (path not in children)
    return sorted(
        (min(m), len(p), hashlib.sha256(",".join(map(str, sorted(c for c in m if built[c] == p))).encode()).hexdigest(), children.get(p, 0), len(m), leaves[p], min(members[p[:-1]]) if p else None, saved[p]) for p, m in members.items()
    )


def turns_table(spark, turns):
    return spark.createDataFrame([(*t, *CLASHED) for t in turns], f"conv_id long, turn long, role string, text string, {CLASH}")


def nodes(df):
    return sorted((r.conv_id, r.depth, r.ends, r.n_children, r.n_convs, r.n_leaves, r.parent_conv_id, r.saved_tokens) for r in df.collect())


def test_nodes_of_conversations(spark):
    turns = conversations()
    seqs = prefix_trie.sequences(turns_table(spark, turns).repartition(4))
    want = trie(turns)
    key = lambda x: tuple((v is not None, v) for v in x)
    for options in ({}, {"range_bytes": 2000, "run_items": 3}, {"range_bytes": 1 << 30, "run_items": 7}):
        assert sorted(nodes(prefix_trie.nodes(seqs, **options)), key=key) == sorted(want, key=key)


def test_copies_that_many_ranges_share(spark):
    turns = [(c, t, "user", "x" * (t + 1)) for c in range(0, 3000, 5) for t in range(2)] + [(c + 1, 0, "user", "x") for c in range(0, 500, 5)]
    seqs = prefix_trie.sequences(turns_table(spark, turns))
    got = prefix_trie.nodes(seqs, range_bytes=1500, run_items=16)
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(nodes(got), key=key) == sorted(trie(turns), key=key)


def test_trie_sql_and_empty_table(spark, tmp_path):
    turns = [t for t in conversations(2, 40) if t[0] is None or t[0] < 4000]
    turns_table(spark, turns).select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows(queries.op11_prefix_trie(spark, str(tmp_path))) == run_sql(prefix_trie.ORACLE, conversations=tmp_path / "conversations.parquet")
    assert prefix_trie.nodes(prefix_trie.sequences(turns_table(spark, turns).limit(0))).collect() == []
    assert nodes(prefix_trie.nodes(prefix_trie.sequences(turns_table(spark, [(1, 0, "a", "")])))) == trie([(1, 0, "a", "")])


def test_merge_compares_only_behind_known_prefixes():
    rng = random.Random(4)
    turn = lambda k: hashlib.md5(bytes([k])).digest()
    items = [(b"".join(turn(0) for _ in range(200)) + b"".join(turn(rng.randrange(3)) for _ in range(rng.randint(0, 6))), i, b"") for i in range(256)]
    rng.shuffle(items)
    for size in (1, 16, 100, 300):
        merge = prefix_trie.Merge([prefix_trie.Run(items[i : i + size]) for i in range(0, len(items), size)])
        got = list(merge)
        assert [x for x, _ in got] == sorted(items)
        assert [n for _, n in got][1:] == [prefix_trie.common(a[0][0], b[0][0]) for a, b in zip(got, got[1:], strict=False)]
    merge = prefix_trie.Merge([prefix_trie.Run(items[i : i + 16]) for i in range(0, len(items), 16)])
    list(merge)
    assert merge.compared < 16 * 200 + 8 * 256, "plain merging would compare the 200 shared turns about four times for each of 256"
    assert list(prefix_trie.Merge([])) == []


# Vector codes


def codes(vectors, entries=256, rounds=4):
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, _, v in order[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda k: (far(part(v, p), books[p][k]), k))
    for _ in range(rounds):
        for p in range(4):
            own = {}
            for _, _, v in kept:
                own.setdefault(near(v, p), []).append(part(v, p))
            for k, mine in own.items():
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    coded = [(i, label, [near(v, p) for p in range(4)]) for i, label, v in kept]
    errors = [sum(far(part(v, p), books[p][c[p]]) for p in range(4)) for (_, _, v), (_, _, c) in zip(kept, coded, strict=True)]
    return sorted(((i, label, c, e) for (i, label, c), e in zip(coded, errors, strict=True)), key=repr), books


def vectors(seed=1, count=150, dim=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(9)]
    out = [(i * 3, rng.choice([None, 0, 1]), [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(count)]
    hot = out[40][2]
    out += [(1000 + i, 2, hot) for i in range(count // 2)]
    out += [(5, 0, None), (8, 1, [math.nan] * dim), (11, 1, [math.inf] + [0.0] * (dim - 1)), (14, None, [None] + [0.0] * (dim - 1)), (None, 0, [0.25] * dim), (0, 1, [0.5] * dim), (0, 1, [0.5] * dim)]
    rng.shuffle(out)
    return out


def vector_table(spark, data, kind="float"):
    return spark.createDataFrame([(*v, *CLASHED) for v in data], f"vec_id long, label int, embedding array<{kind}>, {CLASH}").repartition(3)


def coded(df):
    return sorted(((r.vec_id, r.label, list(r.codes), r.error) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("entries", "groups"), [(256, 16), (20, 5), (20, 1), (4, 16)])
def test_codes_and_codebooks(spark, entries, groups):
    data = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in vectors(entries)]
    got, books = vector_codes.encode(vector_table(spark, data), entries=entries, groups=groups)
    want, plain = codes(data, entries)
    assert coded(got) == want
    assert [b.tolist() for b in books] == plain


def test_large_components_ties_and_odd_shapes(spark):
    rng = random.Random(8)
    wide = [(i, 0, [rng.choice([-60000.0, 60000.0, 0.5]) for _ in range(8)]) for i in range(60)]
    got, books = vector_codes.encode(vector_table(spark, wide, "double"), entries=16)
    want, plain = codes(wide, 16)
    assert coded(got) == want and [b.tolist() for b in books] == plain
    same = [(i, None, [0.0, 1.0, 0.0, 1.0]) for i in range(30)]
    got, books = vector_codes.encode(vector_table(spark, same), entries=8)
    assert coded(got) == [(i, None, [0, 0, 0, 0], 0) for i in sorted(range(30), key=repr)] or {tuple(r.codes) for r in got.collect()} == {(0, 0, 0, 0)}
    mixed = [*same, (90, 1, [1.0]), (91, 1, [1e30, 0.0, 0.0, 0.0]), (92, 1, [])]
    assert got.count() == vector_codes.encode(vector_table(spark, mixed), entries=8)[0].count() == 30
    uneven = vector_codes.encode(vector_table(spark, [(i, None, [0.1 * i] * 5) for i in range(9)]), entries=4)
    assert uneven[0].count() == 9 and [b.shape for b in uneven[1]] == [(4, 2)] * 4
    empty = vector_codes.encode(vector_table(spark, [(1, 1, None)]))
    assert empty[0].collect() == [] and vector_codes.listed(empty[1]) == ""


def test_bounds_skip_groups_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-800, 800, (32, 4))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-20, 20, (4000, 4))
    entries = x[:32].copy()
    groups = vector_codes.groups_of(entries, 8)
    book = vector_codes.Codebook(entries, groups, np.zeros(groups.max() + 1, dtype=np.int64))
    code, error, bounds = book.first(x)
    scanned = []
    for _ in range(5):
        means = book.entries.copy()
        for k in np.unique(code):
            means[k] = x[code == k].sum(axis=0) // (code == k).sum()
        book = book.moved(means)
        code, error, bounds, n = book.next(x, code, bounds)
        exact = vector_codes.distances(x, book.entries)
        assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
        far = np.stack([np.where(np.arange(32)[None, :] == code[:, None], np.iinfo(np.int64).max, exact)[:, m].min(axis=1) for m in book.members], axis=1)
        assert (bounds.astype(np.int64) ** 2 <= far).all()
        scanned.append(n / (len(x) * len(book.drift)))
    assert scanned[-1] < 0.5, scanned


def test_codes_sql(spark, tmp_path):
    data = [v for v in vectors(5, 700) if v[0] is not None and v[0] >= 1]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert rows(queries.op12_vector_codes(spark, str(tmp_path))) == run_sql(vector_codes.ORACLE, embeddings=tmp_path / "embeddings.parquet")


# Decontamination


def leaks(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for item, text in items:
        w = words(text)
        for p in [w[i : i + n] for i in range(max(1, len(w) - n + 1))] if w else []:
            patterns.setdefault(tuple(p), set()).add(item or "")
    out = []
    for text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in patterns:
                    hit |= set(range(i, i + m))
                    found |= patterns[tuple(w[i : i + m])]
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def bench():
    rng = random.Random(7)
    items = [(str(i), prose(rng, rng.choice([3, 9, 10, 11, 30]))) for i in range(40)]
    items += [("short", "One"), ("two", "x, Y"), ("none", " .,! "), ("null", None), (None, prose(rng, 15)), ("twin", items[0][1]), ("twin", items[1][1]), ("rep", "a b " * 12), ("long", prose(rng, 9000))]
    docs = texts(3)
    for item, text in items:
        if text:
            docs += [f"{prose(rng, 5)} {text.upper()} {prose(rng, 4)}", f"{text}{text}", " ".join(text.split()[:10]), ", ".join(text.split()[1:])]
    docs += ["a b " * 40, "b " + "a b " * 5, "x!!y\nx-y", prose(rng, 200_000), "é" * 10 + " É"]
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 20_000])
def test_benchmark_passages(spark, block):
    docs, items = bench()
    items_df = spark.createDataFrame([(*i, *CLASHED) for i in items], f"item_id string, text string, {CLASH}")
    got = decontam.contaminated(table(spark, docs, list(range(len(docs)))), items_df, block_bytes=block).collect()
    want = leaks(docs, items)
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, [k for s in r.spans for k in range(s["first"], s["last"] + 1)], list(r.items)) == (n, hit, found)
        assert all(b["first"] > a["last"] + 1 for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_blocks_hold_no_more_than_their_bytes(spark):
    _, items = bench()
    df = spark.createDataFrame(items, "item_id string, text string")
    size = lambda b: sum(len(i) + len(p) for i, p in b)
    got = list(decontam.blocks(df, 10, 4000))
    assert len(got) > 3 and all(size(b) <= 4000 or len(b) == 1 for b in got)
    assert len(list(decontam.blocks(df, 10, 8 << 20))) == 1


def test_rows_of_one_id_and_empty_tables(spark):
    docs = table(spark, ["a b c", "a b c", None, "c b a", ""], [1, 1, 1, 1, None])
    items = spark.createDataFrame([("i", "a b"), ("j", "b a")], "item_id string, text string")
    for block in (8 << 20, 4):
        got = sorted((r.doc_id or 0, r.n_words, len(r.spans), tuple(r.items)) for r in decontam.contaminated(docs, items, block_bytes=block).collect())
        assert got == [(0, 0, 0, ()), (1, 0, 0, ()), (1, 3, 1, ("i",)), (1, 3, 1, ("i",)), (1, 3, 1, ("j",))]
    assert decontam.contaminated(docs.limit(0), items).collect() == []
    assert all(not r["items"] for r in decontam.contaminated(docs, items.limit(0)).collect())


def test_search_skips_places():
    rng = random.Random(2)
    words = [w.encode() for w in prose(rng, 20_000).split()]
    patterns = [(tuple(f"z{i}{j}".encode() for j in range(10)), [i]) for i in range(50)]
    s = decontam.Searcher(patterns, 10)
    words[5000:5010] = patterns[7][0]
    looked = []
    s.shift = type("Counting", (dict,), {"get": lambda self, k, d: looked.append(k) or dict.get(self, k, d)})(s.shift)
    assert list(s.search(words)) == [(5010, [7])]
    assert len(looked) < len(words) / 8


def test_decontamination_sql(spark, tmp_path):
    docs, items = bench()
    docs = [d for d in docs if d is None or len(d) < 20_000]
    table(spark, docs, list(range(len(docs)))).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([i for i in items if i[0] != "long"], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert rows(queries.op13_decontamination(spark, str(tmp_path))) == run_sql(decontam.ORACLE, documents=tmp_path / "documents.parquet", benchmark=tmp_path / "benchmark.parquet")
