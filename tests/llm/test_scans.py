"""Secret, license and URL scans."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np

from tidewater.llm import license_scan, queries, secret_scan, url_filter
from tidewater.llm.license_texts import NOTICES

from .fixtures import prose, table, texts

BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
KEY = "AKIA" + "ABCDEFGH12345678"
SECRETS = [
    "password: hunter22 and TOKEN='abcdef' secret=short passwd = \"long-enough\"",
    f"é {KEY} é api_key={'0af' * 12} apikey : x",
    f"{'ab12' * 6} {'ab12' * 5} token=token=secret123 {KEY}Z akia{KEY}",
    "secret: password: abcdefg", "password=abc password=abcdef", "pässword secret\t=abcdef",
    "user=alice pwd=Tr0ub4dor https://example.org/login",
    "user=alice " + "x " * 400 + "pwd=Tr0ub4dor", "see https://example.org/login for it", "pwd=Tr0ub4dor alone",
]


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    return sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m))


def test_secret_base_spans(spark, tmp_path):
    rows = SECRETS + texts() + [" ".join(SECRETS * 40)] + SECRETS[:3]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_secret_links(spark, str(tmp_path)).collect()
    want = []
    for i, text in enumerate(rows):
        spans = base_spans(text)
        listed = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        want.append((7 * i % 1009, *[sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert all(set(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base_spans(rows[next(i for i in range(len(rows)) if 7 * i % 1009 == r.doc_id)])) <= set(r.spans.split(",")) | {""} for r in got)


def test_weak_parts_need_their_complement(spark):
    got = {r.doc_id: r.spans for r in secret_scan.scan(table(spark, SECRETS[6:], [1, 2, 3, 4])).select("doc_id", secret_scan.listed(secret_scan.F.col("all")).alias("spans")).collect()}
    assert got == {1: "id:0:10,weak:11:24,endpoint:25:50", 2: "", 3: "", 4: ""}


def test_redact_masks_every_span(spark):
    docs = table(spark, [*SECRETS, None, "", "clean", SECRETS[0]], [*range(len(SECRETS)), 50, 51, 52, 0])
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len(SECRETS) + 4
    for r in rows:
        assert not base_spans(r.text)
        assert r.n_chars == len(r.text or "")
    assert {r.text for r in rows if r.doc_id in (50, 51, 52)} == {None, "", "clean"}
    assert [r.text for r in rows if r.doc_id == 8] == [SECRETS[8]]
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_licenses_are_found_and_prose_is_not(spark):
    rng = random.Random(2)
    rows = [f"{prose(rng, 30)}\n{text.upper()}\n{prose(rng, 30)}" for _, text in NOTICES] + texts()
    got = {r.doc_id: {m.license for m in r.matches} for r in license_scan.scan(table(spark, rows)).collect()}
    index = license_scan.Templates.build(NOTICES)
    for i, text in enumerate(rows):
        parts = license_scan.shingles(text)
        contained = {n for n, s in zip(index.names, index.sets, strict=True) if np.isin(s, parts).mean() >= license_scan.CONTAINED}
        # Containment in the whole text includes that of any stretch
        assert got[7 * i % 1009] <= contained
        if i < len(NOTICES):
            assert NOTICES[i][0] in got[7 * i % 1009]
        else:
            assert not got[7 * i % 1009]
    assert license_scan.scan(table(spark, rows).limit(0)).count() == 0


def test_adjacent_license_copies_are_each_found():
    index = license_scan.Templates.build(NOTICES)
    rng = random.Random(4)
    for name, text in NOTICES:
        n = len(license_scan.shingles(text)) + license_scan.SHINGLE - 1
        for copies in (1, 2, 3):
            for between in ("\n", f"\n{prose(rng, 3)}\n"):
                gap = len(between.split())
                got = [m[1:] for m in license_scan.matches(f"{prose(rng, 20)}\n{between.join([text] * copies)}\n{prose(rng, 9)}", index) if m[0] == name and m[2] - m[1] == n]
                assert got == [(20 + i * (n + gap), 20 + i * (n + gap) + n, 1.0) for i in range(copies)], (name, copies)


def test_edited_adjacent_copies_and_moved_parts():
    index = license_scan.Templates.build(NOTICES)
    name, text = max(NOTICES, key=lambda x: len(license_scan.shingles(x[1])))
    words = text.split()
    edited = " ".join([*words[: len(words) // 2], "changed", *words[len(words) // 2 + 1 :]])
    both = [m for m in license_scan.matches(f"{edited} {text} {edited}", index) if m[0] == name]
    assert len(both) == 3
    assert both[1][3] == 1.0
    assert all(a[2] <= b[1] for a, b in zip(both, both[1:], strict=False))
    moved = [m for m in license_scan.matches(" ".join([*words[-len(words) // 8 :], *words[: -len(words) // 8]]), index) if m[0] == name]
    assert len(moved) == 1
    assert moved[0][3] > 1 - 5 / len(index.sets[index.names.index(name)])


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/7x?q#f", "https://a.b.example.com/en/8", "http://shop.net/de/1", "x://example.net/de/8/9", "http://wexample.org/es/2", "http://org.example/es/", None, "", "no scheme", "http://host?x=/en/", "://h/p"]
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    assert got[0] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("a.b.example.com", "/en/8", "com/en/", "block")
    assert got[2] == ("shop.net", "/de/1", "net/de/", "block")
    assert got[3] == ("example.net", "/de/8/9", "example.net/de/8", "allow")
    assert got[4][2:] == ("org/es/", "block")
    assert got[5][2] is None
    assert [got[i] for i in (6, 7, 8)] == [("", "", None, "allow")] * 3
    assert got[9][:2] == ("host", "")
    assert got[10][:2] == ("h", "/p")
    assert url_filter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_models_tell_held_out_urls_apart(spark):
    rng = random.Random(6)
    good, bad = [prose(rng, 1)[:4] for _ in range(30)], ["".join(rng.choice("xqzvwj019") for _ in range(6)) for _ in range(30)]
    rows = []
    for i in range(900):
        kind = i % 3
        rows.append((i, f"http://{'h.com/ok/' if kind == 0 else 'h.net/no/' if kind == 1 else 'h.info/'}{'/'.join(rng.choice(good if (kind == 0 or kind == 2 and i % 2) else bad) for _ in range(5))}"))
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/ok/"), ("block", "net/no/")]).filter("rule is null").collect()
    right = sum((r.verdict == "allow") == (r.page_id % 2 == 1) for r in got)
    assert len(got) == 300
    assert right >= 285


def test_url_model_counts_are_exact(spark):
    rng = random.Random(9)
    urls = [("".join(chr(rng.randrange(33, 1500)) for _ in range(40)), i % 3 == 0) for i in range(6000)] + [("aaaa", False), ("aaab", True)] * 3
    want = [{}, {}]
    for text, blocked in urls:
        data = b"\x02" * 4 + text.encode() + b"\x03"
        for i in range(4, len(data)):
            for order in range(5):
                key = (order, data[i - order : i + 1])
                want[blocked][key] = want[blocked].get(key, 0) + 1
    model = url_filter.train(spark.createDataFrame(urls, "shown string, blocked boolean").repartition(3))
    got = [{}, {}]
    for r in model.collect():
        for side, n in enumerate((r.allow, r.block)):
            if n:
                got[side][(r.order, r.joint.to_bytes(r.order + 1, "big"))] = n
    assert got == want
    assert len({k for side in want for k in side}) > 1 << 19

    def log_ratio(text):
        data = b"\x02" * 4 + text.encode() + b"\x03"
        total = 0.0
        for i in range(4, len(data)):
            for side, sign in ((0, -1), (1, 1)):
                chance = 1 / 256
                for order in range(5):
                    context = data[i - order : i]
                    seen = sum(want[side].get((order, context + bytes([c])), 0) for c in range(256))
                    chance = (want[side].get((order, data[i - order : i + 1]), 0) + 2 * chance) / (seen + 2)
                total += sign * np.log(chance)
        return total / (len(data) - 4)

    asked = ["aaab", "aaaa", "zz/ü", urls[0][0], "", None, "aaab"]
    scored = url_filter.score(spark.createDataFrame(list(enumerate(asked)), "page_id long, shown string"), model).collect()
    assert sorted(r.page_id for r in scored) == list(range(7))
    for r in scored:
        assert abs(r.score - (log_ratio(asked[r.page_id]) if asked[r.page_id] else 0.0)) < 1e-9


def test_threshold_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(b, rng.gauss(0.3 if b else -0.2, 0.25)) for b in (rng.random() < 0.4 for _ in range(400))]
    cut = url_filter._threshold(spark.createDataFrame(rows, "blocked boolean, score double"))
    wrong = lambda c: sum(s > c for b, s in rows if not b) / sum(not b for b, _ in rows) + sum(s <= c for b, s in rows if b) / sum(b for b, _ in rows)
    assert wrong(cut) <= min(wrong(s) for _, s in rows) + 0.03
    same = [(i % 2 == 0, float(i // 2 % 50) / 50) for i in range(400)]
    assert url_filter._threshold(spark.createDataFrame(same, "blocked boolean, score double")) == float("inf")
    few = [(True, 1.0), (False, -1.0)]
    assert url_filter._threshold(spark.createDataFrame(few, "blocked boolean, score double")) == float("inf")
    assert url_filter._threshold(spark.createDataFrame([(True, 1.0)] * 9, "blocked boolean, score double")) == float("inf")


def test_labels_that_say_nothing_block_nothing(spark):
    rng = random.Random(22)
    rows = [(i, f"http://{('h.com/ok/', 'h.net/no/', 'h.info/')[i % 3]}{prose(rng, 3).replace(' ', '/')}") for i in range(300)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [("allow", "com/ok/"), ("block", "net/no/")]).collect()
    assert {r.verdict for r in got if r.rule is None} == {"allow"} and len(got) == 300
    assert {r.verdict for r in got if r.rule == "net/no/"} == {"block"}
