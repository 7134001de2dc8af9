"""Rows that are hard on every operator, and methods against versions written anew."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tidewater.llm import jaccard_join, license_scan, queries, secret_scan, spotsigs
from tidewater.llm.license_texts import NOTICES

from .fixtures import WORDS, prose, table
from .test_scans import SECRETS


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Null ids, equal rows of one id, different texts of one id, null and empty texts, and one of 1.6 million characters."""
    rng = random.Random(11)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(3000)) for _ in range(210_000))
    assert len(long) > 1_600_000
    copy = prose(rng, 60)
    rows = [(None, copy), (None, "lone"), (None, None), (1, copy), (1, copy), (1, copy), (2, prose(rng, 50)), (2, prose(rng, 40)), (3, None), (4, ""), (5, long), (6, " \n"), (7, "password=secret99"), (7, "password=secret99")]
    folder = tmp_path_factory.mktemp("hard")
    table(spark, [t for _, t in rows], [i for i, _ in rows]).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


@pytest.mark.parametrize("name", ["op1_spotsigs", "op2_secret_links", "op4_substring_dedup", "op6_quality_rules", "op7_source_mixing", "op9_ngram_jaccard", "op10_suffix_dedup"])
def test_a_row_for_each_row(spark, hard, name):
    folder, rows = hard
    got = queries.QUERIES[name](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    column = {"op1_spotsigs": "n_chars", "op6_quality_rules": "n_words", "op4_substring_dedup": "n_words", "op7_source_mixing": "size", "op10_suffix_dedup": "n_bytes"}.get(name)
    size = {"n_chars": lambda t: len(t or ""), "n_bytes": lambda t: len((t or "").encode())}.get(column, lambda t: len((t or "").split()))
    if column:
        assert Counter((r.doc_id, r[column]) for r in got) == Counter((i, size(t)) for i, t in rows)
    same = [tuple(v for k, v in r.asDict().items() if k not in ("copies", "taken", "near_next", "near_edited", "edited_sha256", "edited_fingerprint")) for r in got if r.doc_id == 1]
    assert len(same) == 3 and len(set(map(repr, same))) == 1, "equal rows have equal results"


def test_pieces_of_hard_rows(spark, hard):
    folder, rows = hard
    got = queries.op5_best_fit_packing(spark, folder).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in rows)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 2048 and [a for a, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] for s in filled.values())
    assert sum(r.length for r in got if r.doc_id == 5) > 200_000 and all(r.length == 1 for r in got if r.doc_id in (3, 4))


def test_licenses_of_hard_rows(spark, hard):
    docs = spark.read.parquet(f"{hard[0]}/documents.parquet")
    assert license_scan.scan(docs).count() == len(hard[1]) or {r.doc_id for r in license_scan.scan(docs).collect()} <= {i for i, _ in hard[1]}


def test_urls_without_ids_repeated_and_very_long(spark, tmp_path):
    urls = [(None, "http://a.example.com/en/8"), (None, None), (1, "http://b.org/x"), (1, "http://b.org/x"), (2, "http://b.net/" + "y" * 1_500_000), (2, "")]
    spark.createDataFrame([(*u, "clash", "clash") for u in urls], "page_id long, url string, rule string, score string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op8_url_filter(spark, str(tmp_path)).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in urls)
    assert [len(r.path) for r in got if r.page_id == 2 and r.host] == [1_500_001]


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    urls = ["http://example.com/en/8", "http://example.com/en/7", "http://a.example.net/de/1", "http://example.net/de/8/9", "http://b.example.net/de/8", "http://example.org/es/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(6)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_stages_keep_hard_rows_whole(spark, hard):
    docs = spark.read.parquet(f"{hard[0]}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, hard[0])
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 1, 1, 2, 2, 5])
    alone = corpus_pipeline.drop_near_copies(spark, docs, hard[0]).collect()
    assert Counter(r.doc_id for r in alone)[5] == 1 and sum(r.text is not None and r.text.startswith(hard[1][0][1][:30]) for r in alone) == 1
    masked = corpus_pipeline.mask_secrets(spark, docs, hard[0]).collect()
    assert len(masked) == len(hard[1]) and [r.text for r in masked if r.doc_id == 7] == ["[secret]"] * 2
    mixed = corpus_pipeline.mix_sources(spark, docs, hard[0])
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and mixed.filter("doc_id = 5").count() <= 2
    assert corpus_pipeline.pack_sequences(spark, docs, hard[0]).filter("piece = 0").count() == len(hard[1])


# Signatures and likeness, written anew over words instead of hashes


def spots(text, chain=spotsigs.CHAIN):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return {("alone", text)} if text else set()
    common = [w in spotsigs.ANCHORS for w in words]
    content = [w for w, c in zip(words, common, strict=True) if not c]
    found = []
    for i, (w, c) in enumerate(zip(words, common, strict=True)):
        at = sum(not x for x in common[:i])
        if c and at < len(content):
            found.append((w, *content[at : at + chain]))
    return set(found) if found else {(w, *(words + [""])[i + 1 : i + 1 + chain]) for i, w in enumerate(words)}


def test_signatures_against_words(spark):
    rng = random.Random(12)
    vocabulary = [*WORDS, *spotsigs.ANCHORS[:12]]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)] + ["The", "the of", "x", "a, b; the C!", "fox the", "é der Ünd"]
    texts += [t + " and one more" for t in texts[:10]]
    plain, coded = [spots(t) for t in texts], [spotsigs.signatures(t) for t in texts]
    assert [len(a) for a in plain] == [len(b) for b in coded]
    for i in range(len(texts)):
        for j in range(i):
            want = len(plain[i] & plain[j]) / len(plain[i] | plain[j])
            assert abs(spotsigs.likeness(coded[i], coded[j]) - want) < 1e-9


# Links of secrets, written anew over Python's patterns


def linked(text, scope=secret_scan.SCOPE):
    parts = [(m.start(), number, m.end()) for number, k in enumerate(secret_scan.KINDS) for m in re.compile(k.pattern).finditer(text or "") if len(m[k.group]) >= k.least]
    role = lambda p: secret_scan.KINDS[p[1]].role
    base = [p for p in parts if p[1] < secret_scan.BASE]
    out = list(base)
    for p in (p for p in parts if p[1] >= secret_scan.BASE):
        near = [q for q in parts if q[0] < p[2] + scope and q[2] > p[0] - scope]
        apart = [q for q in near if not (q[0] < p[2] and q[2] > p[0])]
        has = lambda r: any(role(q) == r for q in apart)
        needs = {"secret": has("identifier"), "identifier": has("secret"), "endpoint": has("identifier") and has("secret")}[role(p)]
        if needs and not any(q[0] < p[2] and q[2] > p[0] for q in base):
            out.append(p)
    return ",".join(f"{secret_scan.KINDS[k].name}:{a}:{b}" for a, k, b in sorted(out))


def test_links_against_every_pair_of_parts(spark):
    rng = random.Random(13)
    bits = ["user=alice", "login: bob7", "pwd=Tr0ub4dor", "passphrase = 'abcdefgh'", "https://example.org/login", "jdbc:pg://h/db", "AKIA" + "ABCDEFGH12345678", "token=abcdef99", "é" * 40, "x " * 60, "auth=short1", "0af1" * 12, "client_id=99999", "A" * 50]
    rows = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(150)] + SECRETS
    got = {r.doc_id: r.spans for r in secret_scan.scan(table(spark, rows, list(range(len(rows))))).select("doc_id", secret_scan.listed(secret_scan.F.col("all")).alias("spans")).collect()}
    want = {i: linked(t) for i, t in enumerate(rows)}
    assert got == want
    assert sum("weak" in s for s in want.values()) > 20 and sum("pwd" in t and "weak" not in want[i] for i, t in enumerate(rows)) > 5


# Licences: recall of edited copies against exact containment


def test_recall_of_edited_licenses(spark):
    rng = random.Random(14)
    texts, planted = [], []
    for name, text in NOTICES:
        words = text.split()
        for share in (0.0, 0.01, 0.02, 0.03):
            edited = [rng.choice(WORDS) if rng.random() < share else w for w in words]
            texts.append(f"{prose(rng, 30)}\n{' '.join(edited)}\n{prose(rng, 30)}")
            planted.append(name)
    want = set()
    for i, t in enumerate(texts):
        mine = set(license_scan.shingles(t).tolist())
        for name, notice in NOTICES:
            template = set(license_scan.shingles(notice).tolist())
            if len(mine & template) >= 0.8 * len(template):
                want.add((i, name))
    index = license_scan.Templates.build(NOTICES)
    got = {(i, m[0]) for i, t in enumerate(texts) for m in license_scan.matches(t, index)}
    assert got <= want, got - want
    assert len(got) >= 0.9 * len(want), (len(got), len(want))
    assert all((i, planted[i]) in got for i in range(0, len(texts), 4)), "exact copies"


def test_component_ids_of_hard_rows(spark, hard):
    got = jaccard_join.classes(spark.read.parquet(f"{hard[0]}/documents.parquet"), percent=80, n=5).collect()
    assert {r.n_shingles for r in got if r.doc_id in (3, 4, 6)} == {0} and next(r for r in got if r.doc_id == 5).n_shingles > 200_000
