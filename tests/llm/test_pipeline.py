"""The pipeline on a small table, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline

from tidewater.llm import jaccard_join, quality, secret_scan

from .fixtures import prose, table, texts


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(12)
    docs = table(spark, [*texts(), *[f"{prose(rng, 60)} password: hunter{i}22" for i in range(5)]])
    at = docs
    ids = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{i}"
        stage(spark, at, str(tmp_path)).write.parquet(path)
        before, at = at, spark.read.parquet(path)
        ids[name] = Counter(r.doc_id for r in at.select("doc_id").collect())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality rules":
            assert set(ids[name]) == {r.doc_id for r in quality.score(before).filter("kept").collect()}
        elif name == "n-gram Jaccard join":
            assert set(ids[name]) == {r.component_id for r in jaccard_join.classes(before).collect()}
            assert max(ids[name].values()) == 1
        elif name == "secret scans":
            assert ids[name] == ids["n-gram Jaccard join"]
            assert sum(r.n_assign for r in secret_scan.scan(at).collect()) == 0
            assert at.filter("text like '%[secret]%'").count() == 5
    mixed, packed = ids["mixing sources to target weights"], at.groupBy("doc_id").sum("length").collect()
    assert set(mixed) <= set(ids["secret scans"])
    assert {r.doc_id for r in packed} == set(mixed)
    assert at.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_empty(spark, tmp_path):
    table(spark, ["a"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_without_an_id_of_their_own_stay(spark, tmp_path):
    import random

    rng = random.Random(13)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    near = f"{a} indeed"
    rows = [(None, a), (None, b), (None, b), (None, near), (5, c), (5, d), (5, d), (6, f"{d} indeed"), (7, e), (8, f"{c} indeed"), (9, near), (3, None), (3, ""), (4, " ")]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    for parts in (1, 5):
        got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), "").collect())
        first = next(t for t in (a, near) if (None, t) in got)
        assert got == Counter([(None, first), (None, b), (5, c), (5, d), (7, e), (3, None), (3, ""), (4, " ")])


def test_run_stores_each_stage(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(14)
    table(spark, [prose(rng, 60) for _ in range(12)], [None, None, 1, 1, *range(2, 10)]).write.parquet(f"{tmp_path}/documents.parquet")
    stored = []
    keep = corpus_pipeline.store
    monkeypatch.setattr(corpus_pipeline, "store", lambda df: stored.append(keep(df)) or stored[-1])
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert len(stored) == len(corpus_pipeline.STAGES)
    for df in stored[:3]:
        assert Counter(r.doc_id for r in df.collect()) == Counter([None, None, 1, 1, *range(2, 10)])
