"""Small texts with planted copies, and tables of them with columns that clash with those of the operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne", "ro", "sa", "te") for b in ("n", "r", "st", "l", "é")]
#: Names that operators use inside or return.
CLASHES = ("k", "h", "node", "size", "slice", "shard", "spans", "kept", "n_words", "target", "copies", "kind", "part", "guest", "score", "rule", "piece", "offset", "anchors", "found")


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts(seed: int = 1, count: int = 60) -> list[str | None]:
    """Random texts, exact and near copies, shared passages, repeated lines, white space, nulls, and one long text."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    out: list[str | None] = [None, "", " \t\n", "one", "one two three", "ONE two  three"]
    base = [prose(rng, rng.randint(3, 120)) for _ in range(count)]
    out += base
    for text in base[:12]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        out += [text, " ".join(words), text.upper(), f"{prose(rng, 9)}\n{passage} {prose(rng, 7)}"]
    out += [f"{passage} {passage}\n{passage}", "x" * 700, "y " * 300, prose(rng, 3000) + passage]
    return out


def table(spark: SparkSession, rows: list[str | None], ids: list[int | None] | None = None) -> DataFrame:
    ids = ids or [7 * i % 1009 for i in range(len(rows))]
    fields = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, "en", f"src{len(t or '') % 3}", len(t or ""), *["clash"] * len(CLASHES)) for i, t in zip(ids, rows, strict=True)], f"doc_id long, text string, lang string, source string, n_chars long, {fields}").repartition(3)
