"""Document fingerprints by spot signatures.

A signature is a common word (the anchor) with the next content words after it; common words that stand between are passed over.  A text's fingerprint is
the set of its signatures.  Two fingerprints are compared by Jaccard likeness; where a least likeness is asked for, sets whose
lengths alone rule it out aren't compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import jaccard_join
from .repeats import shards_for

# Common words of four languages.
ANCHORS = tuple(
    "a an and are as at be by can do for from in is it of on or that the this to was with "
    "auf das der die ein eine ist mit nicht sich und von zu "
    "de des du est et la le les pour que un une "
    "con el en es los no por se una y".split()
)
CHAIN = 2
_BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_STOP = np.sort(A.word_hashes(np.frombuffer(" ".join(ANCHORS).encode(), np.uint8), *A.word_bounds(np.frombuffer(" ".join(ANCHORS).encode(), np.uint8))))


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a text.

    Near the end of a text chains are shorter.  A text without a chain after an anchor takes all its words as anchors; one without
    words is its own signature; an empty or null one has none.
    """
    text = text or ""
    buf = np.frombuffer(A.as_bytes(text.lower()).translate(_BREAKS), dtype=np.uint8)
    words = A.word_hashes(buf, *A.word_bounds(buf))
    if not len(words):
        return np.frombuffer(hashlib.sha256(A.as_bytes(text)).digest()[:4], dtype="<u4") if text else np.zeros(0, np.uint32)
    common = _STOP[np.minimum(np.searchsorted(_STOP, words), len(_STOP) - 1)] == words
    content = words[~common]
    at = np.cumsum(~common)[common]  # content words before each anchor
    anchors = words[common][at < len(content)]
    at = at[at < len(content)]
    if not len(at):
        content, anchors, at = np.concatenate([words, [A.U64(0)]]), words, np.arange(1, len(words) + 1)
    padded = np.concatenate([content, np.zeros(chain, dtype=A.U64)])
    got = anchors
    for step in range(chain):
        got = A.mix(got * A.U64(0x9E3779B97F4A7C15) + padded[at + step])
    return np.unique((got >> A.U64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets, 1 for two empty ones; 0 at once where their lengths keep it under least."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _coded(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def _between(edges: np.ndarray) -> Callable[[pd.Series], pd.Series]:
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), side="left").astype(np.int32))

    return run


def _ordered(parts: list[int], tops: dict[int, int]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """The part of each id, and for the largest id of a part also the part above it, whose last document it follows."""
    above = dict(zip(parts, [*parts[1:], *parts[:1]], strict=True))

    def run(k: pd.Series, part: pd.Series) -> pd.Series:
        return pd.Series([[p, above[p]] if tops[p] == x else [p] for x, p in zip(k, part, strict=True)])

    return run


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"


def _compared(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("guest", "k", "text", "doc_id")), strict=True), key=lambda r: (r[0], -r[1], r[2]))
    own = sum(not r[0] for r in rows)
    texts = [r[2] for r in rows[: own + 1]]
    found = [signatures(t) for t in texts]
    out: dict[str, list] = {c.split()[0]: [] for c in _EDITED.split(", ")}
    for i in range(own):
        text, after = texts[i], texts[i + 1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        changed = signatures(edited)
        row = (rows[i][3], len(text), hashlib.sha256(A.as_bytes(edited)).hexdigest(), _coded(found[i]), _coded(changed), likeness(found[i], changed), likeness(found[i], found[i + 1]), len(found[i]))
        for c, v in zip(out, row, strict=True):
            out[c].append(v)
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.table({c: pa.array(v, kinds[t]) for (c, v), t in zip(out.items(), [x.split()[1] for x in _EDITED.split(", ")], strict=True)})


def edited_and_next(docs: DataFrame, bytes_per_part: int = 12 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they and the next document's are.

    The next document is that of the next smaller doc_id, after the smallest the largest; null is the smallest, and rows of one
    doc_id stand in order of their text.  The edited text has the last half of the code points (rounded down) replaced by as many
    first ones of the next document.  One row per row of docs, of equal ones each; a null text is empty, and texts of any length are read whole.  A lone row is its own next.  Other columns are ignored.

    Ids are cut into ranges at approximate quantiles; the first document of a range is also sent to the one before it in order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k"), text.alias("text"))
    count = shards_for(docs, bytes_per_part)
    cuts = rows.agg(F.percentile_approx("k", [i / count for i in range(1, count)], 10 * count)).first()[0]
    edges = np.array(sorted(set(cuts or [])), dtype=np.int64)
    part = F.pandas_udf(_between(edges), "int")
    # One row for each range
    tops = {r["part"]: r["top"] for r in rows.select("k", part("k").alias("part")).groupBy("part").agg(F.max("k").alias("top")).collect()}
    parts = F.pandas_udf(_ordered(sorted(tops), tops), "array<int>")
    dealt = rows.withColumn("part", part("k")).select("doc_id", "k", "text", F.posexplode(parts("k", "part")).alias("guest", "part"))
    return dealt.withColumn("guest", F.col("guest") > 0).groupBy("part").applyInArrow(_compared, _EDITED)


def classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_signatures and component_id: documents joined by likeness of percent or more, with the search of ``jaccard_join``.

    Posting lists stand in order of set length, and partners whose lengths rule the likeness out are left out before any comparison.
    """
    got = jaccard_join.classes(docs, percent, sets=wide_signatures)
    return got.withColumnRenamed("n_shingles", "n_signatures")


def wide_signatures(text: str | None) -> np.ndarray:
    """Signatures spread over 64 bits."""
    return np.sort(A.mix(signatures(text).astype(A.U64) + A.U64(1)))

