"""Quality rules over whole texts, with a suffix array of words for long repetition.

The suffix array of a text's words, and the longest common prefixes of its neighbours, give the longest repeat that starts at each
word.  Repeats of a stated number of words that don't extend to the left are the maximal ones; the union of their spans is what the
text repeats.  A text fails when that union is too large a share of it or the longest repeat is too long.

What repeats of 8 words cover is part of what repeated windows of 5 words cover, so the base rule's 20% must not be the limit here, too:
a wider repeat is rarer by chance, and less of it is allowed.  12% is what Gopher's rules allow for repeated 8-grams.  A passage of
over 100 words, a long paragraph, must not stand twice in a text however long the rest is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """A text is kept if it passes the base rules and no limit here is exceeded.

    repeat_words: words of a repeat that counts; covered: most of the text, from 0 to 1, that such repeats may cover;
    longest: a repeat of more words is too long, in a text of any length.
    """

    min_words: int = 10
    window: int = 5
    repeated_percent: int = 20
    repeat_words: int = 8
    covered: float = 0.12
    longest: int = 100


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_covered", "longest_repeat")
_SCHEMA = ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean"


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.  One level of ranks is held, so memory is in proportion to the text however repetitive it is."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, width = np.argsort(rank), 1
    while width < n and rank.max() < n - 1:
        rank *= n + 1
        rank[: n - width] += rank[width:] // (n + 1) + 1
        order = np.argsort(rank)
        new = np.zeros(n, dtype=np.int64)
        got = rank[order]
        new[1:] = got[1:] != got[:-1]
        rank[order] = np.cumsum(new)
        width *= 2
    return order


def longest_repeats(hashes: np.ndarray) -> np.ndarray:
    """For each word, how many words of the longest repeat that starts there; the other occurrence may overlap it."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    order = suffix_array(hashes)
    shared = A.shared_prefix(hashes, order[:-1], order[1:])
    out[order[:-1]] = shared
    out[order[1:]] = np.maximum(out[order[1:]], shared)
    return out


def maximal_repeats(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal repeats of at least so many words."""
    size = longest_repeats(hashes)
    grown = np.concatenate([[False], size[:-1] > size[1:]])
    starts = np.flatnonzero((size >= least) & ~grown)
    return starts, starts + size[starts]


def measure(text: str | None, limits: Limits) -> tuple:
    """The counts of one text in the order of the result's columns, and the two verdicts."""
    data = A.as_bytes(text)
    buf = np.frombuffer(data, dtype=np.uint8)
    starts, ends = A.word_bounds(buf)
    n = len(starts)
    inner = (buf & 0xC0) == 0x80
    chars = int((ends - starts).sum() - np.count_nonzero(inner))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    hashes = A.word_hashes(buf, starts, ends)
    repeated = covered = longest = 0
    if n >= limits.window:
        grams = A.gram_hashes(hashes, limits.window)
        order, first, size = A.by_key(grams)
        at = order[np.repeat(size > 1, size)]
        if len(at):
            repeated = int(np.count_nonzero(A.covered(at, at + limits.window, n)))
    if repeated:  # a repeat of as many words as a window or more shows there
        a, b = maximal_repeats(hashes, limits.repeat_words)
        if len(a):
            covered, longest = int(np.count_nonzero(A.covered(a, b, n))), int((b - a).max())
    failed = n < limits.min_words or 100 * repeated > limits.repeated_percent * n
    kept = not failed and covered <= limits.covered * n and longest <= limits.longest
    return n, chars, int(np.count_nonzero(_SYMBOL[buf])), len(lines) - len(set(lines)), repeated, covered, longest, failed, kept


def score(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """All columns of docs and the counts and verdicts of each text, one row per row, without a shuffle.

    A null text has no words and fails the base rules, as any text of fewer than min_words.  Lines are equal to the byte.
    Columns of docs that clash with the new ones are replaced.
    """
    limits = limits or Limits()
    if limits.repeat_words < limits.window:
        raise ValueError("repeat_words must be at least window")
    docs = docs.drop(*[c for c in (*_COUNTS, "base_failed", "kept") if c in docs.columns])
    names = [*_COUNTS, "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [measure(t, limits) for t in batch.column("text").to_pylist()]
            new = [pa.array([g[i] for g in got], pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {_SCHEMA}")
