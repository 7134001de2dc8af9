"""Suffix-array dedup over bytes with a run-length index: remove long strings that occur anywhere else.

The segments of a shard (see ``repeats``) are joined, each closed by a separator of its own, and their Burrows-Wheeler transform is
kept run by run: the symbol of each run and how many suffixes it holds, a segment that stands several times counting so often.  At
both ends of each run the index samples the text position and the longest common prefix with the suffix before
(at a run's start) or after (at its end) it in suffix order.  Inside a run that value falls by one with every step to the right in the text, so the
samples give the whole matching statistics of the shard against itself: for a position, the nearest sample to its left less the
distance.  Repetitive shards have few runs, so the samples are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from . import repeats as R

#: Bytes of one index; a shard with more is indexed in parts of whole groups.  No group is much larger alone: see ``repeats.HOT``.
INDEX_BYTES = 1 << 18
NONE = -1


_PACKED = 6  # symbols of a first key; nine bits each


def _first_ranks(symbols: np.ndarray, byte_like: bool) -> tuple[np.ndarray, int]:
    """Ranks of suffixes by their first symbols, and by how many: by several at once where symbols are bytes and closed by separators."""
    n = len(symbols)
    if not byte_like:
        return np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    close = symbols < 0
    small = np.where(close, 0, symbols + 1)
    key, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for i in range(min(_PACKED, n)):
        key[: n - i] |= np.where(ends[: n - i], 0, small[i:]) << (9 * (_PACKED - 1 - i))  # nothing beyond a separator
        ends[: n - i] |= close[i:]
    order = np.argsort(key, kind="stable")
    got, ends = key[order], ends[order]
    # No two separators are equal: those further on in the text are the larger ones
    new = np.concatenate([[0], (got[1:] != got[:-1]) | ends[1:]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank, _PACKED


def suffix_order(symbols: np.ndarray, limit: int, byte_like: bool = False) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """Suffix array by prefix doubling up to limit symbols, the ranks by growing numbers of symbols, and those numbers.

    byte_like: symbols are bytes or, below 0, separators, each of them once; the last symbol is one.
    """
    n = len(symbols)
    rank, width = _first_ranks(symbols, byte_like)
    ranks, widths, order = [rank], [width], None
    while width < limit and rank.max(initial=-1) < n - 1:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        got = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], got[1:] != got[:-1]]))
        width *= 2
        ranks.append(rank)
        widths.append(width)
    return np.argsort(rank) if order is None else order, ranks, widths


def common_prefix(symbols: np.ndarray, ranks: list[np.ndarray], widths: list[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes a and b, up to twice the symbols that the ranks tell apart."""
    n = len(symbols)
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), dtype=np.int64)
    steps = [(ranks[-1], widths[-1]), *zip(reversed(ranks), reversed(widths), strict=True)]
    for rank, width in [*steps, *[(symbols, 1)] * (widths[0] - 1)]:
        inside = (a < n) & (b < n)
        same = inside.copy()
        same[inside] = rank[a[inside]] == rank[b[inside]]
        step = same.astype(np.int64) * width
        a, b, out = a + step, b + step, out + step
    return out


@dataclass(frozen=True)
class RunLengthIndex:
    """Run-length transform of byte strings: the symbol and weight of each run, and the samples at run starts and ends by text position.

    Symbols are bytes, or -1 for a separator.  weights: suffixes of each run, those of a string that stands several times counted so often.  Samples stand at their text positions, NONE elsewhere.
    """

    heads: np.ndarray
    weights: np.ndarray
    start_lcp: np.ndarray
    end_lcp: np.ndarray

    @classmethod
    def build(cls, contents: list[bytes], times: np.ndarray) -> RunLengthIndex:
        sizes = np.array([len(c) for c in contents], dtype=np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.frombuffer(b"\0".join(contents) + b"\0", dtype=np.uint8).astype(np.int64)
        symbols[starts + sizes] = -1 - np.arange(len(contents))[::-1]
        order, ranks, widths = suffix_order(symbols, int(sizes.max()) + 1, byte_like=True)
        last = symbols[order - 1]
        first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        between = common_prefix(symbols, ranks, widths, order[first[1:] - 1], order[first[1:]])  # of a run's last and the next one's first suffix
        start_lcp, end_lcp = np.full((2, len(symbols)), NONE, dtype=np.int64)
        start_lcp[order[first]] = np.concatenate([[0], between])
        end_lcp[order[np.concatenate([first[1:] - 1, [len(order) - 1]])]] = np.concatenate([between, [0]])
        # Text positions stand for the first copy of a string that stands several times.  The next copies follow it in suffix order, and
        # run ends are the last one's; only before their first bytes, the separators, runs end at the first copy, too
        copied = times > 1
        end_lcp[np.repeat(copied, sizes + 1)] = NONE
        end_lcp[starts[copied]] = sizes[copied]
        return cls(np.maximum(last[first], -1), np.add.reduceat(np.repeat(times, sizes + 1)[order], first), start_lcp, end_lcp)

    def matching(self) -> np.ndarray:
        """For each text position, the length of the longest match that starts anywhere else in the text."""
        here = np.arange(len(self.start_lcp))
        out = np.zeros(len(here), dtype=np.int64)
        for lcp in (self.start_lcp, self.end_lcp):
            at = np.flatnonzero(lcp != NONE)
            near = np.concatenate([np.full(at[0] if len(at) else len(here), -1), np.repeat(at, np.diff(np.append(at, len(here))))])
            out = np.maximum(out, np.where(near >= 0, lcp[near] - (here - near), 0))
        return out

    def occurrences(self, patterns: list[bytes]) -> np.ndarray:
        """How often each pattern occurs, by backward search over the runs, all patterns a symbol at a time; they are of one length."""
        ends = np.cumsum(self.weights)
        begins = ends - self.weights
        by_head = np.argsort(self.heads, kind="stable")
        of = self.heads[by_head]
        before = np.cumsum(self.weights[by_head]) - self.weights[by_head]  # suffixes of smaller symbols, and of the same one in earlier runs
        text = np.frombuffer(b"".join(patterns), dtype=np.uint8).reshape(len(patterns), -1).astype(np.int64)
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), int(ends[-1]) if len(ends) else 0)
        span = len(self.heads) + 1
        keys = (of + 1) * span + by_head

        def step(symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
            run = np.searchsorted(ends, place, side="right")  # whole runs ahead of the place
            at = np.searchsorted(keys, (symbol + 1) * span + run)
            base = np.append(before, int(ends[-1]))[at]
            inside = (run < len(self.heads)) & (np.append(self.heads, -2)[run] == symbol)
            return base + np.where(inside, place - np.append(begins, 0)[run], 0)

        for i in range(text.shape[1] - 1, -1, -1):
            low, high = step(text[:, i], low), step(text[:, i], high)
        return np.maximum(high - low, 0)


def _indexed(contents: list[bytes], times: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each window of n bytes of each content occurs in the contents: 1, or 2 for more."""
    index = RunLengthIndex.build(contents, times)
    sizes = np.array([len(c) for c in contents], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    long = index.matching() >= n
    return [long[a : a + max(0, size - n + 1)].astype(np.int64) + 1 for a, size in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _kernel(n: int) -> R.Kernel:
    def parts(anchors: np.ndarray, contents: list[bytes]) -> Iterator[list[int]]:
        """Groups of one anchor, several together while there is room."""
        order = np.argsort(anchors, kind="stable")
        held: list[int] = []
        size = 0
        for group in np.split(order, np.flatnonzero(np.diff(anchors[order])) + 1):
            own = sum(len(contents[i]) for i in group)
            if held and size + own > INDEX_BYTES:
                yield held
                held, size = [], 0
            held += group.tolist()
            size += own
        if held:
            yield held

    def run(anchors: np.ndarray, contents: list[bytes], ids: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(contents)
        for members in parts(anchors, contents):
            for i, found in zip(members, _indexed([contents[i] for i in members], times[members], n), strict=True):
                out[i] = found
        return out

    return run


def _clean(n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = A.as_bytes(text)
                mask = R.window_mask(spans, n, len(data)) if spans else np.zeros(0, dtype=bool)
                removed = int(mask.sum())
                for c, v in zip(out, (doc_id, len(data), removed, len(A.runs(mask)[0]), np.frombuffer(data, dtype=np.uint8)[~mask].tobytes() if removed else data), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "kept" else pa.int64()) for c, v in out.items()], names=list(out))

    return run


def remove_long_repeats(docs: DataFrame, n: int = 200, m: int = 48) -> DataFrame:
    """Remove each byte of a string of n bytes that also starts anywhere else, in the same text too; overlaps count.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes, which may cut a character),
    one row per row of docs.  A null text is empty; texts under n bytes stay whole; equal rows remove each other.  Matches never cross texts.  Other columns are ignored.
    """
    rule = R.Rule(words=False, n=n, m=m, earlier=False)
    return R.repeated_windows(docs, rule, _kernel(n)).mapInArrow(_clean(n), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
