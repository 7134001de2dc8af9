"""Helpers that work on one text at a time inside a Spark task: words, rolling hashes, minimizers and span unions as numpy arrays.

Words are maximal runs of bytes other than the six ASCII white-space bytes, so they are the matches of ``[^\\x20\\x09-\\x0D]+`` in the
UTF-8 text.  Hashes are 64-bit polynomials over random per-byte values; equal input gives equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240117)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CHUNK = 1 << 20
_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; a function of n alone."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=U64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        _powers, _inverses = out
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def as_bytes(text: str | bytes | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in slices of a few rows, so that only these are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a uint8 array."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.ones(len(buf) + 2, dtype=np.int8)
    gap[1:-1] = _SPACE[buf]
    edge = np.diff(gap)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; chunks bound the memory of very long texts."""
    if len(buf) > _CHUNK and len(starts) > 1:
        cuts = np.searchsorted(starts, np.arange(_CHUNK, len(buf), _CHUNK))
        cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
        return np.concatenate([word_hashes(buf[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) if len(cuts) > 2 else _word_hashes(buf, starts, ends)
    return _word_hashes(buf, starts, ends)


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def byte_units(buf: np.ndarray) -> np.ndarray:
    """A 64-bit value for each byte, for ``gram_hashes``."""
    return _BYTE[buf]


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive units."""
    if len(units) < n:
        return np.zeros(0, dtype=U64)
    power, inverse = _tables(len(units) + 1)
    total = np.zeros(len(units) + 1, dtype=U64)
    np.cumsum(units * power[: len(units)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(units) - n + 1] + U64(n))


def span_hashes(units: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of units from first to before end."""
    power, inverse = _tables(len(units) + 1)
    total = np.zeros(len(units) + 1, dtype=U64)
    np.cumsum(units * power[: len(units)], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first] + (end - first).astype(U64))


def shared_prefix(units: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the runs of units that start at a and at b, by hashes of halving lengths."""
    n = len(units)
    power, inverse = _tables(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(units * power[:n], out=total[1:])
    out = np.zeros(len(a), dtype=np.int64)
    most = n - np.maximum(a, b)
    for level in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
        step = 1 << level
        at = np.flatnonzero(out + step <= most)
        x, y = a[at] + out[at], b[at] + out[at]
        out[at] += step * ((total[x + step] - total[x]) * inverse[x] == (total[y + step] - total[y]) * inverse[y])
    return out


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w keys, in linear time."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


_POSITION = U64((1 << 24) - 1)
_PIECE = 1 << 22


def segments(units: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut the windows of n units into segments that share their minimizer.

    The minimizer of a window is its m-gram of least hash, the leftmost of equals.  Equal windows, wherever they stand, have equal
    minimizers at equal offsets, so they lie in segments with one anchor.  Returns (anchor hash, first window, last window) for
    each segment; segment k holds units first[k] to last[k] + n - 1.  Texts longer than 4 M units go in pieces that overlap by
    n - 1 units: no window is lost.
    """
    count = len(units) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, count, _PIECE):
        part = units[at : at + _PIECE + n - 1]
        grams = gram_hashes(part, m)
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=U64)
        where = (sliding_min(keys, n - m + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:], [len(where)]]) - 1
        out.append((grams[where[first]], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Which of length places lie in the union of the spans [start, end)."""
    step = np.zeros(length + 1, dtype=np.int64)
    np.add.at(step, np.minimum(starts, length), 1)
    np.add.at(step, np.minimum(ends, length), -1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true places."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order that brings equal keys together, and the start and size of each group in it."""
    order = np.argsort(keys, kind="stable")
    got = keys[order]
    first = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]])) if len(got) else np.zeros(0, np.int64)
    return order, first, np.diff(np.concatenate([first, [len(got)]]))


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1 ... for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
