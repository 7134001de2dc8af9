"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are words in lower case without punctuation, as five-word shingles.  A window is so many consecutive shingles;
windows of a text start every half window, those of a template at every shingle, so a copy always has a window that starts where one
of the template's does.  With rows and bands below, windows of likeness 0.8 share a band with a probability of over 0.9999.  Templates
shorter than a window are looked up by windows of one shingle.  What is retrieved counts if the text around holds at least 0.8 of the template's distinct shingles;
of copies that stand side by side each counts.
Templates are a fixed table; their index goes to each task with its code.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .license_texts import NOTICES

SHINGLE = 5
WINDOW = 8
BANDS, ROWS = 10, 2
CONTAINED = 0.8
_BREAKS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * A.U64(2) + A.U64(1)
_BAND = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (BANDS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's five-word shingles, in order; of fewer words, of all together."""
    buf = np.frombuffer(A.as_bytes(text).translate(_BREAKS), dtype=np.uint8)
    words = A.word_hashes(buf, *A.word_bounds(buf))
    return A.gram_hashes(words, min(SHINGLE, len(words))) if len(words) else np.zeros(0, A.U64)


def band_keys(found: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the windows that start at every step-th shingle, and at the last place: [band, window], and the starts."""
    if len(found) < WINDOW:
        return np.zeros((BANDS, 0), A.U64), np.zeros(0, np.int64)
    starts = np.unique(np.concatenate([np.arange(0, len(found) - WINDOW + 1, step), [len(found) - WINDOW]]))
    hashed = A.mix(found * _SEEDS)
    least = hashed[:, : len(found) - WINDOW + 1][:, starts]
    for i in range(1, WINDOW):
        least = np.minimum(least, hashed[:, starts + i])
    return A.mix(least[0::ROWS] * A.U64(3) + least[1::ROWS] + _BAND), starts


@dataclass(frozen=True)
class Templates:
    """Index of the templates: band keys and, for short templates, shingles, sorted, with the template each belongs to.

    spots: for each template, the places of each of its shingles.
    """

    names: tuple[str, ...]
    sets: tuple[np.ndarray, ...]
    spots: tuple[dict[int, list[int]], ...]
    lengths: tuple[int, ...]
    keys: np.ndarray
    key_of: np.ndarray
    offset: np.ndarray
    short: np.ndarray
    short_of: np.ndarray

    @classmethod
    def build(cls, notices: Sequence[tuple[str, str]]) -> Templates:
        keys, owner, offset, short, short_of = [], [], [], [], []
        all_ = [shingles(text) for _, text in notices]
        for i, found in enumerate(all_):
            if len(found) < WINDOW:
                short.append(found)
                short_of.append(np.full(len(found), i))
                continue
            bands, starts = band_keys(found, 1)
            keys.append(bands.ravel())
            owner.append(np.full(bands.size, i))
            offset.append(np.tile(starts, BANDS))
        join = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        k, o, f, s, t = join(keys, A.U64), join(owner, np.int64), join(offset, np.int64), join(short, A.U64), join(short_of, np.int64)
        a, b = np.argsort(k, kind="stable"), np.argsort(s, kind="stable")
        spots: list[dict[int, list[int]]] = [{} for _ in all_]
        for found, at in zip(all_, spots, strict=True):
            for i, h in enumerate(found.tolist()):
                at.setdefault(h, []).append(i)
        return cls(tuple(n for n, _ in notices), tuple(np.unique(x) for x in all_), tuple(spots), tuple(len(x) for x in all_), k[a], o[a], f[a], s[b], t[b])


def _hits(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in wanted, place in sorted_keys) of equal keys."""
    low, high = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    count = high - low
    i = np.repeat(np.arange(len(wanted)), count)
    return i, np.repeat(low, count) + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def _copies(found: np.ndarray, places: np.ndarray, spots: dict[int, list[int]], members: np.ndarray, length: int, contained: float) -> list[tuple[int, int, float]]:
    """First and last shingle and containment of each copy of a template around the retrieved places; no two share a word.

    What the text around the places shares with the template is cut into runs that follow it shingle by shingle.  A copy is a stretch
    of whole runs no longer than a place's surroundings.  Stretches that go back in the template least often come first, so of adjacent
    copies each is a find; a find then takes the runs beside it that no other has, if they add to it.
    """
    slack = length // 4 + SHINGLE
    around = np.flatnonzero(A.covered(np.maximum(places - slack, 0), places + length + slack, len(found)))
    around = around[np.isin(found[around], members)]
    runs: list[list[int]] = []  # first and last shingle, and their places in the template
    for i, h in zip(around.tolist(), found[around].tolist(), strict=True):
        at = spots[h]
        if runs and runs[-1][1] == i - 1 and runs[-1][3] + 1 in at:
            runs[-1][1], runs[-1][3] = i, runs[-1][3] + 1
        else:
            here = next((x for x in at if runs and x > runs[-1][3]), at[0])
            runs.append([i, i, here, here])
    parts = [set(found[r[0] : r[1] + 1].tolist()) for r in runs]
    most = length + 2 * slack
    stretches = []
    for a in range(len(runs)):
        seen: set[int] = set()
        backs = 0
        for b in range(a, len(runs)):
            if runs[b][1] - runs[a][0] >= most:
                break
            grown = len(seen)
            seen |= parts[b]
            backs += b > a and runs[b][2] <= runs[b - 1][3]
            if len(seen) > grown and len(seen) / len(spots) >= contained:
                stretches.append((backs, -len(seen), runs[b][1] - runs[a][0], a, b))
    owner = np.zeros(len(found) + SHINGLE, dtype=np.int64)  # of words; 0: none
    finds = []
    for _, _, _, a, b in sorted(stretches):
        words = owner[runs[a][0] : runs[b][1] + SHINGLE]
        if not words.any():
            finds.append((a, b))
            words[:] = len(finds)
    out = []
    for name, (a, b) in enumerate(finds, 1):
        seen = set().union(*parts[a : b + 1])
        for step in (-1, 1):
            while 0 <= (c := a - 1 if step < 0 else b + 1) < len(runs):
                words = owner[runs[c][0] : runs[c][1] + SHINGLE]
                if parts[c] <= seen or ((words != 0) & (words != name)).any() or runs[max(b, c)][1] - runs[min(a, c)][0] >= most:
                    break
                words[:] = name
                seen |= parts[c]
                a, b = min(a, c), max(b, c)
        out.append((runs[a][0], runs[b][1], len(seen) / len(spots)))
    return out


def matches(text: str | None, index: Templates, contained: float = CONTAINED) -> list[tuple[str, int, int, float]]:
    """(name, first word, end word, containment) of each copy of each verified template, in order; overlapping finds of one template are one."""
    found = shingles(text)
    places: dict[int, set[int]] = {}
    bands, starts = band_keys(found, WINDOW // 2)
    i, j = _hits(index.keys, bands.ravel())
    for t, at in zip(index.key_of[j].tolist(), (starts[i % max(1, len(starts))] - index.offset[j]).tolist(), strict=True):
        places.setdefault(t, set()).add(at)
    i, j = _hits(index.short, found)
    for t, at in zip(index.short_of[j].tolist(), i.tolist(), strict=True):
        places.setdefault(t, set()).add(at)
    out = []
    for t, ats in places.items():
        copies = _copies(found, np.array(sorted(ats), dtype=np.int64), index.spots[t], index.sets[t], index.lengths[t], contained)
        out += [(index.names[t], first, last + SHINGLE, share) for first, last, share in copies]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


_FOUND = "array<struct<license:string,first_word:long,end_word:long,containment:double>>"


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] = NOTICES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_matches and matches (license, first_word, end_word, containment) of each row of docs, without a shuffle.

    A null or empty text has none; a text of fewer than five words can only match a template of as many.  Words are counted as runs
    of letters and digits.  Templates contained in longer ones are reported beside them.  Null and repeated ids are kept, each row is scanned
    for itself, and a text of any length is scanned whole.  An empty table gives no rows.  Other columns are ignored.
    """
    index = Templates.build([n for n in notices if len(shingles(n[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))
        fields = ("license", "first_word", "end_word", "containment")
        for batch in batches:
            got = [[dict(zip(fields, m, strict=True)) for m in matches(t, index, contained)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(g) for g in got], pa.int64()), pa.array(got, kind)], names=["doc_id", "n_matches", "matches"])

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_matches long, matches {_FOUND}")

