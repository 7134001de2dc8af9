"""Substring dedup with suffix automata: remove passages that an earlier document has.

Reference shards are the segments that meet by anchor (see ``repeats``).  For each shard a generalised suffix automaton over words is
built from its distinct segments in order of document id; every state keeps the smallest id among its occurrences.  The segments
are then streamed through it for matching statistics: where the longest match ends with at least n words, the state that holds
its last n words tells whether a smaller document has them.  Automata of a bounded reference are broadcast (``remove_known``).  Over a
corpus that is its own reference they would grow with the input and every text would meet every shard, so each text visits only
the shards of its anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import repeats as R

#: Words of an automaton that groups of segments share; and of one, where a single group has more: it makes several, and all its
#: later segments are streamed through each.
SHARED_WORDS, AUTOMATON_WORDS = 10_000, 150_000
NOBODY = 2**63 - 1


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``least`` of a state is the id of the first sequence that holds its words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [0]

    def _clone(self, p: int, symbol: int, q: int) -> int:
        """A state for the longest word of p followed by symbol, where q also holds longer ones."""
        nexts, links = self.next, self.link
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        links.append(links[q])
        self.length.append(self.length[p] + 1)
        self.least.append(self.least[q])
        while p >= 0 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = clone
            p = links[p]
        links[q] = clone
        return clone

    def add(self, symbols: list[int], owner: int) -> None:
        """Add a sequence; owners must not decrease."""
        nexts, links, lengths, leasts = self.next, self.link, self.length, self.least
        last = 0
        for symbol in symbols:
            q = nexts[last].get(symbol)
            if q is not None:
                last = q if lengths[q] == lengths[last] + 1 else self._clone(last, symbol, q)
                continue
            cur = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            leasts.append(owner)
            p, q = last, cur
            while p >= 0 and (q := nexts[p].setdefault(symbol, cur)) == cur:
                p = links[p]
            links.append(0 if p < 0 else q if lengths[q] == lengths[p] + 1 else -1)
            if links[cur] < 0:
                links[cur] = self._clone(p, symbol, q)
            last = cur

    def first_owners(self, symbols: list[int], n: int) -> list[int]:
        """For each n-symbol window, the least owner of a sequence that holds it, by matching statistics; NOBODY where none does."""
        nexts, links, lengths = self.next, self.link, self.length
        state = size = 0
        out = [NOBODY] * max(0, len(symbols) - n + 1)
        for i, symbol in enumerate(symbols):
            while state and symbol not in nexts[state]:
                state = links[state]
                size = lengths[state]
            state = nexts[state].get(symbol, 0)
            size = size + 1 if state else 0
            while state and lengths[links[state]] >= n:
                state = links[state]
                size = lengths[state]
            if size >= n:
                out[i - n + 1] = self.least[state]
        return out


def _kernel(n: int) -> R.Kernel:
    def run(anchors: np.ndarray, contents: list[bytes], ids: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        names: dict[bytes, int] = {}
        words: dict[int, list[int]] = {}
        found = [np.full(c.count(b" ") + 2 - n, NOBODY, dtype=np.int64) for c in contents]
        order = np.lexsort((ids, anchors))
        groups = []
        for group in np.split(order, np.flatnonzero(np.diff(anchors[order])) + 1):
            if len(group) > 1:
                groups.append(group)
                words |= {i: [names.setdefault(w, len(names)) for w in contents[i].split()] for i in group.tolist()}
            else:  # a sequence that meets no other: matched against itself, all of it has its own id
                found[int(group[0])][:] = ids[group[0]]
        # Whole groups share an automaton while there is room; a group that is larger alone goes in parts, all streamed through each.
        at = 0
        while at < len(groups):
            held, size = [groups[at]], sum(len(words[i]) for i in groups[at])
            at += 1
            while at < len(groups) and size + (more := sum(len(words[i]) for i in groups[at])) <= SHARED_WORDS:
                held.append(groups[at])
                size += more
                at += 1
            members = np.concatenate(held)
            members = members[np.argsort(ids[members], kind="stable")].tolist()
            start = 0
            while start < len(members):
                automaton, stop, used = SuffixAutomaton(), start, 0
                while stop < len(members) and (stop == start or used + len(words[members[stop]]) <= AUTOMATON_WORDS):
                    automaton.add(words[members[stop]], int(ids[members[stop]]))
                    used += len(words[members[stop]])
                    stop += 1
                for i in members[start:]:
                    found[i] = np.minimum(found[i], automaton.first_owners(words[i], n))
                start = stop
        return found

    return run


_CLEAN = "doc_id long, n_words long, n_removed long, kept string"


def _clean(n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, totals, removed, kept = [], [], [], []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = A.as_bytes(text).split()
                mask = R.window_mask(spans, n, len(words))
                ids.append(doc_id)
                totals.append(len(words))
                removed.append(int(mask.sum()))
                if removed[-1]:
                    words = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, n: int = 13) -> DataFrame:
    """Remove each word in a window of n words that also starts in a document of smaller doc_id.

    Returns doc_id, n_words, n_removed and kept, the remaining words joined by one space, one row per row of docs.  A null text
    has no words; a null doc_id is the smallest.  Rows of one doc_id are one document: they don't remove each other's words.
    Texts of fewer than n words stay whole; windows are judged on the input.  Other columns are ignored.
    """
    rule = R.Rule(words=True, n=n, m=5, earlier=True)
    return R.repeated_windows(docs, rule, _kernel(n)).mapInArrow(_clean(n), _CLEAN)


def remove_known(docs: DataFrame, reference: DataFrame, n: int = 13, most_bytes: int = 64 << 20) -> DataFrame:
    """Remove each word in a window of n words that a text of a small reference has: its automata are broadcast, and documents streamed through.

    The reference's bytes are summed first; above most_bytes this raises, and ``remove_repeats`` over both tables is the way.
    Columns, nulls and short texts are as there; a document that is itself in the reference goes whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = reference.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the reference has {size} bytes, more than {most_bytes}")
    known = docs.sparkSession.sparkContext.broadcast([A.as_bytes(r[0]) for r in reference.select(text).distinct().collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        shards, used = [SuffixAutomaton()], 0
        for data in known.value:
            if used > AUTOMATON_WORDS:
                shards, used = [*shards, SuffixAutomaton()], 0
            words = data.split()
            shards[-1].add([names.setdefault(w, len(names)) for w in words], 0)
            used += len(words)
        for batch in batches:
            spans = []
            for data in batch.column("text").to_pylist():
                words = [names.get(w, -1) for w in A.as_bytes(data).split()]
                first, end = A.runs(np.min([np.full(max(0, len(words) - n + 1), NOBODY), *[s.first_owners(words, n) for s in shards]], axis=0) < NOBODY)
                spans.append([np.stack([first, end - 1], axis=1).astype(np.int64).tobytes()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.list_(pa.binary()))], names=["doc_id", "text", "spans"])

    matched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, text string, spans array<binary>")
    return matched.mapInArrow(_clean(n), _CLEAN)
