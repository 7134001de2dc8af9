"""Candidate search that substring dedup and suffix-array dedup share.

A window is n consecutive units (words or bytes) of one text.  Windows that share their minimizer form a segment, and equal windows
lie in segments of one anchor (see ``arrays.segments``).  Three exchanges follow, each of bounded groups:

1. anchors meet by hash; those of one occurrence are dropped, the others go back to their texts;
2. the segments of the remaining anchors, with their units, meet by anchor, where a kernel (a suffix automaton, or a run-length
   index) tells of each window who else has it; nothing but the kernel decides what is repeated;
3. the spans found meet their text, which is dealt out once, by a hash of id and text, for both joins.

Before 1 and 2 each task joins equal anchors and equal segments of its own batch, lets the kernel decide among them, and sends one
row for them, so a passage in a third of all texts sends one row for each batch, not one for each text.  An anchor with more than HOT such rows, as
where a passage of very many texts meets their own words, is split: its windows go to as many parts as it takes, each where its own
hash leads, and those that occur once are dropped before their units are sent.  For that only the texts that have such an anchor are read
again.  Collected are one sum and the split anchors, at most MOST_HOT.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import store

BATCH_BYTES = 48 << 20
#: Segments of one anchor that meet in one group; an anchor of more is split.
HOT, MOST_HOT = 1 << 14, 1 << 20
_FOUND = "j long, h long, spans binary"
_LOCAL = -(2**63) + 1  # of an anchor that several texts of one batch have
#: Kernel: (anchors, contents, least ids, times) of distinct segments -> for each a number for every window: the least id that has it
#: (of a rule for earlier texts), or how often it occurs, where 2 stands for more, too.
Kernel = Callable[[np.ndarray, list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


@dataclass(frozen=True)
class Rule:
    """What a window is and when it counts as repeated.

    earlier: only windows that also start in a text of smaller id; else windows that also start anywhere else.
    """

    words: bool
    n: int
    m: int
    earlier: bool

    def units(self, data: bytes) -> np.ndarray:
        buf = np.frombuffer(data, dtype=np.uint8)
        return A.word_hashes(buf, *A.word_bounds(buf)) if self.words else A.byte_units(buf)

    def contents(self, data: bytes, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Bytes of segments by their first and last window; words are joined by one space."""
        if not self.words:
            return [data[a:b] for a, b in zip(first.tolist(), (last + self.n).tolist(), strict=True)]
        buf = np.frombuffer(data, dtype=np.uint8)
        starts, ends = A.word_bounds(buf)
        odd = np.concatenate([[0], np.cumsum((starts[1:] - ends[:-1] != 1) | (buf[ends[:-1]] != 32))])  # gaps that aren't one space
        last = last + self.n - 1
        whole = (odd[last] == odd[first]).tolist()
        return [data[a:b] if ok else b" ".join(data[a:b].split()) for a, b, ok in zip(starts[first].tolist(), ends[last].tolist(), whole, strict=True)]

    def repeated(self, known: np.ndarray, k: int) -> np.ndarray:
        """Which windows are repeated for a text of id k, by the kernel's numbers."""
        return known < k if self.earlier else known > 1


def id_of() -> Column:
    """The id that counts; null is the least."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def keyed(docs: DataFrame) -> DataFrame:
    """Texts with their key: k (the id; null is the least) and h (a hash of the text, to tell different texts of one id apart)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"k": id_of(), "h": F.xxhash64("text")})


def shards_for(docs: DataFrame, bytes_per_shard: int) -> int:
    """How many shards hold about so many bytes of text each."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-int(total) // bytes_per_shard))


def _column(values: list | np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def _batch(**columns: tuple[list | np.ndarray, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(*x) for x in columns.values()], names=list(columns))


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of the batches, in groups of a bounded number of text bytes."""
    held: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["text"])
            if size >= BATCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class Split:
    """Anchors of very many segments, sorted, and the number of parts of each: its windows go to parts by their hash."""

    anchors: np.ndarray
    parts: np.ndarray
    shards: int

    def windows(self, rule: Rule, units: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segments of other anchors (anchor, first and last window), and of these the windows (a hash, the place and the part's anchor).

        The hash of a window leads to the shard of its part, so a text sends one row for each part and not for each window.
        """
        grams, first, last = A.segments(units, rule.n, rule.m)
        split = _among(self.anchors, grams)
        count = last[split] - first[split] + 1
        windows = np.repeat(first[split], count) + A.ramp(count)
        if not len(windows):
            return grams, first, last, np.zeros(0, A.U64), windows, np.zeros(0, A.U64)
        own = A.gram_hashes(units, rule.n)[windows]
        of = np.searchsorted(self.anchors, np.repeat(grams[split], count))
        part = A.mix(self.anchors[of] + own % self.parts[of].astype(A.U64) * A.U64(0x9E3779B97F4A7C15))
        led = own - own % A.U64(self.shards) + part % A.U64(self.shards)
        return grams[~split], first[~split], last[~split], led, windows, part


def _among(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), dtype=bool)


_ANCHORS = "kind int, shard int, anchors binary, js binary, times binary"


def anchors_out(rule: Rule, shards: int, hot: Split | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Anchors of each batch by shard; what the batch itself shows to be repeated goes to the texts at once.

    hot: only the windows of these anchors' segments, by their hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _flushes(batches):
            got, whole = [], []
            for r in rows:
                units = rule.units(A.as_bytes(r["text"]))
                if hot is None:
                    grams, a, b = A.segments(units, rule.n, rule.m)
                    whole.append(A.span_hashes(units, a, b + rule.n))
                else:
                    grams = hot.windows(rule, units)[3]
                    whole.append(grams)
                got.append(grams)
            owner = np.repeat(np.arange(len(rows)), [len(x) for x in got])
            anchors, content = np.concatenate([*got, np.zeros(0, A.U64)]), np.concatenate([*whole, np.zeros(0, A.U64)])
            js = np.array([r["j"] for r in rows], dtype=np.int64)
            order, first, size = A.by_key(anchors)
            anchors, owner, content = anchors[order], owner[order], content[order]
            different = size.copy()  # a row is sent for each different segment
            shared = np.flatnonzero(np.repeat(size > 1, size))
            if len(shared):
                group = np.repeat(np.arange(len(size)), size)[shared]
                pairs = np.lexsort((content[shared], group))
                of, what = group[pairs], content[shared][pairs]
                new = np.concatenate([[True], (of[1:] != of[:-1]) | (what[1:] != what[:-1])])
                different[size > 1] = np.bincount(of[new], minlength=len(size))[size > 1]
            many = size > 1
            inside = np.repeat(many, size)
            out: dict[str, list] = {c: [] for c in ("shard", "anchors", "js", "times")}
            sent, local = anchors[first], np.where(many, -1, owner[first])
            back, start, count = A.by_key((sent % A.U64(shards)).astype(np.int64))
            for a, c in zip(start.tolist(), count.tolist(), strict=True):
                at = back[a : a + c]
                who = local[at]
                for name, v in zip(out, (int(sent[at[0]] % A.U64(shards)), sent[at].tobytes(), np.where(who < 0, _LOCAL, js[who]).tobytes(), different[at].astype(np.uint32).tobytes()), strict=True):
                    out[name].append(v)
            yield _batch(kind=([0] * len(out["shard"]), pa.int32()), shard=(out["shard"], pa.int32()), anchors=(out["anchors"], pa.binary()), js=(out["js"], pa.binary()), times=(out["times"], pa.binary()))
            if inside.any():
                own, grams = owner[inside], anchors[inside]
                back, start, count = A.by_key(own)
                whose = js[own[back][start]]
                yield _batch(
                    kind=([1] * len(start), pa.int32()), shard=((whose % shards).tolist(), pa.int32()),
                    anchors=([np.unique(grams[back[a : a + c]]).tobytes() for a, c in zip(start, count, strict=True)], pa.binary()),
                    js=([x.tobytes() for x in whose], pa.binary()), times=([b""] * len(start), pa.binary()),
                )

    return run


_WANTED = "j long, anchors binary, total long, gram long, times long"


def repeated_anchors(limit: int) -> Callable[[pa.Table], pa.Table]:
    """Of one shard: for each text, those of its anchors that occur more than once; the number of all, and the anchors of more than limit segments."""

    def run(table: pa.Table) -> pa.Table:
        anchors, js, times, sure = [], [], [], []
        for kind, a, j, t in zip(*(table.column(c).to_pylist() for c in ("kind", "anchors", "js", "times")), strict=True):
            grams = np.frombuffer(a, dtype=A.U64)
            anchors.append(grams)
            js.append(np.resize(np.frombuffer(j, dtype=np.int64), len(grams)))
            times.append(np.frombuffer(t, dtype=np.uint32) if kind == 0 else np.zeros(len(grams), np.uint32))
            sure.append(np.full(len(grams), kind == 1))
        grams, j, times, direct = (np.concatenate(x) for x in (anchors, js, times, sure))
        found = np.zeros(len(grams), dtype=bool)
        at = np.flatnonzero(~direct)
        order, first, size = A.by_key(grams[at])
        several = np.zeros(len(at), dtype=bool)
        several[order] = np.repeat(size > 1, size)
        found[at] = several & (j[at] != _LOCAL)
        total = np.add.reduceat(times[at][order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        hot = total > limit
        crowded, number = grams[at][order][first][hot], total[hot]
        keep = found | direct
        grams, j = grams[keep], j[keep]
        order, first, size = A.by_key(j)
        grams, j = grams[order], j[order]
        none = lambda n: [None] * n
        n, m = len(first), len(crowded)
        columns = (
            [*j[first].tolist(), *none(m + 1)], [*[grams[a : a + c].tobytes() for a, c in zip(first, size, strict=True)], *none(m + 1)],
            [*none(n), int(total.sum()), *none(m)], [*none(n + 1), *crowded.view(np.int64).tolist()], [*none(n + 1), *number.tolist()],
        )
        return pa.table([pa.array(x, pa.binary() if i == 1 else pa.int64()) for i, x in enumerate(columns)], names=["j", "anchors", "total", "gram", "times"])

    return run


_SENT = "shard int, anchor long, content binary, j long, h long, k long, times long, at long"


def segments_out(rule: Rule, kernel: Kernel, shards: int, hot: Split) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The segments of repeated anchors: one row for equal segments of a batch; what the kernel finds inside the batch goes on as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _flushes(batches):
            seen: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for i, r in enumerate(rows):
                wanted = np.unique(np.frombuffer(b"".join(r["anchors"]), dtype=A.U64))
                data = A.as_bytes(r["text"])
                grams, first, last, led, windows, part = hot.windows(rule, rule.units(data))
                on = _among(wanted, grams)
                grams, first, last = grams[on], first[on], last[on]
                windows, part = windows[_among(wanted, led)], part[_among(wanted, led)]
                if len(windows):  # neighbours of one part go together
                    new = np.flatnonzero(np.concatenate([[True], (windows[1:] != windows[:-1] + 1) | (part[1:] != part[:-1])]))
                    grams, first = np.concatenate([grams, part[new]]), np.concatenate([first, windows[new]])
                    last = np.concatenate([last, windows[np.append(new[1:], len(windows)) - 1]])
                if len(grams):
                    for gram, content, a in zip(grams.view(np.int64).tolist(), rule.contents(data, first, last), first.tolist(), strict=True):
                        seen.setdefault((gram, content), []).append((i, a))
            out: dict[str, list] = {c.split()[0]: [] for c in _SENT.split(", ")}
            ks = [r["k"] for r in rows]
            leasts = {key: min(ks[i] for i, _ in places) for key, places in seen.items() if len(places) > 1}
            crowd = [key for key in leasts if not rule.earlier or any(ks[i] > leasts[key] for i, _ in seen[key])]
            spans: dict[int, list[tuple[int, int]]] = {}
            for key, runs in zip(crowd, _asked(rule, kernel, crowd, [leasts[c] for c in crowd], [len(seen[c]) for c in crowd]), strict=True):
                for i, a in seen[key]:
                    for x, y in runs(ks[i]):
                        spans.setdefault(i, []).append((a + x, a + y))
            for (gram, content), places in seen.items():
                send = places[:1]
                if rule.earlier and len(places) > 1:
                    send = [p for p in places if ks[p[0]] == leasts[gram, content]]
                for i, a in send:
                    for c, v in zip(out, (gram % shards, gram, content, rows[i]["j"], rows[i]["h"], ks[i], len(places), a), strict=True):
                        out[c].append(v)
            for i, got in spans.items():
                for c, v in zip(out, (rows[i]["j"] % shards, 0, merged(np.array(got, dtype=np.int64)).tobytes(), rows[i]["j"], rows[i]["h"], 0, 0, -1), strict=True):
                    out[c].append(v)
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            yield _batch(**{c: (out[c], kinds[kind]) for c, kind in (x.split() for x in _SENT.split(", "))})

    return run


def _asked(rule: Rule, kernel: Kernel, keys: list[tuple[int, bytes]], leasts: list[int], times: list[int]) -> Iterator[Callable[[int], list[tuple[int, int]]]]:
    """For each segment, what gives the runs of its windows that are repeated for an id, as pairs of first and last window."""
    if not keys:
        return
    got = kernel(np.array([g for g, _ in keys], dtype=np.int64), [c for _, c in keys], np.array(leasts, dtype=np.int64), np.array(times, dtype=np.int64))
    at = np.cumsum([0, *[len(x) for x in got[:-1]]])
    joined = np.concatenate(got)
    # Most segments are repeated from end to end or not at all
    for known, low, high in zip(got, np.minimum.reduceat(joined, at).tolist(), np.maximum.reduceat(joined, at).tolist(), strict=True):

        def runs(k: int, known: np.ndarray = known, low: int = low, high: int = high) -> list[tuple[int, int]]:
            if high < k if rule.earlier else low > 1:
                return [(0, len(known) - 1)]
            if low >= k if rule.earlier else high <= 1:
                return []
            first, end = A.runs(rule.repeated(known, k))
            return list(zip(first.tolist(), (end - 1).tolist(), strict=True))

        yield runs


def merged(windows: np.ndarray) -> np.ndarray:
    """Pairs of first and last window with those that touch or overlap joined."""
    windows = windows[np.argsort(windows[:, 0], kind="stable")]
    last = np.maximum.accumulate(windows[:, 1])
    new = np.concatenate([[True], windows[1:, 0] > last[:-1] + 1])
    return np.stack([windows[new, 0], last[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(last) - 1]])]], axis=1)


def spans_of(rule: Rule, kernel: Kernel) -> Callable[[pa.Table], pa.Table]:
    """Of one shard: the windows of each text that are repeated, as pairs of first and last window."""

    def run(table: pa.Table) -> pa.Table:
        anchor, content, j, h, k, times, at = (table.column(c).to_pylist() for c in ("anchor", "content", "j", "h", "k", "times", "at"))
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        groups: dict[int, dict[bytes, list[int]]] = {}
        for i, a in enumerate(at):
            if a < 0:
                found.setdefault((j[i], h[i]), []).extend(map(tuple, np.frombuffer(content[i], dtype=np.int64).reshape(-1, 2).tolist()))
            else:
                groups.setdefault(anchor[i], {}).setdefault(content[i], []).append(i)
        keys = [(gram, text) for gram, contents in groups.items() for text, rows in contents.items() if len(contents) > 1 or len(rows) > 1]
        rows_of = [groups[gram][text] for gram, text in keys]
        for rows, runs in zip(rows_of, _asked(rule, kernel, keys, [min(k[i] for i in rows) for rows in rows_of], [sum(times[i] for i in rows) for rows in rows_of]), strict=True):
            for i in rows:
                for x, y in runs(k[i]):
                    found.setdefault((j[i], h[i]), []).append((at[i] + x, at[i] + y))
        texts = list(found)
        return pa.table({"j": pa.array([x[0] for x in texts], pa.int64()), "h": pa.array([x[1] for x in texts], pa.int64()), "spans": pa.array([merged(np.array(found[x], dtype=np.int64)).tobytes() for x in texts], pa.binary())})

    return run


def _having(known: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The j of rows that have one of the sorted anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [_among(known, np.frombuffer(x, dtype=A.U64)).any() for x in batch.column("anchors").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("j").filter(pa.array(mine, pa.bool_()))], names=["j"])

    return run


def _met(docs: DataFrame, rule: Rule, shards: int, hot: Split | None = None) -> DataFrame:
    return store(docs.select("text", "j").mapInArrow(anchors_out(rule, shards, hot), _ANCHORS).groupBy("shard").applyInArrow(repeated_anchors(HOT), _WANTED))


def repeated_windows(docs: DataFrame, rule: Rule, kernel: Kernel, bytes_per_shard: int = 1 << 20) -> DataFrame:
    """Each row of docs with doc_id, text and spans: packed int64 pairs of first and last repeated window, null where there are none."""
    docs = keyed(docs).select("doc_id", "text", "h", F.xxhash64("k", "text").alias("j"))
    shards = shards_for(docs, bytes_per_shard)
    met = _met(docs, rule, shards)
    total = met.agg(F.sum("total")).first()[0] or 0
    # So at most MOST_HOT anchors are split
    crowded = sorted((r["gram"] % 2**64, r["times"]) for r in met.filter(F.col("times") > total // MOST_HOT).select("gram", "times").collect())
    hot = Split(np.array([g for g, _ in crowded], dtype=A.U64), np.array([-(-n // HOT) for _, n in crowded], dtype=np.int64), shards)
    if crowded:
        # The texts that have split anchors, as a stored table of keys: Spark broadcasts it if its size allows, and shuffles if not
        having = store(met.filter(F.col("j").isNotNull()).select("j", "anchors").mapInArrow(_having(hot.anchors), "j long"))
        met = met.unionByName(_met(docs.join(having, "j", "left_semi"), rule, shards, hot))
    wanted = met.filter(F.col("j").isNotNull()).groupBy("j").agg(F.collect_list("anchors").alias("anchors"))
    dealt = docs.repartition("j")
    # Both joins take the same columns of dealt, so that its exchange is made once and used again
    chosen = dealt.join(wanted.hint("shuffle_hash"), "j", "left").filter(F.col("anchors").isNotNull()).select("text", "j", "h", id_of().alias("k"), "anchors")
    parts = chosen.mapInArrow(segments_out(rule, kernel, shards, hot), _SENT)
    found = parts.groupBy("shard").applyInArrow(spans_of(rule, kernel), _FOUND).groupBy("j").agg(F.collect_list(F.struct("h", "spans")).alias("found"))
    mine = F.transform(F.filter("found", lambda x: x["h"] == F.col("h")), lambda x: x["spans"])
    return dealt.join(found.hint("shuffle_hash"), "j", "left").select("doc_id", "text", mine.alias("spans"))


def window_mask(spans: list[bytes] | None, n: int, length: int) -> np.ndarray:
    """Which of a text's units lie in its repeated windows."""
    if not spans:
        return np.zeros(length, dtype=bool)
    pairs = np.frombuffer(b"".join(spans), dtype=np.int64).reshape(-1, 2)
    return A.covered(pairs[:, 0], pairs[:, 1] + n, length)
