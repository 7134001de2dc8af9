"""Similarity join on word shingles with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles.  Shingles have one global order, rare before frequent by a count sketch of
the whole corpus and then by hash.  If two sets are alike enough, their prefixes of size - required overlap + l have l shingles in common
for every l; each set chooses the l that its estimated cost makes cheapest: a longer prefix costs postings, but each candidate must then
use up l of them.  Of two sets, take the one whose published prefix ends first: what they share beyond it is at most what that set doesn't
publish.  So a pair must share as many published shingles as its required overlap exceeds the larger unpublished rest, and never fewer than the smaller l.

Only components are wanted, so no group has all its pairs formed unasked.  Equal sets are one node.  Shingles of few nodes give all
their pairs; those of many give a chain and stars around the nodes that have fewest shingles of their own.  Verified links join nodes into
components.  Then the shingles of many nodes give the pairs across components that are left, so every pair that the prefixes admit is
either verified or already connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .components import components
from .repeats import keyed, shards_for
from .store import store

SKETCH_BITS = 23
SLICES = 64
#: Nodes of a shingle from which on it gives a chain and stars first; its other pairs follow, so nothing is lost.
MANY = 24
#: Stars of a shingle of many nodes, in each band of sizes.
STARS = 3
LONGEST = 4
#: Most bits of a parity mark, and most members of a set that has one.
MARK_BITS = 4096
#: Cost of verifying a pair, in postings.
VERIFY = 12.0
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_FLUSH = 12 << 20
Sets = Callable[[str | None], np.ndarray]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles, A-Z lower-cased; of fewer words, of the whole sequence."""
    data = A.as_bytes(text).translate(_LOWER)
    buf = np.frombuffer(data, dtype=np.uint8)
    words = A.word_hashes(buf, *A.word_bounds(buf))
    return np.unique(A.gram_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, A.U64)


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set; of the empty one 0."""
    return int(A.gram_hashes(shingles, len(shingles)).astype(np.int64)[0]) if len(shingles) else 0


def required(size: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of that size with any set that is alike enough."""
    return -(-percent * size // 100)


def _sets_out(sets: Sets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
        seen: set[int] = set()
        task = TaskContext.get().partitionId()  # type: ignore[union-attr]
        for batch in (part for whole in batches for part in A.slices(whole)):
            nodes, sizes = [], []
            for text in batch.column("text").to_pylist():
                shingles = sets(text)
                nodes.append(set_hash(shingles))
                sizes.append(len(shingles))
                if nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    slots = (shingles >> A.U64(64 - SKETCH_BITS)).astype(np.int64)
                    counts[slots] += counts[slots] < 65535
            none = [None] * len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=["k", "h", "node", "size", "slice", "part", "counts"])
        for i, part in enumerate(np.split(counts, SLICES) if counts.any() else []):
            yield pa.RecordBatch.from_arrays([*[pa.array([None], pa.int64())] * 4, pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["k", "h", "node", "size", "slice", "part", "counts"])

    return run


_TREE = 64  # sketches of a slice that are added in one task


def _total(table: pa.Table) -> np.ndarray:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, dtype=np.uint64)
    for blob in table.column("counts").to_pylist():
        total += np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * len(total) else np.uint32)
    return np.minimum(total, 2**32 - 1)


def _added(table: pa.Table) -> pa.Table:
    """Of a slice, the sum of some tasks' sketches."""
    return pa.table({"slice": table.column("slice").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // _TREE], pa.int32()), "counts": pa.array([_total(table).astype(np.uint32).tobytes()], pa.binary())})


def _levels(table: pa.Table) -> pa.Table:
    """Twice the logarithm of a slice's total counts, and their sum."""
    levels = np.floor(2 * np.log2(_total(table).astype(np.float64) + 1)).astype(np.uint8)
    return pa.table({"slice": table.column("slice").slice(0, 1).cast(pa.int32()), "levels": pa.array([levels.tobytes()], pa.binary())})


def _frequencies(sketches: DataFrame) -> np.ndarray:
    """Levels of the counts of all tasks' sketches, added as a tree: no task adds more than some dozens."""
    most = sketches.agg(F.max("part")).first()[0] or 0
    while most >= _TREE:
        sketches = sketches.groupBy("slice", F.floor(F.col("part") / _TREE)).applyInArrow(_added, "slice int, part int, counts binary")
        most //= _TREE
    levels = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), dtype=np.uint8)
    # The sketch has a fixed size: 8 MB
    for row in sketches.groupBy("slice").applyInArrow(_levels, "slice int, levels binary").collect():
        levels[row["slice"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return levels.ravel()


def prefix(shingles: np.ndarray, levels: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The published prefix of a set in the global order, and its l."""
    size = len(shingles)
    need = int(required(size, percent))
    level = levels[(shingles >> A.U64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((shingles, level))[: size - need + min(LONGEST, need)]
    cost = np.cumsum(np.maximum(2.0 ** (level[order] / 2.0) - noise, 1.0))
    choices = np.arange(1, min(LONGEST, need) + 1)
    postings = cost[size - need + choices - 1]
    chosen = int(choices[np.argmin(postings + VERIFY * postings / choices)])
    return shingles[order[: size - need + chosen]], chosen


def _postings_out(sets: Sets, percent: int, levels: np.ndarray, noise: float, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: dict[int, tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        tokens = np.concatenate([x[0] for x in held.values()])
        times = [len(x[0]) for x in held.values()]
        place = np.concatenate([np.arange(t, dtype=np.uint32) for t in times])
        node = np.repeat(np.fromiter(held, np.int64), times)
        size = np.repeat(np.array([x[1] for x in held.values()], dtype=np.uint32), times)
        least = np.repeat(np.array([x[2] for x in held.values()], dtype=np.uint8), times)
        order, first, count = A.by_key((tokens % A.U64(shards)).astype(np.int64))
        tokens, node, size, least, place = tokens[order], node[order], size[order], least[order], place[order]
        cuts = list(zip(first.tolist(), (first + count).tolist(), strict=True))  # of the shards that are there
        return pa.RecordBatch.from_arrays(
            [pa.array((tokens[first] % A.U64(shards)).astype(np.int32)), *[pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (tokens, node, size, least, place)]],
            names=["shard", "tokens", "nodes", "sizes", "least", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int, int]] = {}
        used = 0
        for batch in (part for whole in batches for part in A.slices(whole)):
            for text in batch.column("text").to_pylist():
                shingles = sets(text)
                node = set_hash(shingles)
                if not len(shingles) or node in held:
                    continue
                tokens, chosen = prefix(shingles, levels, noise, percent)
                held[node] = (tokens, len(shingles), chosen)
                used += 25 * len(tokens)
                if used >= _FLUSH:
                    yield flush(held)
                    held, used = {}, 0
        if held:
            yield flush(held)

    return run


_GROUPS = "shard int, tokens binary, nodes binary, sizes binary, least binary, places binary"
_PACKED = (("nodes", np.int64), ("sizes", np.uint32), ("least", np.uint8), ("places", np.uint32))


def _groups(table: pa.Table) -> pa.Table:
    """Of one shard, the postings of the shingles that several nodes have, in order of shingle, size and node."""
    key = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()])
    node, size, least, place = (np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(c).to_pylist()]) for c, kind in _PACKED)
    order = np.lexsort((node, size, key))
    key, node, size, least, place = key[order], node[order], size[order], least[order], place[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, size, least, place = key[new], node[new], size[new], least[new], place[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    several = np.repeat(np.diff(np.concatenate([first, [len(key)]])) > 1, np.diff(np.concatenate([first, [len(key)]])))
    shard = table.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int32()), **{c: pa.array([x[several].tobytes()], pa.binary()) for c, x in (("tokens", key), ("nodes", node), ("sizes", size), ("least", least), ("places", place))}})


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    key, node, size, least, place = (np.frombuffer(row[c], dtype=kind) for c, kind in (("tokens", np.uint64), *_PACKED))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key, node, size, least, place, first, np.diff(np.concatenate([first, [len(key)]]))


_PAIRS = "a long, b long, shared long, least int"


def _counted(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """Pairs of one shard, each once, with how often they come."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high, least = low[order], high[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
    shared = np.diff(np.concatenate([first, [len(low)]]))
    return pa.RecordBatch.from_arrays([pa.array(low[first]), pa.array(high[first]), pa.array(shared.astype(np.int64)), pa.array(least[first].astype(np.int32))], names=["a", "b", "shared", "least"])


def _close(size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow two sets to be alike enough."""
    return 100 * np.minimum(size_a, size_b).astype(np.int64) >= percent * np.maximum(size_a, size_b).astype(np.int64)


def wanted(size_a: np.ndarray, size_b: np.ndarray, least_a: np.ndarray, least_b: np.ndarray, percent: int) -> np.ndarray:
    """Published shingles that two sets must share, from their sizes and their l."""
    size_a, size_b, least_a, least_b = (x.astype(np.int64) for x in (size_a, size_b, least_a, least_b))
    overlap = -(-percent * (size_a + size_b) // (100 + percent))
    rest = np.maximum(required(size_a, percent) - least_a, required(size_b, percent) - least_b)
    return np.maximum(overlap - rest, np.minimum(least_a, least_b))


def _few_pairs(percent: int, many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All pairs of the shingles of few nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, node, size, least, _, first, count = _unpacked(row)
                left = []
                for step in range(1, many):  # neighbours at each distance
                    ok = (count > step) & (count < many)
                    i = np.repeat(first[ok], count[ok] - step) + A.ramp(count[ok] - step)
                    left.append(np.stack([i, i + step]))
                x, y = np.concatenate(left, axis=1)
                keep = _close(size[x], size[y], percent) & (node[x] != node[y])
                x, y = x[keep], y[keep]
                yield _counted(node[x], node[y], wanted(size[x], size[y], least[x], least[y], percent))

    return run


def _stars(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one shingle, a chain by size, and pairs with those nodes of the same and the next smaller band of sizes that have fewest shingles of their own."""

    def run(table: pa.Table) -> pa.Table:
        node, size, least, own = (table.column(c).to_numpy() for c in ("node", "size", "least", "own"))
        order = np.lexsort((node, size))
        node, size, least, own = node[order], size[order], least[order], own[order]
        band = np.floor(np.log(np.maximum(size, 1)) / np.log(100.0 / percent)).astype(np.int64)
        x, y = [np.arange(len(node) - 1)], [np.arange(1, len(node))]
        for b in np.unique(band).tolist():
            members = np.flatnonzero(band == b)
            for hub in members[np.lexsort((node[members], own[members]))[:STARS]].tolist():
                near = np.flatnonzero((band == b) | (band == b + 1))
                x.append(np.full(len(near), hub))
                y.append(near)
        i, j = np.concatenate(x), np.concatenate(y)
        keep = (i != j) & _close(size[i], size[j], percent)
        i, j = i[keep], j[keep]
        return pa.Table.from_batches([_counted(node[i], node[j], wanted(size[i], size[j], least[i], least[j], percent))])

    return run


_SHARED = "token long, node long, size long, least int, place long"


def _shared(many: int, crowded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of the shingles of several nodes, one row each: of those of many nodes, or of the others, with null for the shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                key, node, size, least, place, _, count = _unpacked(row)
                on = np.repeat((count >= many) == crowded, count)
                token = pa.array(key[on].astype(np.int64)) if crowded else pa.nulls(int(on.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([token, pa.array(node[on]), pa.array(size[on].astype(np.int64)), pa.array(least[on].astype(np.int32)), pa.array(place[on].astype(np.int64))], names=["token", "node", "size", "least", "place"])

    return run


def parity_mark(shingles: np.ndarray) -> bytes:
    """Parity of a set's members in each of a power of two of slots, as bits; empty for sets too large to tell apart so.

    Slots where two marks differ are at most as many as the members that only one of the two sets has.
    """
    if len(shingles) > MARK_BITS:
        return b""
    bits = min(MARK_BITS, max(512, 1 << (4 * len(shingles) - 1).bit_length()))
    slots = ((shingles >> A.U64(16)) & A.U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits).astype(np.uint8) & 1).tobytes()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in A.slices(whole)):
        marks = [parity_mark(np.frombuffer(x, dtype=A.U64)) for x in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(marks, pa.binary())], names=["node", "mark"])


class _Marks:
    """Parity marks of some nodes, folded to each width that one of them has."""

    def __init__(self, marks: list[bytes]) -> None:
        self.width = np.array([len(m) for m in marks], dtype=np.int64)
        self.folded: dict[int, np.ndarray] = {}
        for width in np.unique(self.width[self.width > 0]).tolist():
            rows = np.zeros((len(marks), width // 8), dtype=A.U64)
            for i, mark in enumerate(marks):
                if len(mark) >= width:
                    rows[i] = np.bitwise_xor.reduce(np.frombuffer(mark, dtype=A.U64).reshape(-1, width // 8), axis=0)
            self.folded[width] = rows

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        """Least number of members that only one of two sets has, of set i and each of others."""
        out = np.zeros(len(others), dtype=np.int64)
        width = np.minimum(self.width[i], self.width[others])
        for w in np.unique(width[width > 0]).tolist():
            at = width == w
            out[at] = np.bitwise_count(self.folded[w][others[at]] ^ self.folded[w][i]).sum(axis=1)
        return out


def _across(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one shingle, the pairs of nodes of different components that may be alike enough.

    Published shingles before this one that no other node publishes are in neither of two sets that both publish this one: those of
    one node bound the overlap with any other.  Parity marks bound it, too.
    """

    def run(table: pa.Table) -> pa.Table:
        node, size, least, alone, root = (table.column(c).to_numpy() for c in ("node", "size", "least", "alone", "root"))
        _, of, count = np.unique(root, return_inverse=True, return_counts=True)
        order = np.argsort(count[of] * (len(count) + 1) + of, kind="stable")
        node, size, least, of = node[order], size[order], least[order], of[order]
        most = size - alone[order]
        marks = _Marks(table.column("mark").take(pa.array(order)).to_pylist())
        ends = np.flatnonzero(np.concatenate([of[1:] != of[:-1], [True]])) + 1 if len(of) else np.zeros(0, np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        start = 0
        for end in ends[:-1].tolist():  # all but the largest component, each with those that follow
            for i in range(start, end):
                j = np.arange(end, len(node))
                j = j[(100 + percent) * np.minimum(most[i], most[j]) >= percent * (size[i] + size[j])]
                j = j[(100 + percent) * (size[i] + size[j] - marks.apart(i, j)) >= 2 * percent * (size[i] + size[j])]
                left.append(np.full(len(j), i))
                right.append(j)
            start = end
        i, j = np.concatenate(left), np.concatenate(right)
        return pa.Table.from_batches([_counted(node[i], node[j], wanted(size[i], size[j], least[i], least[j], percent))])

    return run


def _blobs(make: Sets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in A.slices(whole)):
            sets = [make(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])

    return run


def _alike(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in A.slices(whole)):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                u, v = np.frombuffer(x, dtype=A.U64), np.frombuffer(y, dtype=A.U64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def links(docs: DataFrame, percent: int = 80, n: int = 5, sets: Sets | None = None, many: int = MANY, bytes_per_shard: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(k, h, node, size) of every row of docs, and verified links (a, b) between nodes whose components are those of all links."""
    docs, make = keyed(docs), sets or partial(shingle_set, n=n)
    found = store(docs.mapInArrow(_sets_out(make), "k long, h long, node long, size long, slice int, part int, counts binary"))
    nodes = found.filter(F.col("slice").isNull()).select("k", "h", "node", "size")
    levels = _frequencies(found.filter(F.col("slice").isNotNull()).select("slice", "part", "counts"))
    noise = float(np.median(2.0 ** (levels / 2.0)))
    shards = shards_for(docs, bytes_per_shard)
    postings = docs.mapInArrow(_postings_out(make, percent, levels, noise, shards), _GROUPS)
    groups = store(postings.groupBy("shard").applyInArrow(_groups, _GROUPS))

    def summed(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))

    few = store(summed(groups.mapInArrow(_few_pairs(percent, many), _PAIRS)))
    enough = F.col("shared") >= F.col("least")
    crowded = groups.mapInArrow(_shared(many, True), _SHARED)
    others = groups.mapInArrow(_shared(many, False), _SHARED).join(crowded.select("node").distinct(), "node", "left_semi").select("token", "node", "size", "least", "place")
    ahead, whole = Window.partitionBy("node").orderBy("place"), Window.partitionBy("node")
    published = F.col("size") - F.ceil(F.col("size") * percent / 100) + F.col("least")
    ranked = crowded.unionByName(others).withColumns({"own": published - F.count(F.lit(1)).over(whole), "alone": F.col("place") - F.row_number().over(ahead) + 1})
    crowded = store(ranked.filter(F.col("token").isNotNull()).drop("place"))
    stars = crowded.groupBy("token").applyInArrow(_stars(percent), _PAIRS)
    chosen = store(few.filter(enough).select("a", "b").unionByName(stars.select("a", "b")).distinct())

    # The sets of all nodes that may still be compared
    wanted = chosen.select(F.col("a").alias("node")).unionByName(chosen.select(F.col("b").alias("node"))).unionByName(crowded.select("node")).distinct()
    owners = nodes.groupBy("node").agg(F.min(F.struct("k", "h")).alias("of")).join(wanted, "node", "left_semi").select("of.*")
    kept = store(docs.join(owners, ["k", "h"], "left_semi").mapInArrow(_blobs(make), "node long, shingles binary").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = kept.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = kept.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return store(pairs.join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").select("a", "b", "x", "y").mapInArrow(_alike(percent), "a long, b long"))

    sure = verified(chosen)
    if crowded.isEmpty():
        return nodes, sure
    roots = components(sure)
    known = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = known.groupBy("token").agg((F.min("root") < F.max("root")).alias("mixed")).filter("mixed").select("token")
    open_ = store(known.join(several, "token", "left_semi"))
    marks = kept.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_marks, "node long, mark binary")
    more = open_.join(marks, "node").groupBy("token").applyInArrow(_across(percent), _PAIRS)
    rest = summed(summed(more).unionByName(few.filter(~enough))).filter(enough).select("a", "b").join(chosen, ["a", "b"], "left_anti")
    return nodes, sure.unionByName(verified(rest))


def classes(docs: DataFrame, percent: int = 80, n: int = 5, sets: Sets | None = None, many: int = MANY) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs: the least doc_id that links of likeness percent or more reach.

    Words are lower-cased in A-Z only.  A null, empty or blank text has no shingles and is linked with nothing; a text of fewer than n
    words is one shingle.  Rows of one doc_id count as one document of several texts only where these are linked.  A null doc_id is the least of all
    and, as a component, null.  Other columns are ignored.  sets: another way to make a text's sorted set of 64-bit hashes.
    """
    nodes, edges = links(docs, percent, n, sets, many)
    roots = components(edges)
    least = nodes.filter(F.col("size") > 0).groupBy("node").agg(F.min("k").alias("k")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tops = least.groupBy("root").agg(F.min("k").alias("component_id"))
    named = least.join(tops, "root").select(F.col("node").alias("_node"), "component_id")
    got = nodes.join(named, (F.col("node") == F.col("_node")) & (F.col("size") > 0), "left")
    null = F.lit(-(2**63))
    return got.select(
        F.when(F.col("k") != null, F.col("k")).alias("doc_id"), F.col("size").alias("n_shingles"),
        F.when(F.coalesce("component_id", "k") != null, F.coalesce("component_id", "k")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """Of each component that links form, the row of least doc_id; and every text that is linked with nothing.

    Rows are one only if they are equal in doc_id and text, or linked.  Of equal rows the least of their other columns stays, and of linked texts
    of one doc_id that of least hash, so the choice is the same in every run.
    """
    nodes, edges = links(docs, percent, n)
    some = nodes.filter(F.col("size") > 0).join(components(edges), "node", "left")
    first = some.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("k", "h")).alias("of")).select(F.col("of.k").alias("_k"), F.col("of.h").alias("_h"))
    alone = nodes.filter(F.col("size") == 0).select(F.col("k").alias("_k"), F.col("h").alias("_h"))
    k, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("*", k.alias("_k"), F.xxhash64(text).alias("_h")).join(first.unionByName(alone).distinct(), ["_k", "_h"], "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    equal = Window.partitionBy("_k", "_h", "text").orderBy(*others)
    return rows.withColumn("_at", F.row_number().over(equal)).filter("_at = 1").select(*docs.columns)
