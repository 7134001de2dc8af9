"""The prefix trie of conversations by external mergesort with common prefixes.

A turn is its digest (of role and text, with their lengths) and the bytes of its text; a conversation is the sequence of its turns.  Spark
sorts conversations into ranges by sequence, then id, so that copies of one conversation spread over ranges too.  In a range each batch
is a run, sorted, with the common prefix of each conversation and the one before it; a tournament of losers merges the runs and compares
only turns behind the prefixes it knows.  The merged stream opens and closes nodes on a stack of the current path.

All figures of a node are sums over ranges but for what neighbouring ranges share: a node on a range's first or last path may go on in
others.  Those nodes, at most two paths a range, are given as parts; each range's first and last sequence tells, from one range to the
next, how many nodes were counted twice and whether the last conversation is a leaf, and the parts are corrected and added by node.
Nodes below them take their parent's least id from a table with a row for each range.

The ids that end at a node are hashed in their order; only those at nodes which ranges share go to the task of their node, as blocks of
text, which it streams through the hash.  One SHA-256 over all ids of a hot conversation can't be split, but its memory is one block.

A range holds about ``range_bytes`` bytes of sequences (24 a turn); one conversation's turns must fit into a task.  Null roles and texts are empty; turns
are ordered by number, null first, then by role and text, and equal turns each count.  Rows without conv_id belong to no conversation.
An empty table has no nodes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import store

DIGEST = 16
#: Ids of one node that are one row of text.
IDS_A_BLOCK = 4096
Item = tuple[bytes, int, bytes]


def _turns(conversations: DataFrame, family: int) -> DataFrame:
    """Digest and bytes of each turn, in order within the conversations that share a first one."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    placed = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    return placed.select("conv_id", "base", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"), F.octet_length("text").alias("bytes"))


def _rebuilt(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each conversation with its first h turns taken from its family's first one, h = crc32(decimal id) % most."""

    def made(conv: int, base: int, own: list[tuple[bytes, int]], head: list[tuple[bytes, int]]) -> tuple[int, bytes, bytes]:
        h = zlib.crc32(str(conv).encode()) % most
        turns = [*head[:h], *own[h:]]
        return conv, b"".join(d for d, _ in turns), np.array([n for _, n in turns], dtype=np.int64).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple[int, int] | None = None
        own: list[tuple[bytes, int]] = []
        head: list[tuple[bytes, int]] = []
        family: int | None = None
        out: list[tuple[int, bytes, bytes]] = []
        held = 0

        def close() -> None:
            nonlocal head, family, held
            if current is None:
                return
            conv, base = current
            if family != base:
                family, head = base, own[:most] if conv == base else []
            out.append(made(conv, base, own, head))
            held += len(out[-1][1])

        for batch in batches:
            for conv, base, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "base", "digest", "bytes")), strict=True):
                if current != (conv, base):
                    close()
                    current, own = (conv, base), []
                own.append((digest, size))
                if held >= 1 << 20:
                    yield _sequences(out)
                    out, held = [], 0
        close()
        yield _sequences(out)

    return run


def _sequences(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["conv_id", "seq", "sizes"])


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two sequences share at their start, of which some are known to be shared."""
    most = min(len(a), len(b)) // DIGEST
    step = 1
    while known < most:
        end = min(most, known + step)
        if a[known * DIGEST : end * DIGEST] == b[known * DIGEST : end * DIGEST]:
            known, step = end, 2 * step
        elif step == 1:
            return known
        else:
            most, step = end - 1, 1  # one of these differs, or the last one does
    return known


class Run:
    """A sorted run: conversations, and of each the turns it shares with the one before it."""

    def __init__(self, items: list[Item]):
        self.items = sorted(items)
        self.shared = [0, *[common(a[0], b[0]) for a, b in zip(self.items, self.items[1:], strict=False)]]


class Merge:
    """A tournament of losers over runs; each loser keeps what it shares with the winner that beat it."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.at = [0] * len(runs)
        #: Of each run's next conversation, the turns that it shares with the last one given out, or, as a loser, with its winner.
        self.shared = [0] * len(runs)
        self.compared = 0
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.loser: list[int] = [-1] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            k = node - self.size
            return k if k < len(self.runs) and self.runs[k].items else -1
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.loser[node] = self._match(a, b)
        return winner

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser.  Both know what they share with the same conversation: who shares more is less, and only equals are compared."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        shared = self.shared
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = self.runs[a].items[self.at[a]], self.runs[b].items[self.at[b]]
        n = common(x[0], y[0], shared[a])
        self.compared += n - shared[a] + 1
        u, v = x[0][n * DIGEST : (n + 1) * DIGEST], y[0][n * DIGEST : (n + 1) * DIGEST]
        winner, loser = (a, b) if (u, x[1]) <= (v, y[1]) else (b, a)
        shared[loser] = n
        return winner, loser

    def __iter__(self) -> Iterator[tuple[Item, int]]:
        """Conversations in order, with the turns each shares with the one before it."""
        while self.winner >= 0:
            k = self.winner
            yield self.runs[k].items[self.at[k]], self.shared[k]
            self.at[k] += 1
            done = self.at[k] == len(self.runs[k].items)
            if not done:
                self.shared[k] = self.runs[k].shared[self.at[k]]
            best, node = (-1 if done else k), (k + self.size) // 2
            while node:
                best, self.loser[node] = self._match(best, self.loser[node])
                node //= 2
            self.winner = best


#: Rows of a range: whole nodes and nodes on its first path (1), its last (2) or both (3), then blocks of ids and the range's own row.
NODE, FIRST, LAST, IDS, RANGE = 0, 1, 2, 4, 8
_COLUMNS = (
    "kind int, range int, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, up int, parent long, "
    "node binary, above binary, block long, ids binary, first binary, last binary, sums array<long>"
)
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_FIELDS = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in _COLUMNS.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _FIELDS], schema=_FIELDS)


class _Node:
    """An open node.  Whole children are kept till it closes, as its least id is known only then."""

    __slots__ = ("children", "first", "ids", "least", "leaves", "n", "saved", "size", "waiting")

    def __init__(self, size: int, first: bool):
        self.n = self.children = self.leaves = self.saved = 0
        self.size, self.first, self.least = size, first, 2**63 - 1
        self.ids: list[int] = []
        self.waiting: list[dict] = []


class Path:
    """The stack of open nodes of a range; rows are finished nodes and blocks of ids."""

    def __init__(self, number: int):
        self.number = number
        self.open: list[_Node] = []
        self.rows: list[dict] = []
        self.first: bytes | None = None
        self.last = b""
        self.sums: list[int] = []

    def add(self, seq: bytes, conv: int, sizes: list[int], shared: int) -> None:
        """The next conversation in order, and the turns that it shares with the one before it."""
        begins = self.first is None
        if begins:
            self.first, self.sums = seq, np.cumsum([0, *sizes]).tolist()
        else:
            if shared < len(self.last) // DIGEST:
                self.open[-1].leaves += 1
            while len(self.open) > shared + 1:
                self._close(False)
        for d in range(len(self.open), len(sizes) + 1):
            self.open.append(_Node(sizes[d - 1] if d else 0, begins))
        node = self.open[-1]
        node.n += 1
        node.least = min(node.least, conv)
        node.ids.append(conv)
        self.last = seq

    def end(self) -> None:
        """All nodes that are still open belong to the last path."""
        while self.open:
            self._close(True)
        self.rows.append({"kind": RANGE, "range": self.number, "first": self.first, "last": self.last, "sums": self.sums})

    def _name(self, depth: int) -> bytes:
        return hashlib.md5(self.last[: depth * DIGEST]).digest()

    def _close(self, ends: bool) -> None:
        node = self.open.pop()
        depth = len(self.open)
        node.saved += (node.n - 1) * node.size
        kind = FIRST * node.first + LAST * ends
        row = {
            "kind": kind, "range": self.number, "depth": depth, "conv_id": node.least, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved": node.saved, "up": 0,
        }
        for child in node.waiting:
            child["up" if kind else "parent"] = kind or node.least
        self.rows += node.waiting
        if kind:
            row |= {"node": self._name(depth), "above": self._name(depth - 1) if depth else None}
            for at in range(0, len(node.ids), IDS_A_BLOCK):
                text = ",".join(map(str, node.ids[at : at + IDS_A_BLOCK])).encode()
                self.rows.append({"kind": IDS, "range": self.number, "node": row["node"], "block": at, "ids": text})
            self.rows.append(row)
        else:
            row["ends"] = hashlib.sha256(",".join(map(str, node.ids)).encode()).hexdigest()
            self.open[-1].waiting.append(row)
        if self.open:
            up = self.open[-1]
            up.n += node.n
            up.least = min(up.least, node.least)
            up.leaves += node.leaves
            up.saved += node.saved
            up.children += 1


def _nodes(run_items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one range: its runs sorted, merged and walked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Run] = []
        held: list[Item] = []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("seq", "conv_id", "sizes")), strict=True)
            while len(held) >= run_items:
                runs.append(Run(held[:run_items]))
                held = held[run_items:]
        if held:
            runs.append(Run(held))
        if not runs:
            return
        path = Path(TaskContext.get().partitionId())
        for (seq, conv, sizes), shared in Merge(runs):
            path.add(seq, conv, np.frombuffer(sizes, dtype=np.int64).tolist(), shared)
            if len(path.rows) >= 4096:
                yield _batch(path.rows)
                path.rows = []
        path.end()
        for at in range(0, len(path.rows), 4096):
            yield _batch(path.rows[at : at + 4096])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, whose blocks come in order."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        names, hashes = [], []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    names.append(node)
                    hashes.append(digest.hexdigest())
                node, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids)
        yield _hashed(names, hashes)
    if node is not None:
        yield _hashed([node], [digest.hexdigest()])


def _hashed(names: list[bytes], hashes: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], names=["node", "ends"])


def _shared_before(rows: DataFrame) -> DataFrame:
    """Of each range: the turns that its first sequence shares with the last one before it (-1 if none is), and whether its last one is a leaf.

    One row a range; the window over them sees as many rows as there are ranges.
    """
    order = Window.orderBy("range")
    both = rows.filter(F.col("kind") == RANGE).select("range", "first", "last", "sums", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, first, last, before, after in zip(*(batch.column(c).to_pylist() for c in ("range", "first", "last", "before", "after")), strict=True):
                out.append((number, -1 if before is None else common(before, first), after is None or common(last, after) < len(last) // DIGEST))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_()), batch.column("sums")], names=["range", "again", "leaf", "sums"],
            )

    return both.mapInArrow(run, "range int, again long, leaf boolean, sums array<long>")


def sequences(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation as conv_id, seq (digests of its turns) and sizes (bytes of their texts), rebuilt with the start of its family's first one."""
    return _turns(conversations, family).mapInArrow(_rebuilt(most), "conv_id long, seq binary, sizes binary")


def nodes(seqs: DataFrame, range_bytes: int = 4 << 20, run_items: int = 4096) -> DataFrame:
    """All nodes of the trie of sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends (SHA-256 of the ids that end there)."""
    spark = seqs.sparkSession
    seqs = store(seqs)
    total = seqs.agg(F.sum(F.octet_length("seq") + F.octet_length("sizes") + 32)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // range_bytes))
    rows = store(seqs.repartitionByRange(ranges, "seq", "conv_id").mapInArrow(_nodes(run_items), _COLUMNS))
    borders = _shared_before(rows)
    parts = rows.filter(F.col("kind").isin(FIRST, LAST, FIRST | LAST)).drop("sums").join(borders, "range")
    again = (F.col("kind").bitwiseAND(FIRST) > 0) & (F.col("depth") <= F.col("again"))
    saved_before = F.when(F.col("depth") > 0, F.element_at("sums", F.col("depth").cast("int"))).otherwise(0)
    twice = F.when(again, F.element_at("sums", F.col("again").cast("int") + 1) - saved_before).otherwise(0)
    ended = (F.col("leaf") & (F.col("kind").bitwiseAND(LAST) > 0)).cast("long")
    merged = parts.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum(F.col("n_children") - (again & (F.col("depth") < F.col("again"))).cast("long")).alias("n_children"), F.sum(F.col("n_leaves") + ended).alias("n_leaves"), F.sum(F.col("saved") + twice).alias("saved"),
    )
    merged = store(merged)
    ids = rows.filter(F.col("kind") == IDS).select("node", "range", "block", "ids").repartition("node").sortWithinPartitions("node", "range", "block")
    ends = ids.select("node", "ids").mapInArrow(_digests, "node binary, ends string")
    above = merged.select(F.col("node").alias("above"), F.col("conv_id").alias("parent"))
    border = merged.join(ends, "node", "left").join(above, "above", "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    whole = rows.filter(F.col("kind") == NODE)
    # A whole node under a shared one finds its parent by range and path, so that the children of one parent stay in their ranges
    shared = rows.filter(F.col("kind").isin(FIRST, LAST, FIRST | LAST)).select("range", F.col("kind").alias("up"), (F.col("depth") + 1).alias("depth"), "node")
    known = shared.join(merged.select("node", F.col("conv_id").alias("least")), "node").drop("node")
    under = whole.filter(F.col("up") > 0).join(known, ["range", "up", "depth"]).withColumn("parent", F.col("least"))
    columns = ("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends")
    return whole.filter(F.col("up") == 0).select(*columns).unionByName(under.select(*columns)).unionByName(border.select(*columns))


#: The contract in SQL: every prefix of every rebuilt conversation as a list, and sums over all prefixes of a prefix.
ORACLE = """
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
own AS (SELECT conv_id AS c, list({'role': r, 'text': x} ORDER BY turn NULLS FIRST, r, x) AS turns FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
heads AS (SELECT c, turns, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h FROM own, crc),
rebuilt AS MATERIALIZED (SELECT a.c, coalesce(b.turns[1 : a.h], []) || coalesce(a.turns[a.h + 1 :], []) AS turns FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt),
nodes AS MATERIALIZED (SELECT turns[1 : d] AS path, d, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(turns) = d) AS ids FROM prefixes GROUP BY path, d),
children AS (SELECT path[1 : d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT x.*, coalesce(y.n, 0) AS n_children FROM nodes x LEFT JOIN children y USING (path, d)),
subtree AS (SELECT path[1 : e] AS path, e AS d, sum((n - 1) * CASE WHEN d > 0 THEN octet_length(encode(path[d].text)) ELSE 0 END) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM full_nodes) GROUP BY ALL)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM full_nodes x JOIN subtree s USING (path, d) LEFT JOIN nodes p ON p.d = x.d - 1 AND p.path = x.path[1 : x.d - 1]
"""
