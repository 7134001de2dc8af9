"""Vector code compression: product codebooks fitted by Lloyd rounds whose scans Yinyang bounds cut short.

A vector becomes integers, floor(scale * x), and is cut into equal parts; each part position has its own codebook.  The entries of a
codebook are clustered into groups once.  A row keeps, for each part, its entry and one lower bound for each group: no other entry of the
group is nearer.  In a round the bounds sink by how far the group's entries moved, and only groups whose bound doesn't exceed the distance
to the own entry are scanned.  Distances are whole numbers and compared as such, so ties go to the lower index exactly.

Each round is one pass of ``mapInArrow`` over rows that hold their integers, codes and bounds; it gives the rows for the next round and, for
each task, sums by entry, which Spark adds up.  The rows are a stored table, and the one before goes when the next is written.  To the
driver come codebooks only: parts x entries x width numbers, whatever the input.

Rows go whose vector is null, holds a null or non-finite component, has another length than most vectors have (ties: the longer) or a
component outside +-2**26 / scale, whose squares would leave 64-bit sums.  Lengths that the parts don't divide are filled up with zeros.
Null ids count as the greatest; rows of one id are ordered by their components.  With fewer kept vectors than entries the codebook has
as many entries as there are vectors; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, store

LIMIT = 1 << 26
_CAP = np.iinfo(np.uint16).max


@dataclass(frozen=True)
class Shape:
    """How vectors are cut: their length, the number of parts, and the factor before rounding down."""

    length: int
    parts: int
    scale: int

    @property
    def width(self) -> int:
        return max(1, -(-self.length // self.parts))

    def integers(self, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors are kept, and their integers by part."""
        lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(lengths == self.length)
        flat = vectors.take(pa.array(at)).flatten()
        x = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * self.scale).reshape(len(at), self.length)
        good = (np.abs(x) <= LIMIT).all(axis=1)  # nor does a number that isn't one pass this
        whole = np.zeros((int(good.sum()), self.parts * self.width), dtype=np.int64)
        whole[:, : self.length] = x[good]
        return at[good], whole.reshape(-1, self.parts, self.width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries: by floating-point products where all sums stay whole numbers there."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def _root(squares: np.ndarray) -> np.ndarray:
    """Whole roots, never above the true ones, cut at what a bound can hold."""
    r = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    r -= r * r > squares
    return np.minimum(r, _CAP)


def groups_of(entries: np.ndarray, count: int) -> np.ndarray:
    """A group number for each entry, by a few rounds of clustering from evenly spaced entries."""
    centres = entries[np.linspace(0, len(entries) - 1, min(count, len(entries))).astype(int)].astype(np.float64)
    of = np.zeros(len(entries), dtype=np.int64)
    for _ in range(5):
        of = ((entries[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(of):
            centres[g] = entries[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


@dataclass
class Codebook:
    """One part's entries, their groups, and how far at most the entries of each group moved in the last update."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @property
    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.groups == g) for g in range(len(self.drift))]

    def moved(self, entries: np.ndarray) -> Codebook:
        squares = ((entries - self.entries) ** 2).sum(axis=1)
        far = _up(squares)
        return Codebook(entries, self.groups, np.array([far[m].max(initial=0) for m in self.members], dtype=np.int64))

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entries by a scan of all, squared distances, and bounds."""
        d = distances(x, self.entries)
        code = d.argmin(axis=1)
        rows = np.arange(len(x))
        error = d[rows, code]
        d[rows, code] = np.iinfo(np.int64).max
        bounds = np.stack([_root(d[:, m].min(axis=1)) for m in self.members], axis=1)
        return code, error, bounds

    def next(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the round before; last, how many groups were scanned."""
        own = ((x - self.entries[code]) ** 2).sum(axis=1)
        bounds = np.maximum(bounds.astype(np.int64) - self.drift, 0)
        open_ = bounds * bounds <= own[:, None]
        best, error = code.copy(), own.copy()
        seen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for g, m in enumerate(self.members):
            rows = np.flatnonzero(open_[:, g])
            if not len(rows):
                continue
            d = distances(x[rows], self.entries[m])
            at = d.argmin(axis=1)
            low = d[np.arange(len(rows)), at]
            d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
            seen.append((g, rows, m[at], low, d.min(axis=1)))
            better = (low < error[rows]) | ((low == error[rows]) & (m[at] < best[rows]))
            best[rows[better]], error[rows[better]] = m[at][better], low[better]
        for g, rows, who, low, after in seen:
            bounds[rows, g] = _root(np.where(best[rows] == who, after, low))
        left = np.flatnonzero((best != code) & ~open_[np.arange(len(x)), self.groups[code]])
        old = self.groups[code[left]]
        bounds[left, old] = np.minimum(bounds[left, old], _root(own[left]))
        return best, error, bounds, int(open_.sum())


def _up(squares: np.ndarray) -> np.ndarray:
    """Whole roots, never below the true ones."""
    r = np.ceil(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return r + (r * r < squares)


def _smallest(shape: Shape, entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each task the kept vectors of smallest id, as many as a codebook takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blank, whole = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, shape.parts * shape.width), np.int64)
        for batch in batches:
            at, x = shape.integers(batch.column("vector"))
            column = batch.column("vec_id").take(pa.array(at))
            ids = np.concatenate([ids, column.fill_null(0).to_numpy(zero_copy_only=False)])
            blank = np.concatenate([blank, column.is_null().to_numpy(zero_copy_only=False)])
            whole = np.concatenate([whole, x.reshape(len(at), shape.parts * shape.width)])
            if len(ids) > entries:
                order = np.lexsort((ids, blank))
                last = order[entries - 1]
                near = np.flatnonzero((blank < blank[last]) | ((blank == blank[last]) & (ids <= ids[last])))
                if len(near) > entries:
                    near = near[np.lexsort((*whole[near].T[::-1], ids[near], blank[near]))[:entries]]
                ids, blank, whole = ids[near], blank[near], whole[near]
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=blank), pa.array(whole.tolist(), pa.list_(pa.int64()))], names=["vec_id", "whole"])

    return run


_STATE = "vec_id long, label {label}, whole binary, wide boolean, codes binary, bounds binary, error long, slot int, count long, sums array<long>"


def _assign(shape: Shape, books: list[Codebook], first: bool, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round over a task's rows: codes, bounds and errors, then, but for the last round, a row of sums for each entry in use."""
    groups = [len(b.drift) for b in books]
    ends = np.cumsum([0, *groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(books[0].entries)
        sums = np.zeros((shape.parts, size, shape.width), dtype=np.int64)
        counts = np.zeros((shape.parts, size), dtype=np.int64)
        label = None
        for batch in batches:
            if first:
                at, x = shape.integers(batch.column("vector"))
                rows = batch.take(pa.array(at))
                codes, bounds = None, None
            else:
                rows = batch
                wide = rows.column("wide").to_numpy(zero_copy_only=False)
                x = np.zeros((rows.num_rows, shape.parts * shape.width), dtype=np.int64)
                for kind, some in ((np.int16, ~wide), (np.int32, wide)):
                    mine = [v for v, s in zip(rows.column("whole").to_pylist(), some, strict=True) if s]
                    x[some] = np.frombuffer(b"".join(mine), dtype=kind).reshape(len(mine), x.shape[1])
                x = x.reshape(-1, shape.parts, shape.width)
                codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), dtype=np.uint16).reshape(-1, shape.parts).astype(np.int64)
                bounds = np.frombuffer(b"".join(rows.column("bounds").to_pylist()), dtype=np.uint16).reshape(-1, ends[-1])
            label = rows.column("label").type
            n = rows.num_rows
            new, low, error = np.zeros((n, shape.parts), np.uint16), np.zeros((n, ends[-1]), np.uint16), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                part = np.ascontiguousarray(x[:, p])
                span = slice(ends[p], ends[p + 1])
                code, squares, bound = book.first(part) if first else book.next(part, codes[:, p], bounds[:, span])[:3]
                new[:, p], low[:, span] = code, bound
                error += squares
                if not last:
                    np.add.at(sums[p], code, part)
                    counts[p] += np.bincount(code, minlength=size)
            none = lambda kind: pa.nulls(n, kind)
            if last:
                held = [none(pa.binary()), none(pa.bool_()), _packed(new), none(pa.binary())]
            else:
                flat = x.reshape(n, shape.parts * shape.width)
                big = (np.abs(flat) >= 1 << 15).any(axis=1)
                narrow, whole = flat.astype(np.int16), flat.astype(np.int32)
                held = [pa.array([(whole if b else narrow)[i].tobytes() for i, b in enumerate(big.tolist())], pa.binary()), pa.array(big, pa.bool_()), _packed(new), _packed(low)]
            yield _row(rows.column("vec_id").cast(pa.int64()), rows.column("label"), *held, pa.array(error), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64())))
        used = np.argwhere(counts > 0)
        if len(used):
            n = len(used)
            yield _row(
                pa.nulls(n, pa.int64()), pa.nulls(n, label), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                pa.array(used[:, 0] * size + used[:, 1], pa.int32()), pa.array(counts[counts > 0]), pa.array(list(sums[counts > 0]), pa.list_(pa.int64())),
            )

    return run


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of numbers as one binary value each."""
    data = np.ascontiguousarray(values)
    width = data.shape[1] * data.itemsize
    ends = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _row(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "label", "whole", "wide", "codes", "bounds", "error", "slot", "count", "sums"])


def _updated(state: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """Entries moved to the means of their rows, rounded down; unused ones stay."""
    flat = state.filter(F.col("slot").isNotNull()).select("slot", "count", F.posexplode("sums").alias("at", "sum"))
    got = flat.groupBy("slot", "at").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum")).collect()
    size = len(books[0].entries)
    fresh = [b.entries.copy() for b in books]
    for r in got:
        fresh[r["slot"] // size][r["slot"] % size, r["at"]] = r["sum"] // r["count"]
    return [b.moved(e) for b, e in zip(books, fresh, strict=True)]


def encode(
    vectors: DataFrame, vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16, scale: int = 1024,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Kept rows as vec_id, label, codes (array of entry numbers by part) and error (squared distance), and the codebooks, one array for each part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).cast("array<double>").alias("vector"))
    common = rows.filter(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    shape = Shape(common["size"] if common else 0, parts, scale)
    head = rows.select("vec_id", "vector").mapInArrow(_smallest(shape, entries), "vec_id long, whole array<long>").orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).collect()
    if not head:
        empty = rows.filter(F.lit(False)).select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty, [np.zeros((0, shape.width), np.int64) for _ in range(parts)]
    start = np.array([r["whole"] for r in head], dtype=np.int64).reshape(len(head), parts, shape.width)
    books = []
    for p in range(parts):
        of = groups_of(start[:, p], groups)
        books.append(Codebook(start[:, p].copy(), of, np.zeros(of.max() + 1, dtype=np.int64)))
    schema = _STATE.format(label=rows.schema["label"].dataType.simpleString())
    state, old = rows, None
    for k in range(rounds + 1):
        last = k == rounds
        state = store(state.mapInArrow(_assign(shape, books, k == 0, last), schema))
        if old is not None:
            drop(old)
        old = state
        if not last:
            books = _updated(state, books)
            state = state.filter(F.col("slot").isNull())
    codes = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.conv(F.hex(F.concat(F.substring("codes", 2 * p + 2, 1), F.substring("codes", 2 * p + 1, 1))), 16, 10).cast("int"))
    return state.select("vec_id", "label", codes.alias("codes"), "error"), [b.entries for b in books]


def listed(codebooks: list[np.ndarray]) -> str:
    """All components as decimal numbers, by part, entry and place."""
    return ",".join(str(x) for book in codebooks for x in book.ravel().tolist())


def _oracle(rounds: int = 4) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS MATERIALIZED (SELECT r, p, arg_min(k, d * 256 + k) AS k, min(d) AS d FROM (SELECT r, s.p, k, s.q - 2 * list_inner_product(s.x, c.x) + c.q AS d FROM seg s JOIN c{k} c ON s.p = c.p) GROUP BY r, p)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT p, k, list(v ORDER BY i) AS x FROM (SELECT a.p, a.k, i, floor(sum(s.x[i]) / count(*)) AS v FROM a{k} a JOIN seg s USING (r, p), range(1, 1 + (SELECT w FROM shape)) t(i) GROUP BY a.p, a.k, i) GROUP BY p, k), "
                f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.x, c.x) AS x, list_inner_product(coalesce(m.x, c.x), coalesce(m.x, c.x)) AS q FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.k = m.k)"
            )
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
shape AS (SELECT CAST(max(len(v)) // 4 AS BIGINT) AS w FROM kept),
seg AS MATERIALIZED (SELECT r, p, x, list_inner_product(x, x) AS q FROM (SELECT r, p, v[p * w + 1 : (p + 1) * w] AS x FROM kept, shape, range(4) t(p))),
c0 AS (SELECT p, r - 1 AS k, x, q FROM seg WHERE r <= 256),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""


#: The contract in SQL, all entries compared in every round; ids are distinct there.
ORACLE = _oracle()
