"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and items are lower-cased in A-Z and cut into words, runs of digits, letters and characters beyond ASCII.  The patterns are all
windows of n consecutive words of an item; an item of fewer words is one pattern.  Patterns of one length share a searcher: a table of
shifts by the block of the last two words of the place looked at skips places where no pattern can end, a shift of 0 leads to the
bucket of patterns that end in this block, a table by their first block picks the few that may be meant, and comparing all their words
decides.

Items reach the tasks as broadcast blocks of at most ``block_bytes`` bytes of words, which the driver fills one after the other; documents are
read once for each block, and with one block (the usual benchmark) nothing is shuffled.  Items longer than a piece are cut into pieces
that share n - 1 words, so that no piece, and so no block, is larger than its bound.

Null texts have no words; null item ids count as the empty string; equal item ids are one item; equal rows each give a row.  Documents
may be as long as a row may be: a text is one row and its words are held one text at a time.  Empty tables on either side are no error, and other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .store import store

#: Bytes that belong to words; the others separate them.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PIECE_WORDS = 1 << 12
Words = tuple[bytes, ...]


def words_of(text: str | bytes | None) -> list[bytes]:
    return A.as_bytes(text).translate(_WORD).split()


class Searcher:
    """Wu-Manber tables of patterns of one length: shifts by block, and patterns by their last and first block."""

    def __init__(self, patterns: Iterable[tuple[Words, Sequence[int]]], length: int):
        self.length, self.block = length, min(2, length)
        self.longest = length - self.block + 1
        self.shift: dict[bytes | Words, int] = {}
        self.buckets: dict[bytes | Words, dict[bytes | Words, list[tuple[Words, Sequence[int]]]]] = {}
        for words, owners in patterns:
            for end in range(self.block, length + 1):
                key = self._key(words, end)
                self.shift[key] = min(self.shift.get(key, self.longest), length - end)
            bucket = self.buckets.setdefault(self._key(words, length), {})
            bucket.setdefault(self._key(words, self.block), []).append((words, owners))

    def _key(self, words: Sequence[bytes], end: int) -> bytes | Words:
        """The block of words that ends before a place."""
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, Sequence[int]]]:
        """Places after the end of each occurrence, ascending, with the owners of the pattern."""
        end, n, m, longest, pair = self.length, len(words), self.length, self.longest, self.block == 2
        shift = self.shift.get
        while end <= n:
            key = (words[end - 2], words[end - 1]) if pair else words[end - 1]
            step = shift(key, longest)
            if step:
                end += step
                continue
            start = end - m
            for pattern, owners in self.buckets[key].get(self._key(words, start + self.block), ()):
                if tuple(words[start:end]) == pattern:
                    yield end, owners
            end += 1


class Patterns:
    """Searchers by length over pieces of items, each given as (item id, words)."""

    def __init__(self, pieces: Iterable[tuple[str, Sequence[bytes]]], n: int):
        self.items: list[str] = []
        number: dict[str, int] = {}
        owners: dict[Words, list[int]] = {}
        for item, words in pieces:
            k = number.setdefault(item, len(number))
            if k == len(self.items):
                self.items.append(item)
            for at in range(max(1, len(words) - n + 1) if words else 0):
                mine = owners.setdefault(tuple(words[at : at + n]), [])
                if not mine or mine[-1] != k:
                    mine.append(k)
        by_length: dict[int, list[tuple[Words, list[int]]]] = {}
        for words, mine in owners.items():
            by_length.setdefault(len(words), []).append((words, mine))
        self.searchers = [Searcher(patterns, length) for length, patterns in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Runs of words inside occurrences, as first and last, and the sorted ids of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for s in self.searchers:
            for end, owners in s.search(words):
                found.update(owners)
                spans.append((end - s.length, end - 1))
        return _joined(spans), sorted({self.items[k] for k in found})


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<first:long,last:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _spans(found: Sequence[Sequence[tuple[int, int]]]) -> pa.Array:
    pairs = np.array([p for x in found for p in x], dtype=np.int64).reshape(-1, 2)
    ends = np.cumsum([0, *[len(x) for x in found]]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["first", "last"]))


def _cut(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items as pieces of at most PIECE_WORDS windows; the words of a piece are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in A.slices(batch):
                items, pieces = [], []
                for item, text in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    words = words_of(text)
                    for at in range(0, max(1, len(words) - n + 1) if words else 0, PIECE_WORDS):
                        items.append(item)
                        pieces.append(b" ".join(words[at : at + PIECE_WORDS + n - 1]))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], names=["item", "piece"])

    return run


def blocks(items: DataFrame, n: int, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct pieces of all items in blocks of at most block_bytes (or one piece); the last may be empty."""
    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    pieces = store(chosen.mapInArrow(_cut(n), "item string, piece binary").distinct())
    size = F.octet_length("piece") + F.octet_length("item")
    total = pieces.agg(F.sum(size)).first()[0] or 0
    # Partitions of about a block each, of which the driver holds one at a time
    block: list[tuple[str, bytes]] = []
    held = 0
    for r in pieces.repartition(max(1, -(-int(total) // block_bytes)), "item", "piece").toLocalIterator():
        more = len(r["item"].encode()) + len(r["piece"])
        if block and held + more > block_bytes:
            yield block
            block, held = [], 0
        block.append((r["item"], bytes(r["piece"])))
        held += more
    yield block


_built: dict[str, Patterns] = {}


def _patterns(key: str, shared: Broadcast, n: int) -> Patterns:
    """The tables of one block; a worker keeps those that it built last."""
    if key not in _built:
        _built.clear()
        _built[key] = Patterns(((item, piece.split()) for item, piece in shared.value), n)
    return _built[key]


def _search(key: str, shared: Broadcast, n: int, only_hits: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(key, shared, n)
        for batch in batches:
            for rows in A.slices(batch):
                counts, spans, items = [], [], []
                for text in rows.column("text"):
                    words = words_of(text.as_py())
                    counts.append(len(words))
                    hit, who = patterns.find(words)
                    spans.append(hit)
                    items.append(who)
                names = [c for c in rows.schema.names if c != "text"]
                out = pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in names], pa.array(counts, pa.int64()), _spans(spans), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(x) for x in items], pa.bool_())) if only_hits else out

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_joined([(p["first"], p["last"]) for spans in x for p in spans]) for x in batch.column("spans").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("spans"), "spans", _spans(found))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """Each row of docs as doc_id, n_words, spans (runs of words inside occurrences, first and last) and items (sorted ids of those that occur)."""
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType
    context = docs.sparkSession.sparkContext
    shared = [(uuid.uuid4().hex, context.broadcast(x)) for x in blocks(items, n, block_bytes)]
    result = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string(f"n_words long, spans {_SPANS}, items array<string>").fields])
    if len(shared) == 1:
        return chosen.mapInArrow(_search(*shared[0], n, False), result)
    # Rows that are equal in id and text have equal findings, so these are found by both, and texts are not sent along
    keyed = chosen.withColumns({"k": F.xxhash64("doc_id", "text"), "h": F.md5(F.coalesce("text", F.lit("")))})
    whole = T.StructType([result["doc_id"], T.StructField("k", T.LongType()), T.StructField("h", T.StringType()), *result.fields[1:]])
    parts = [keyed.mapInArrow(_search(key, block, n, True), whole).select("doc_id", "k", "h", "spans", "items") for key, block in shared]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    mine = found.groupBy("k", "h").agg(F.collect_set("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    flat = mine.mapInArrow(_united, f"k long, h string, spans {_SPANS}, items array<string>")
    counts = keyed.mapInArrow(_counted, T.StructType(whole.fields[:4]))
    joined = counts.join(flat, ["k", "h"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in A.slices(batch):
            counts = pa.array([len(words_of(x.as_py())) for x in rows.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "k", "h")], counts], names=["doc_id", "k", "h", "n_words"])


#: The contract in SQL: windows of words joined by spaces meet those of the items, and covered places are counted.
ORACLE = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bench AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item, len(p) AS m, array_to_string(p, ' ') AS p FROM (SELECT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i : i + 9]) END) AS p FROM bench)),
lengths AS (SELECT DISTINCT m FROM patterns),
windows AS (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS p FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, lengths WHERE len(w) >= m)),
hits AS (SELECT r, i, x.m, item FROM windows x JOIN patterns y ON x.m = y.m AND x.p = y.p),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
