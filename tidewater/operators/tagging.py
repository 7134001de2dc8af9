"""Keywords resolved to the tags of a registry, and statistics by tag that roll them down.

A registry is a table of category, tag, keyword and position (the order in which rules are tried); it may have any size.  Keywords are
resolved once for each distinct one: by equality, by equality of the stem, then by the first entry that stands in it.  The first two are
joins; for the third an automaton over the entries (transitions, with those of a failed match already resolved, and for each state the
first entry that ends there, both flat arrays) walks all words of a batch at once.  Entries go to the tasks in blocks of bounded bytes,
so a registry of any size is searched, one pass over the distinct words for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import text as T
from ..functions.tags import OTHER, SUFFIXES

NONE = np.iinfo(np.int64).max
POLARITIES = ("positive", "negative", "neutral")


def normal(word: Column) -> Column:
    return F.lower(F.trim(word))


def first_wins(registry: DataFrame) -> DataFrame:
    """Entries (entry, tag, category, position) of which the first of a keyword counts; null and empty keywords are none."""
    return registry.filter(F.col("keyword") != "").groupBy(F.col("keyword").alias("entry")).agg(F.min_by(F.struct("tag", "category"), "position").alias("of"), F.min("position").alias("position")).select("entry", "of.tag", "of.category", "position")


def last_wins(registry: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Entries of keywords and of their stems: of a keyword its last row counts, a stem only where it is no keyword, and then its first row.

    An entry is tried where it first stands, as keyword or as stem.
    """
    rows = registry.filter(F.col("keyword") != "")
    keyword = F.struct(F.col("keyword").alias("entry"), (F.col("position") * 2).alias("at"), F.lit(False).alias("stem"))
    stem = F.struct(T.stem(F.col("keyword"), suffixes).alias("entry"), (F.col("position") * 2 + 1).alias("at"), F.lit(True).alias("stem"))
    both = rows.select("tag", "category", F.explode(F.array(keyword, stem)).alias("x")).select("tag", "category", "x.*").filter(F.col("entry") != "")
    of = F.struct("tag", "category")
    got = both.groupBy("entry").agg(F.max_by(F.when(~F.col("stem"), of), F.when(~F.col("stem"), F.col("at"))).alias("own"), F.min_by(F.when(F.col("stem"), of), F.when(F.col("stem"), F.col("at"))).alias("other"), F.min("at").alias("position"))
    return got.withColumn("of", F.coalesce("own", "other")).select("entry", "of.tag", "of.category", "position")


class Automaton:
    """All entries at once: a state for each prefix of one, transitions by byte class, and the least position of the entries that end in a state."""

    def __init__(self, entries: Sequence[tuple[bytes, int]]):
        used = sorted({b for word, _ in entries for b in word})
        self.classes = np.zeros(256, dtype=np.int32)  # class 0: bytes of no entry
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        size = 1 + sum(len(word) for word, _ in entries)
        step = np.zeros((size, width), dtype=np.int32)
        best = np.full(size, NONE, dtype=np.int64)
        depth_of = [0]
        for word, position in entries:
            state = 0
            for c in self.classes[list(word)].tolist():
                if not step[state, c]:
                    step[state, c] = len(depth_of)
                    depth_of.append(depth_of[state] + 1)
                state = step[state, c]
            best[state] = min(best[state], position)
        count = len(depth_of)
        self.step, self.best = step[:count], best[:count]
        fail = np.zeros(count, dtype=np.int32)
        queue = [s for s in self.step[0].tolist() if s]
        for state in queue:
            self.best[state] = min(self.best[state], self.best[fail[state]])
            for c in range(1, width):
                to = self.step[state, c]
                if to:
                    fail[to] = self.step[fail[state], c]
                    queue.append(int(to))
                else:
                    self.step[state, c] = self.step[fail[state], c]

    @property
    def nbytes(self) -> int:
        return self.step.nbytes + self.best.nbytes + self.classes.nbytes

    def first_inside(self, words: pa.Array) -> np.ndarray:
        """For each word the least position of the entries inside it, NONE if there is none; all words go on byte by byte together."""
        raw = words.cast(pa.binary())
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
        lengths = np.diff(ends)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = ends[:-1][order], lengths[order]
        state = np.zeros(len(order), dtype=np.int32)
        found = np.full(len(order), NONE, dtype=np.int64)
        for i in range(int(lengths[0]) if len(order) else 0):
            n = int(np.searchsorted(-lengths, -i, side="left"))  # words longer than i
            state[:n] = self.step[state[:n], self.classes[data[starts[:n] + i]]]
            found[:n] = np.minimum(found[:n], self.best[state[:n]])
        out = np.empty_like(found)
        out[order] = found
        return out


def _walk(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            found = automaton.first_inside(batch.column("word"))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found, mask=found == NONE)], names=["word", "position"])

    return run


def _blocks(entries: DataFrame, block_bytes: int) -> Iterator[list[tuple[bytes, int]]]:
    """Entries by hash, in blocks of about block_bytes, measured before they come to the driver."""
    total = entries.agg(F.sum(F.octet_length("entry"))).first()[0] or 0
    count = -(-int(total) // block_bytes)
    for k in range(count):
        rows = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(count)) == k).select("entry", "position").collect()
        yield [(r["entry"].encode(), r["position"]) for r in rows]


def inside(words: DataFrame, entries: DataFrame, block_bytes: int = 1 << 16) -> DataFrame:
    """Of each word (distinct, not null) that holds an entry: word and the least position of the entries in it."""
    context = words.sparkSession.sparkContext
    parts = [words.select("word").mapInArrow(_walk(context.broadcast(Automaton(block))), "word string, position long").filter(F.col("position").isNotNull()) for block in _blocks(entries, block_bytes)]
    if not parts:
        return words.select("word", F.lit(None).cast("long").alias("position")).filter(F.lit(False))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("word").agg(F.min("position").alias("position"))


def resolve(keywords: DataFrame, entries: DataFrame, suffixes: Sequence[str] = SUFFIXES, block_bytes: int = 1 << 16) -> DataFrame:
    """Of each distinct non-blank keyword: keyword, tag, category and how (exact, stem, inside; the first that applies), null where no entry does.

    Keywords are compared lower-cased and trimmed; entries as they are.
    """
    entries = entries.select("entry", "tag", "category", "position")
    distinct = keywords.select("keyword").filter(F.trim("keyword") != "").distinct()
    words = distinct.withColumn("word", normal(F.col("keyword"))).withColumn("stem", T.stem(F.col("word"), suffixes))
    named = lambda key, how: entries.select(F.col("entry").alias(key), F.struct("tag", "category", F.lit(how).alias("how")).alias(f"by_{how}"))
    known = words.join(named("word", "exact"), "word", "left").join(named("stem", "stem"), "stem", "left")
    known = known.withColumn("of", F.coalesce("by_exact", "by_stem")).select("keyword", "word", "of")
    held = inside(known.filter(F.col("of").isNull()).select("word").distinct(), entries, block_bytes)
    by_place = held.join(entries.select("position", F.struct("tag", "category", F.lit("inside").alias("how")).alias("held")), "position").select("word", "held")
    return known.join(by_place, "word", "left").withColumn("of", F.coalesce("of", "held")).select("keyword", "of.tag", "of.category", "of.how")


def classify(keywords: DataFrame, entries: DataFrame, polarity: Column, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Rows of keywords with their tag, category and how it was found, and the polarity that a column of the row gives.

    Each distinct keyword is resolved once; a blank or null one has no tag.
    """
    found = resolve(keywords, entries, suffixes).withColumnRenamed("keyword", "_keyword")
    return keywords.withColumn("polarity", polarity).join(found, F.col("keyword") == F.col("_keyword"), "left").drop("_keyword")


def roll_down(tagged: DataFrame, keys: Sequence[str], subtags: DataFrame | None, tags: str = "tags", skip: str = OTHER) -> DataFrame:
    """Counts of keywords by keys and tag: of each tag of a row, and of the tags its keywords resolve to where these have another name.

    tagged has a map from tag to struct(positive, negative, neutral) of keyword arrays; subtags has keyword and tag (None: no rolling down).  A
    tag without keywords has a row of zeros; the skipped tag and its keywords have none.  Each keyword becomes the rows of both its tags in one
    pass, and these are counted before the only shuffle of them; subtags are joined by the distinct keywords.
    """
    entries = tagged.select(*keys, F.explode(F.map_entries(tags)).alias("entry")).filter(F.col("entry.key") != skip)

    def words_of(polarity: str) -> Column:
        given = F.coalesce(F.col(f"entry.value.{polarity}"), F.array().cast("array<string>"))
        return F.transform(given, lambda w: F.struct(F.lit(polarity).alias("polarity"), w.alias("keyword")))

    words = F.concat(*[words_of(p) for p in POLARITIES])
    rows = entries.select(*keys, F.col("entry.key").alias("_tag"), F.explode_outer(words).alias("_x")).select(*keys, "_tag", "_x.polarity", "_x.keyword")
    names = F.array(F.col("_tag"))
    if subtags is not None:
        rows = rows.join(subtags.filter(F.col("tag").isNotNull()).select(F.col("keyword").alias("_k"), F.col("tag").alias("_sub")), F.col("keyword") == F.col("_k"), "left").drop("_k")
        names = F.when(F.col("_sub").isNotNull() & (F.col("_sub") != F.col("_tag")), F.array("_tag", "_sub")).otherwise(names)
    named = rows.select(*keys, "polarity", F.explode(names).alias("tag"))
    return named.groupBy(*keys, "tag").agg(*[F.count_if(F.col("polarity") == p).alias(f"{p}_count") for p in POLARITIES])


def array_weights(tagged: DataFrame, keys: Sequence[str], days: Column, rate: float = 0.01, tags: str = "tags", skip: str | None = None) -> DataFrame:
    """Keywords of each tag by keys and polarity, and their weight, each keyword decayed by the days of its row; a weight of 0 gives way to the count.

    tagged has a map from tag to struct(positive, negative, neutral) of arrays; null arrays are empty, days below 0 and null ones weigh 1.
    """
    entry = F.explode(F.map_entries(tags)).alias("_entry")
    rows = tagged.select(*keys, numbers.decay(days, rate).alias("_w"), entry).select(*keys, "_w", F.col("_entry.key").alias("tag"), *[F.coalesce(F.size(F.col(f"_entry.value.{p}")), F.lit(0)).alias(f"_{p}") for p in POLARITIES])
    rows = rows.withColumns({f"_{p}": F.greatest(F.col(f"_{p}"), F.lit(0)) for p in POLARITIES}).withColumn("_n", F.col("_positive") + F.col("_negative") + F.col("_neutral"))
    kept = rows if skip is None else rows.filter(F.col("tag") != skip)
    got = kept.groupBy(*keys, "tag").agg(*[F.sum(f"_{p}").alias(f"{p}_count") for p in POLARITIES], F.sum("_n").alias("total_count"), F.sum(F.col("_n") * F.col("_w")).alias("weight"))
    return got.withColumn("weight", F.when(F.col("weight") == 0, F.col("total_count").cast("double")).otherwise(F.col("weight")))
