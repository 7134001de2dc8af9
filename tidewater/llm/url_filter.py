"""URL filters: rules first, and for the rest the ratio of two character language models.

URLs that a rule judges are the labelled ones, without the parts that the rule states, since a model of these would only learn the rule: those allowed
train the accepting model, those blocked the rejecting one.  Each is a
Markov model of variable order: the probability of a byte after its last few bytes, smoothed by that after one byte fewer, down to a
uniform one.  Counts are exact, one row of a Spark table for each context and byte that labelled URLs have, so the model grows with them.  A URL is blocked if the difference of its
log-likelihoods, divided by its length, is above a threshold.

For the threshold the labelled URLs are dealt into halves by what they say, and each half is scored by the models of the other one.  It stands
where the two kinds are told apart best.  If they are told apart no better there than chance would do in one of a hundred tries (Kolmogorov and
Smirnov's test), there is nothing to judge by, and what has no rule is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .store import store

ORDER = 4
#: Most URLs that are scored at a time.
BLOCK = 4096
#: Weight of the shorter context, in observations.
SMOOTH = 2.0
BINS, SPAN = 1024, 4.0
#: Least distance of two samples' distributions that chance exceeds once in a hundred tries, times the root of their harmonic size.
CHANCE = 1.63
_CLASSES = ("allow", "block")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where ``://`` is missing."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of (verdict, rule) that fits a host or a parent of it and the path's start: a struct of rule, verdict and what else the URL says, or null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, start = rule.partition("/")
        same = (host == domain) | host.endswith("." + domain)
        rest = F.concat(F.substring(host, F.lit(1), F.length(host) - len(domain)), F.substr(path, F.lit(len(slash + start) + 1)))
        fits.append(F.when(same & path.startswith(slash + start), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), rest.alias("rest"))))
    return F.coalesce(*fits)


def _grams(text: bytes) -> np.ndarray:
    """The ORDER bytes before each byte of a text and the byte, as one number, the last byte lowest; an end mark is a byte, too."""
    codes = np.frombuffer(b"\x02" * ORDER + text + b"\x03", dtype=np.uint8).astype(np.int64)
    out = np.zeros(len(text) + 1, dtype=np.int64)
    for i in range(ORDER + 1):
        out = out << 8 | codes[i : i + len(out)]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of a batch of labelled URLs with their numbers, of allowed and of blocked ones."""
    for batch in batches:
        if batch.num_rows:
            found = [_grams(A.as_bytes(t)) for t in batch.column("shown").to_pylist()]
            blocked = np.repeat(np.array(batch.column("blocked").to_pylist(), dtype=bool), [len(f) for f in found])
            grams, at = np.unique(np.concatenate(found), return_inverse=True)
            sums = [np.bincount(at[mask], minlength=len(grams)).astype(np.int64) for mask in (~blocked, blocked)]
            yield pa.RecordBatch.from_arrays([pa.array(grams), *map(pa.array, sums)], names=["gram", *_CLASSES])


def _levels() -> Column:
    """For each context length, the gram cut to it: order, joint and context (joint without the last byte)."""
    cut = [F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)) for k in range(ORDER + 1)]
    return F.explode(F.array(*[F.struct(F.lit(k).alias("order"), c.alias("joint"), F.shiftright(c, 8).alias("context")) for k, c in enumerate(cut)]))


def train(labelled: DataFrame) -> DataFrame:
    """The model: for each context length and gram cut to it, the exact counts in allowed and blocked URLs (shown, blocked)."""
    grams = labelled.mapInArrow(_counted, "gram long, allow long, block long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in _CLASSES])
    cut = grams.select(_levels().alias("at"), *_CLASSES).groupBy("at.order", "at.joint", "at.context")
    return cut.agg(*[F.sum(c).alias(c) for c in _CLASSES])


def ratios(grams: DataFrame, model: DataFrame) -> DataFrame:
    """gram and its ratio: the log-probability of its last byte after the others under the rejecting model less that under the accepting one.

    The empty context is no key of the joins: its 256 rows and one row of totals go to every task.
    """
    seen = [f"{c}_seen" for c in _CLASSES]
    longer = model.filter(F.col("order") > 0)
    totals = longer.groupBy("order", "context").agg(*[F.sum(c).alias(n) for c, n in zip(_CLASSES, seen, strict=True)])
    parts = grams.select("gram", _levels().alias("at")).select("gram", "at.*").filter(F.col("order") > 0)
    found = parts.join(longer.drop("context"), ["order", "joint"], "left").join(totals, ["order", "context"], "left")
    names = [n for c in _CLASSES for n in (c, f"{c}_seen")]
    wide = found.groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("order") == k, F.col(n))), F.lit(0)).alias(f"{n}_{k}") for k in range(1, ORDER + 1) for n in names])
    single = model.filter(F.col("order") == 0)
    bytes_ = single.select(F.col("joint").alias("last"), *[F.col(c).alias(f"{c}_0") for c in _CLASSES])
    whole = single.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_seen_0") for c in _CLASSES])
    wide = wide.withColumn("last", F.col("gram").bitwiseAND(F.lit(255))).join(F.broadcast(bytes_), "last", "left").join(F.broadcast(whole), how="cross")
    logs = []
    for c in _CLASSES:
        chance = F.lit(1.0 / 256)
        for k in range(ORDER + 1):
            chance = (F.coalesce(F.col(f"{c}_{k}"), F.lit(0)) + F.lit(SMOOTH) * chance) / (F.col(f"{c}_seen_{k}") + F.lit(SMOOTH))
        logs.append(F.log(chance))
    return wide.select("gram", (logs[1] - logs[0]).alias("ratio"))


def _blocked_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the block they are scored in: a batch of a partition."""
    part = TaskContext.get().partitionId()  # type: ignore[union-attr]
    at = 0
    for whole in batches:
        for batch in A.slices(whole, BLOCK):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part << 32 | at))], names=[*batch.schema.names, "block"])
            at += 1


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct grams of each block's URLs among those of a batch."""
    for batch in batches:
        of: dict[int, list[np.ndarray]] = {}
        for block, text in zip(batch.column("block").to_pylist(), batch.column("shown").to_pylist(), strict=True):
            if text:
                of.setdefault(block, []).append(_grams(A.as_bytes(text)))
        for block, found in of.items():
            grams = np.unique(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(grams)], names=["block", "gram"])


def _summed(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The score of each URL of a block: the mean of its grams' ratios; 0 for an empty text."""
    grams, ratio = known.column("gram").to_numpy(), known.column("ratio").to_numpy()
    order = np.argsort(grams)
    grams, ratio = grams[order], ratio[order]
    scores = [float(ratio[np.searchsorted(grams, _grams(A.as_bytes(t)))].mean()) if t else 0.0 for t in rows.column("shown").to_pylist()]
    return rows.drop_columns(["block"]).append_column("score", pa.array(scores, pa.float64()))


def score(rows: DataFrame, model: DataFrame) -> DataFrame:
    """All columns of rows and the score of each row's shown.

    Rows are scored in blocks of bounded size.  A block sends its distinct grams, whose ratios come from a join with the model; no
    table is held whole anywhere.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    blocks = store(rows.mapInArrow(_blocked_out, f"{fields}, block long"))
    pairs = store(blocks.select("block", "shown").mapInArrow(_distinct, "block long, gram long").distinct())
    known = pairs.join(ratios(pairs.select("gram").distinct(), model), "gram").select("block", "gram", "ratio")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, f"{fields}, score double")


def _threshold(scored: DataFrame) -> float:
    """Between the bins where the two classes' error rates sum to least, nearest to 0 of equals; infinite where that is no better than chance."""
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + SPAN) * BINS / (2 * SPAN)))).cast("int")
    counts = np.zeros((2, BINS))
    for row in scored.groupBy(F.col("blocked").alias("blocked"), place.alias("bin")).count().collect():  # at most 2 * BINS rows
        counts[int(row["blocked"]), row["bin"]] = row["count"]
    size = counts.sum(axis=1)
    if not size.all():
        return float("inf")
    share = counts / size[:, None]
    # Above the cut is blocked
    wrong = np.concatenate([[1.0], 1.0 - np.cumsum(share[0])]) + np.concatenate([[0.0], np.cumsum(share[1])])
    if 1.0 - wrong.min() <= CHANCE * np.sqrt((1.0 / size).sum()):
        return float("inf")
    cuts = np.arange(BINS + 1) * 2 * SPAN / BINS - SPAN
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of pages.

    A rule's verdict stands.  Of the others, those whose score is above the calibrated threshold are blocked.  Null and empty URLs have
    empty host and path, score 0 and are allowed.  Without labelled URLs of both kinds, or where held-out ones aren't told apart, what has no rule
    is allowed.  Each row counts for itself: page_id may be null or stand several times, and equal URLs have equal verdicts.  A URL of any length is
    read whole.  An empty table gives no rows.  Other columns are ignored.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict"), F.col("found.rest").alias("rest"), F.concat("host", "path").alias("shown"))
    labelled = rows.filter(F.col("rule").isNotNull()).select(F.col("rest").alias("shown"), (F.col("verdict") == "block").alias("blocked"), F.pmod(F.xxhash64("rest"), F.lit(2)).alias("half"))
    halves = [labelled.filter(F.col("half") == k).drop("half") for k in range(2)]
    models = [store(train(half)) for half in halves]
    held_out = score(halves[0], models[1]).unionByName(score(halves[1], models[0]))
    cut = _threshold(held_out.select("blocked", "score"))
    both = store(models[0].unionByName(models[1]).groupBy("order", "joint", "context").agg(*[F.sum(c).alias(c) for c in _CLASSES]))
    scored = score(rows.drop("rest"), both)
    blocked = (F.col("shown") != "") & (F.col("score") > cut)
    verdict = F.coalesce("verdict", F.when(blocked, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
