"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document's expected number of copies is its source's target over its source's size.  Within a source the documents stand in order
of size, the expected copies are summed from the first on, one offset drawn for the source is added, and a document comes out once
for each whole number that its sum crosses.  As neighbours in the order are of like size, the words taken stay within about one long
document of the target.

The running sum needs no window over a whole source: documents fall into cells by source, size level and a hash, cells are counted,
the counts are summed in order, and only ranks inside a cell need its rows together.  There are as many cells to each source and level
as the table has millions of rows, so a source of a third of all rows has its rows in small cells, too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least cells of a source and size level, and rows for each cell of the whole table.
CELLS, CELL_ROWS = 16, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def _level(size: Column) -> Column:
    """Eight steps for each doubling of the size, in whole numbers."""
    bits = F.length(F.bin(size)).cast("long")
    return bits * 8 + F.floor(size * 16 / F.pow(F.lit(2.0), bits)).cast("long") - 8


def _cell(doc_id: Column, text: Column, cells: int) -> Column:
    """A hash of the id, or of the text where there is none."""
    value = F.coalesce(doc_id.cast("long"), F.conv(F.substring(F.md5(F.coalesce(text.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"))
    spread = F.pmod(F.pmod(value, F.lit(1000003)) * 7919, F.lit(1000003))
    return F.pmod(spread, F.lit(cells))


def targets(sizes: DataFrame, weights: Sequence[float], share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Target of each source of (source, source_size).

    Sources in code-point order, null last, weigh as weights, repeating, and divide share times the sum of all sizes.  No target is
    above limit times its source's size: the excess goes to the others by weight until none is above.  Sources that reach their limit are those
    of least size for their weight, so one pass in that order finds where the rest divides.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(order, F.lit(len(weights)))))
    ranked = ranked.withColumn("bound", F.lit(limit) * F.col("source_size"))
    full = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    rate = (share * F.sum("source_size").over(all_) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    tried = ranked.withColumns({"step": F.row_number().over(full), "rate": rate})
    fits = F.when(F.col("rate") <= F.col("bound") / F.col("weight"), F.struct("step", "rate"))
    chosen = F.min(fits).over(all_)["rate"]
    return tried.select("source", "source_size", F.when(chosen.isNull(), F.col("bound")).otherwise(F.least("bound", chosen * F.col("weight"))).alias("target"))


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """All columns of docs and size, source_size, target, copies and taken (words the mix takes of the row, repeats counted).

    Size is the number of words; a null or empty text has size 0 and takes 0 words however often it comes.  Null is a source of its
    own.  Ties of size stand in order of doc_id and a hash of the text; equal rows are alike.  Columns of docs that clash with the new ones are replaced.
    The offsets depend on seed and source alone, so reruns agree.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    new = {"size": size, "_level": _level(F.col("size")), "_cell": _cell(F.col("doc_id"), F.col("text"), max(CELLS, -(-docs.count() // CELL_ROWS)))}
    dealt = docs.drop("size", "source_size", "target", "copies", "taken")
    for name, value in new.items():
        dealt = dealt.withColumn(name, value)
    key = ["source", "_level", "_cell"]
    dealt = dealt.repartition(*key)
    cells = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cell_size"))
    wanted = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, limit)
    ahead = Window.partitionBy("source").orderBy("_level", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*key, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    cells = cells.select(F.col("source").alias("_s"), F.col("_level").alias("_l"), F.col("_cell").alias("_c"), "_before")
    wanted = wanted.select(F.col("source").alias("_t"), "source_size", "target")
    cells = cells.join(wanted, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    inside = Window.partitionBy(*key).orderBy("size", "doc_id", F.xxhash64("text"))
    ranked = dealt.withColumn("_rank", F.row_number().over(inside)).join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\0")))), 1, 5), 16, 10).cast("double") / 1048576.0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_before") + F.col("_rank")
    crossed = F.floor(expected * place + offset) - F.floor(expected * (place - 1) + offset)
    ranked = ranked.withColumn("copies", F.greatest(F.floor(expected), F.least(F.ceil(expected), crossed)).cast("long"))
    return ranked.withColumn("taken", F.col("copies") * F.col("size")).drop("_level", "_cell", "_rank", "_s", "_l", "_c", "_before")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as ``copies`` says, with the columns of docs."""
    taken = copies(docs, weights, share, limit, seed)
    return taken.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS digest FROM documents
), leveled AS (
  SELECT *, length(bin(size)) * 8 + CAST(floor(size * 16 / pow(2.0, length(bin(size)))) AS BIGINT) - 8 AS lvl,
    (((coalesce(doc_id, digest) % 1000003 + 1000003) % 1000003) * 7919 % 1000003) % (SELECT greatest(16, (count(*) + 999999) // 1000000) FROM documents) AS cell FROM sized
), sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM leveled GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS bound FROM sources
), tried AS (
  SELECT *, row_number() OVER o AS step,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM ranked WINDOW o AS (ORDER BY bound / weight, source NULLS LAST)
), chosen AS (SELECT arg_min(rate, step) AS rate FROM tried WHERE rate <= bound / weight),
wanted AS (
  SELECT t.source, t.source_size, CASE WHEN c.rate IS NULL THEN t.bound ELSE least(t.bound, c.rate * t.weight) END AS target FROM tried t CROSS JOIN chosen c
), placed AS (
  SELECT d.doc_id, d.size, w.source_size, w.target, row_number() OVER (PARTITION BY d.source ORDER BY lvl, cell, d.size, d.doc_id) AS place,
    CASE WHEN w.source_size > 0 THEN w.target / w.source_size ELSE 0 END AS expected,
    CAST('0x' || substr(md5('mix:' || coalesce(d.source, chr(0))), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS shift
  FROM leveled d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(floor(expected), least(ceil(expected), floor(expected * place + shift) - floor(expected * (place - 1) + shift))) AS BIGINT) AS copies,
  CAST(greatest(floor(expected), least(ceil(expected), floor(expected * place + shift) - floor(expected * (place - 1) + shift))) AS BIGINT) * size AS taken
FROM placed
"""
