"""Secret scans that link the parts of a credential, in DataFrame functions only.

Patterns find parts: identifiers, secrets and endpoints.  Three kinds count by themselves (the base kinds); the others are weak and
are reported only when complementary parts stand in their scope: a weak secret needs an identifier, an identifier needs a secret, an endpoint needs
both.  A part's scope is the text within a stated number of code points of it.  Parts meet by an interval join: each is entered in
the cells of the text that it or its scope covers, and only parts of one cell are compared, so no text has all its pairs formed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import store


@dataclass(frozen=True)
class Kind:
    """A pattern, the role of what it finds, the group whose length is tested and that length."""

    name: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1


#: Kinds in the order in which spans are listed; the first three are the base.
KINDS = (
    Kind("assign", "secret", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", "identifier", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 and more: the shorter runs of the base pattern, which would fail, are nearly all words
    Kind("hex", "secret", r"[0-9a-f]{24,}", 0, 24),
    Kind("id", "identifier", r"""(?i:(access_?key_?id|client_?id|account_?id|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    Kind("weak", "secret", r"""(?i:(pass|pwd|passphrase|credential|private_?key|access_?key|auth))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@!-]+)""", 2, 6),
    Kind("key", "secret", r"[A-Za-z0-9+/]{40,}={0,2}", 0, 40),
    Kind("endpoint", "endpoint", r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3|ftp)://[A-Za-z0-9._~:/@-]+", 0, 8),
)
BASE = 3
SCOPE = 256


def _measured(number: int, least: int) -> Callable[[Column, Column], Column]:
    return lambda r, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), F.length(r["gap"]).cast("long").alias("gap"),
        F.length(r["whole"]).cast("long").alias("size"), (F.length(r["value"]) >= least).alias("ok"),
    )


def _parts(text: Column) -> Column:
    """Of each match of each kind: the kind, its number, the code points between it and the match before, its length, and if it counts.

    A first entry of kind -1 stands for the text itself.
    """
    fields = "array<struct<kind:int,i:int,gap:long,size:long,ok:boolean>>"
    found = [F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("size"), F.lit(False).alias("ok"))).cast(fields)]
    for number, kind in enumerate(KINDS):
        pattern = F.lit(kind.pattern)
        rows = F.arrays_zip(
            F.split(text, kind.pattern, -1).alias("gap"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"),
        )
        rows = F.transform(rows, _measured(number, kind.least))
        rows = F.filter(rows, lambda r: r["size"].isNotNull())
        found.append(F.when(text.rlike(kind.pattern), rows.cast(fields)).otherwise(F.array().cast(fields)))
    return F.concat(*found)


def _named(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), kind + 1)


def _role(kind: Column, role: str) -> Column:
    return kind.isin([i for i, k in enumerate(KINDS) if k.role == role])


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of every part that counts, and one row of kind -1 for each row of docs; stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), F.explode(_parts(text)).alias("p")).select("doc_id", "h", "p.*")
    # Equal rows of docs are told apart only by their number
    rows = rows.withColumn("i", F.when(F.col("kind") < 0, F.monotonically_increasing_id()).otherwise(F.col("i"))).repartition("doc_id", "h")
    rows = rows.dropDuplicates(["doc_id", "h", "kind", "i"])
    ahead = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    return store(rows.withColumn("end", end).filter(F.col("ok") | (F.col("kind") < 0)).select("doc_id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """The weak parts whose complementary parts stand in their scope."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = found.filter(F.col("kind") >= BASE).withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope))
    other = found.filter(F.col("kind") >= 0).withColumn("cell", cells(F.col("start"), F.col("end")))
    other = other.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("cell").alias("_c"), F.col("kind").alias("other"), F.col("start").alias("a"), F.col("end").alias("b"))
    near = (F.col("a") < F.col("end") + scope) & (F.col("b") > F.col("start") - scope)
    met = weak.join(other, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")) & (F.col("cell") == F.col("_c")) & near)
    overlap = (F.col("a") < F.col("end")) & (F.col("b") > F.col("start"))
    met = met.groupBy("doc_id", "h", "kind", "start", "end").agg(
        F.bool_or(_role(F.col("other"), "identifier") & ~overlap).alias("identifier"),
        F.bool_or(_role(F.col("other"), "secret") & ~overlap).alias("secret"),
        F.bool_or((F.col("other") < BASE) & overlap).alias("inside"),
    )
    needs = (_role(F.col("kind"), "secret") & F.col("identifier")) | (_role(F.col("kind"), "identifier") & F.col("secret")) | (_role(F.col("kind"), "endpoint") & F.col("identifier") & F.col("secret"))
    return met.filter(needs & ~F.col("inside")).select("doc_id", "h", "kind", "start", "end")


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, h, kind, start, end) of all base spans and linked weak ones, and one row of kind -1 for each row of docs."""
    found = parts(docs)
    return found.filter(F.col("kind") < BASE).unionByName(_linked(found, scope))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_assign, n_access, n_hex, base and all: arrays of (start, kind, end), one row per row of docs.

    Places are code points, ends exclusive.  A null or empty text has no spans, and a text of any length is scanned whole.  Equal rows come out as often as they go in; a null
    doc_id stays null.  Weak parts that overlap a base span are left out.  Other columns are ignored.
    """
    span = F.struct("start", "kind", "end")
    got = spans(docs, scope).groupBy("doc_id", "h").agg(
        F.count_if(F.col("kind") == -1).alias("rows"),
        *[F.count_if(F.col("kind") == i).alias(f"n_{KINDS[i].name}") for i in range(BASE)],
        F.sort_array(F.collect_list(F.when((F.col("kind") >= 0) & (F.col("kind") < BASE), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("all"),
    )
    return got.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("_row", "rows")


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", _named(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with each span of ``spans`` replaced by a mark; spans that overlap or touch are one.

    All rows and columns stay; n_chars, where there is one, is the new length of the texts that change.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    found = spans(docs, scope).filter(F.col("kind") >= 0).withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("run", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    joined = docs.withColumn("_text_hash", F.xxhash64(text)).join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_h")), "left")
    starts = F.concat(F.col("_runs.start"), F.array(F.length(text).cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("_runs.end"))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    changed = F.col("_runs").isNotNull()
    done = joined.withColumn("_new", F.when(changed, F.array_join(kept, mark)).otherwise(F.col("text")))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
