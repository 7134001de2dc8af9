"""Queries of keyword resolution over a registry table, and of statistics that roll keywords down to tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tagging
from ..sources.readers import table
from .catalogue import LETTERS, query

ENDINGS = ("ingly", "tion", "ness", "ing", "ed", "er", "es", "en", "s")
_STEM = "regexp_replace(word, '(?s)^(.+?)(?:" + "|".join(sorted(ENDINGS, key=len, reverse=True)) + ")$', '\\1')"


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as a registry: each word is a tag of the first type it stands under, its keywords are itself and its first two letters."""
    names = table(spark, folder, "part").select("p_partkey", "p_type", F.posexplode(F.split("p_name", " ")).alias("at", "tag")).filter("tag <> ''")
    tags = names.groupBy("tag").agg(F.min(F.struct((F.col("p_partkey") * 8 + F.col("at")).alias("place"), "p_type")).alias("first"))
    keywords = F.posexplode(F.array(F.col("tag"), F.left("tag", F.lit(2))))
    return tags.select(F.col("first.p_type").alias("category"), "tag", "first.place", keywords.alias("n", "keyword")).select("category", "tag", "keyword", (F.col("place") * 2 + F.col("n")).alias("position"))


_REGISTRY = """names AS (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS tag, unnest(range(len(string_split(p_name, ' ')))) AS nth FROM part),
tags AS (SELECT tag, arg_min(p_type, p_partkey * 8 + nth) AS category, min(p_partkey * 8 + nth) AS place FROM names WHERE tag <> '' GROUP BY tag),
registry AS (SELECT category, tag, tag AS keyword, place * 2 AS position FROM tags UNION ALL SELECT category, tag, left(tag, 2), place * 2 + 1 FROM tags)"""
_FIRST = "entries AS (SELECT keyword AS entry, arg_min(tag, position) AS tag, arg_min(category, position) AS category, min(position) AS position FROM registry GROUP BY keyword)"
_LAST = f"""stems AS (SELECT *, {_STEM.replace("word", "keyword")} AS stem FROM registry),
either AS (SELECT keyword AS entry, tag, category, 2 * position AS place, false AS s FROM stems UNION ALL SELECT stem, tag, category, 2 * position + 1, true FROM stems),
entries AS (SELECT entry, coalesce(arg_max(tag, place) FILTER (NOT s), arg_min(tag, place) FILTER (s)) AS tag, coalesce(arg_max(category, place) FILTER (NOT s), arg_min(category, place) FILTER (s)) AS category, min(place) AS position FROM either WHERE entry <> '' GROUP BY entry)"""
_RESOLVED = f"""words AS (SELECT DISTINCT keyword, lower(keyword) AS word FROM raw),
held AS (SELECT keyword, arg_min(e.tag, e.position) AS tag, arg_min(e.category, e.position) AS category FROM words JOIN entries e ON contains(word, e.entry) GROUP BY keyword),
resolved AS (SELECT w.keyword, coalesce(x.tag, s.tag, h.tag) AS tag, coalesce(x.category, s.category, h.category) AS category, CASE WHEN x.tag IS NOT NULL THEN 'exact' WHEN s.tag IS NOT NULL THEN 'stem' WHEN h.tag IS NOT NULL THEN 'inside' END AS how
  FROM words w LEFT JOIN entries x ON x.entry = w.word LEFT JOIN entries s ON s.entry = {_STEM.replace("(word", "(w.word")} LEFT JOIN held h USING (keyword))"""
_RAW = r"raw AS (SELECT unnest(regexp_extract_all(text, '\p{L}{3,}')) AS keyword FROM documents)"


def _found_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.explode(text.keywords(F.col("text"), r"\p{L}{3,}")).alias("keyword"))


@query(f"WITH {_REGISTRY}, {_FIRST}, {_RAW}, {_RESOLVED} SELECT keyword, tag, category, how FROM resolved")
def keyword_tags(spark: SparkSession, folder: str) -> DataFrame:
    """The tag of each distinct word of all documents, the first registry row of a keyword counting."""
    return tagging.resolve(_found_words(spark, folder), tagging.first_wins(registry(spark, folder)), ENDINGS)


@query(f"WITH {_REGISTRY}, {_LAST}, {_RAW}, {_RESOLVED} SELECT tag, how, count(*) AS words FROM resolved GROUP BY tag, how")
def subtag_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many distinct words each tag gets, and how; here the last row of a keyword counts, and stems of keywords are entries too."""
    return tagging.resolve(_found_words(spark, folder), tagging.last_wins(registry(spark, folder), ENDINGS), ENDINGS).groupBy("tag", "how").agg(F.count(F.lit(1)).alias("words"))


_KINDS = {"long": r"\p{L}{9,}", "red": r"[re]\p{L}{3,4}", "기타": r"\p{L}{12,}"}
_TAGGED = ", ".join(f"{{'key': '{name}', 'words': regexp_extract_all(text, '{pattern}')}}" for name, pattern in _KINDS.items())


@query(
    rf"""WITH {_REGISTRY}, {_LAST}, docs AS (SELECT source, lang, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS polarity, text FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL),
    entry AS (SELECT source, lang, polarity, x.key AS tag, x.words AS words FROM (SELECT source, lang, polarity, unnest([{_TAGGED}]) AS x FROM docs) WHERE x.key <> '기타'),
    raw AS (SELECT DISTINCT unnest(words) AS keyword FROM entry), {_RESOLVED},
    kw_rows AS (SELECT source, lang, polarity, tag, unnest(words) AS keyword FROM entry),
    counted AS (SELECT source, lang, polarity, tag, len(words) AS n FROM entry UNION ALL SELECT source, lang, polarity, r.tag, 1 FROM kw_rows x JOIN resolved r USING (keyword) WHERE r.tag <> x.tag)
    SELECT source, lang, tag, {", ".join(f"coalesce(CAST(sum(n) FILTER (WHERE polarity = '{p}') AS BIGINT), 0) AS {p}_count" for p in tagging.POLARITIES)} FROM counted GROUP BY source, lang, tag"""
)
def model_tag_rolldown(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of documents by source and language with the tags that their words resolve to; the skipped tag gives none."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "text").filter(F.col("text").isNotNull())
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    polarity = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    none = F.array().cast("array<string>")
    sides = lambda words: F.struct(*[F.when(F.col("polarity") == p, words).otherwise(none).alias(p) for p in tagging.POLARITIES])
    tags = F.map_from_entries(F.array(*[F.struct(F.lit(name), sides(F.regexp_extract_all("text", F.lit("(?U)" + pattern), F.lit(0)))) for name, pattern in _KINDS.items()]))
    tagged = docs.join(labels, "doc_id", "left").withColumn("polarity", polarity).select("source", "lang", tags.alias("tags"))
    words = F.flatten(F.transform(F.map_values("tags"), lambda v: F.concat(*[v[p] for p in tagging.POLARITIES])))
    keywords = tagged.select(F.explode(words).alias("keyword"))
    subtags = tagging.resolve(keywords, tagging.last_wins(registry(spark, folder), ENDINGS), ENDINGS).select("keyword", "tag")
    return tagging.roll_down(tagged, ["source", "lang"], subtags)
