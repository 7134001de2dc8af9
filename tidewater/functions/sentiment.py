"""Sentiment decisions: ordered chains of conditions; each gives a struct of sentiment, confidence and method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _out(sentiment: str | Column, confidence: float | Column, method: str) -> Column:
    kind = F.lit(sentiment) if isinstance(sentiment, str) else sentiment
    sure = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return F.struct(kind.alias("sentiment"), sure.cast("double").alias("confidence"), F.lit(method).alias("method"))


def mean_rating(*ratings: Column) -> Column:
    """Mean of the ratings that aren't null."""
    given = F.filter(F.array(*[r.cast("double") for r in ratings]), lambda r: r.isNotNull())
    return F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda a, b: a + b) / F.size(given))


def from_ratings(*ratings: Column) -> Column:
    """By ratings alone: a low one decides, then the mean."""
    least, mean = F.array_min(F.array(*[r.cast("double") for r in ratings])), mean_rating(*ratings)
    return (
        F.when(mean.isNull(), _out("neutral", 0.5, "rating"))
        .when(least < 3, _out("negative", 0.9 - least / 5 * 0.3, "rating"))
        .when(mean >= 4, _out("positive", F.least(F.lit(0.95), 0.6 + (mean - 4) * 0.3), "rating"))
        .when(mean >= 3.5, _out("positive", 0.6, "rating"))
        .otherwise(_out("neutral", 0.5, "rating"))
    )


def with_ratings(sentiment: Column, confidence: Column, *ratings: Column) -> Column:
    """A text's sentiment corrected by its ratings."""
    least, mean, by = F.array_min(F.array(*[r.cast("double") for r in ratings])), mean_rating(*ratings), from_ratings(*ratings)
    return (
        F.when(mean.isNull(), _out(sentiment, confidence, "text"))
        .when((least < 3) & (mean < 3.5), _out("negative", 0.95, "low rating"))
        .when(least < 3, _out("neutral", 0.7, "low rating"))
        .when(by["sentiment"] == sentiment, _out(sentiment, F.greatest(confidence, by["confidence"]), "agreed"))
        .when((sentiment == "negative") & (mean >= 4), _out("neutral", 0.7, "conflict"))
        .when((sentiment == "positive") & (mean < 3.5), _out("neutral", 0.6, "conflict"))
        .otherwise(_out(sentiment, confidence * 0.9, "text"))
    )


def short_text(*ratings: Column) -> Column:
    """For texts too short to read: tiers of the mean, and a low rating."""
    least, mean = F.array_min(F.array(*[r.cast("double") for r in ratings])), mean_rating(*ratings)
    return (
        F.when(mean.isNull(), F.lit("neutral"))
        .when(least < 3, F.when(mean >= 3.5, "neutral").otherwise("negative"))
        .when(mean >= 3.5, F.lit("positive"))
        .when(mean >= 3, F.lit("neutral"))
        .otherwise(F.lit("negative"))
    )


def shown(stored: Column, text_sentiment: Column, *ratings: Column) -> Column:
    """The sentiment to show: the stored one if valid, else by ratings, and a negative text isn't positive."""
    least, mean = F.array_min(F.array(*[r.cast("double") for r in ratings])), mean_rating(*ratings)
    return (
        F.when(stored.isin("positive", "negative", "neutral"), stored)
        .when(least < 3, F.lit("negative"))
        .when(text_sentiment == "negative", F.lit("neutral"))
        .when(mean >= 3.5, F.lit("positive"))
        .when(mean >= 3, F.lit("neutral"))
        .when(mean.isNotNull(), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def by_rating_sum(*ratings: Column, high: float = 12, low: float = 9) -> Column:
    """Polarity by the sum of ratings, null as 0."""
    total = sum((F.coalesce(r.cast("double"), F.lit(0.0)) for r in ratings), F.lit(0.0))
    return F.when(total >= high, "positive").when(total < low, "negative").otherwise("neutral")


def majority(positive: Column, negative: Column) -> Column:
    """The polarity of more keywords; neutral for as many."""
    return F.when(positive > negative, "positive").when(negative > positive, "negative").otherwise("neutral")


def laplace(hits: Column, total: Column, most: float = 0.95) -> Column:
    return F.least(F.lit(most), (hits + 1.0) / (total + 2.0))


def combined(rule: Column, rule_confidence: Column, other: Column, other_confidence: Column) -> Column:
    """Two judgements in one: the surer if they agree, else the heavier, less sure."""
    first = rule_confidence * 0.3 >= other_confidence * 0.4
    return (
        F.when(rule == other, _out(rule, F.greatest(rule_confidence, other_confidence), "agreed"))
        .when(first, _out(rule, rule_confidence * 0.85, "rule"))
        .otherwise(_out(other, other_confidence * 0.85, "other"))
    )


def resolve_conflicts(tags: Column, concession: Column) -> Column:
    """Of a map from tag to (positive, negative, neutral) keyword lists: where both poles are filled, one stays.

    The positive one stays if a concession meets at most one negative keyword, or if it has as many keywords; empty tags go.
    """
    empty = F.array().cast("array<string>")

    def settle(_: Column, v: Column) -> Column:
        positive, negative = F.size(v["positive"]), F.size(v["negative"])
        both = (positive > 0) & (negative > 0)
        up = (concession & (negative <= 1)) | (positive >= negative)
        return F.struct(F.when(both & ~up, empty).otherwise(v["positive"]).alias("positive"), F.when(both & up, empty).otherwise(v["negative"]).alias("negative"), v["neutral"].alias("neutral"))

    return F.map_filter(F.transform_values(tags, settle), lambda _, v: (F.size(v["positive"]) + F.size(v["negative"]) + F.size(v["neutral"])) > 0)
