"""Polarity of Korean review texts by rules, as column expressions: of texts, of clauses by aspect, and of keywords in context.

Nothing here groups or shuffles: a text's clauses are an array of its row.  A registry of aspects is a parameter, an ordered mapping from
category to keywords.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import packs
from . import sentiment as S
from . import text as T

_U = "(?U)(?d)"
Registry = Mapping[str, Sequence[str]]


def _any(patterns: Sequence[str]) -> str:
    return _U + "(?:" + "|".join(patterns) + ")"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _holds(text: Column, words: Sequence[str]) -> Column:
    return text.rlike(T.quoted(words))


def _number(conditions: Sequence[Column]) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def double_negation(text: Column) -> Column:
    return text.rlike(_any(packs.DOUBLE_NEGATION))


def match_counts(text: Column) -> Column:
    """How often praise and complaints match, as struct(positive, negative)."""
    return F.struct(F.regexp_count(text, F.lit(_any(packs.POSITIVE))).alias("positive"), F.regexp_count(text, F.lit(_any(packs.NEGATIVE))).alias("negative"))


def _judged(sentiment: str, confidence: Column | float) -> Column:
    value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(F.lit(sentiment).alias("sentiment"), value.cast("double").alias("confidence"))


def _hinted(text: Column) -> Column:
    """Polarity from single words, for texts that no pattern matches."""
    strong = [T.count_of(text, w) for w in packs.STRONG_HINTS]
    best = [F.when(n > 0, F.lit(c) + (n - 1) * 0.05).otherwise(0.0) for n, c in zip(strong, packs.STRONG_HINTS.values(), strict=True)]
    medium = [F.contains(text, F.lit(w)) for w in packs.MEDIUM_HINTS]
    fair = [F.when(m, F.lit(c)).otherwise(0.0) for m, c in zip(medium, packs.MEDIUM_HINTS.values(), strict=True)]
    facts = F.struct(
        sum(strong, F.lit(0)).alias("strong"), F.greatest(*best).alias("best"), _number(medium).alias("medium"), F.greatest(*fair).alias("fair"),
        _number([F.contains(text, F.lit(w)) for w in packs.WEAK_HINTS]).alias("weak"), _number([F.contains(text, F.lit(w)) for w in packs.WEAK_NEGATIVE]).alias("against"),
    )

    def decide(f: Column) -> Column:
        medium = F.when(f["strong"] > 0, 0).otherwise(f["medium"])
        some = f["strong"] + medium
        return (
            F.when((f["strong"] > 0) & (f["against"] == 0), _judged("positive", F.least(F.lit(0.9), f["best"])))
            .when((medium > 0) & (f["against"] == 0), _judged("positive", F.least(F.lit(0.8), f["fair"] + medium * 0.03)))
            .when((some > 0) & (some + f["weak"] > f["against"]), _judged("positive", F.least(F.lit(0.7), 0.5 + 0.05 * some)))
            .when(f["against"] > 0, _judged("negative", 0.5))
            .otherwise(_judged("neutral", 0.4))
        )

    return _let(facts, decide)


def of_text(text: Column) -> Column:
    """struct(sentiment, confidence) of a text or clause; null and blank ones are neutral with 0."""
    absent = [text.rlike(f"{_U}{w}.{{0,10}}없") for w in packs.ABSENT_NEGATIVE]
    praise = F.regexp_extract_all(text, F.lit(_any(packs.POSITIVE)), F.lit(0))
    facts = F.struct(
        text.alias("text"), F.size(praise).alias("praise"), F.size(F.array_distinct(praise)).alias("kinds"), F.regexp_count(text, F.lit(_any(packs.NEGATIVE))).alias("complaints"),
        _number(absent).alias("absent"), _number([F.contains(text, F.lit(w)) for w in packs.STRONG_NEGATIVE]).alias("strong"),
    )

    def decide(f: Column) -> Column:
        t, strong = f["text"], f["strong"]
        up, down = f["praise"] + f["absent"], F.greatest(F.lit(0), f["complaints"] - f["absent"])
        sure = 0.6 + 0.1 * (up - down)
        sure = F.when(f["praise"] / F.greatest(f["kinds"], F.lit(1)) >= 1.5, F.least(F.lit(0.95), sure + 0.15)).otherwise(sure)
        short = F.length(t) < 30
        return (
            F.when(double_negation(t), _judged("positive", 0.95))
            .when(t.rlike(_any(packs.NEGATED_POSITIVE)), _judged("negative", 0.85))
            .when((strong > 0) & (strong >= f["praise"]), _judged("negative", F.least(F.lit(0.95), 0.7 + 0.05 * strong)))
            .when((strong == 0) & t.rlike(_any(packs.EXCEPTIONS)), _judged("positive", 0.8))
            .when(t.rlike(_any(packs.MISSING_POSITIVE)), _judged("negative", 0.9))
            .when(short & (f["complaints"] > 0), _judged("negative", 0.7))
            .when(short & _holds(t, packs.CLEAR_POSITIVE), _judged("positive", 0.85))
            .when(short & F.contains(t, F.lit("잘")) & _holds(t, packs.WELL_USED), _judged("positive", 0.8))
            .when(up > down, _judged("positive", F.least(F.lit(0.95), sure)))
            .when(down > up, _judged("negative", F.least(F.lit(0.95), 0.6 + 0.1 * (down - up))))
            .when(up > 0, _judged("positive", 0.65))
            .otherwise(_hinted(t))
        )

    blank = text.isNull() | ~text.rlike(_U + r"\S")
    return F.when(blank, _judged("neutral", 0.0)).otherwise(_let(facts, decide))


def of_keyword(word: Column) -> Column:
    """Polarity of a keyword alone."""
    return (
        F.when(word.rlike(_any(packs.EXCEPTIONS)), "positive")
        .when(word.rlike(_any(packs.NEGATIVE)), "negative")
        .when(word.rlike(_any(packs.POSITIVE)), "positive")
        .otherwise("neutral")
    )


def own_clause(window: Column, place: Column) -> Column:
    """The side of the adversative that stands nearest to a place (from 0) of a window; the whole window where there is none."""
    between, marks = F.split(window, packs.ADVERSATIVE, -1), F.regexp_extract_all(window, F.lit(packs.ADVERSATIVE), F.lit(0))

    def at(i: Column) -> Column:
        before = F.length(F.array_join(F.slice(between, 1, i + 1), "")) + F.length(F.array_join(F.slice(marks, 1, i), ""))
        return F.struct(F.abs(before - place).alias("far"), i.alias("i"), before.alias("start"), (before + F.length(F.get(marks, i))).alias("end"))

    def side(x: Column) -> Column:
        return F.when(place < x["start"], F.substring(window, F.lit(1), x["start"])).otherwise(F.substr(window, x["end"] + 1))

    nearest = F.array_min(F.transform(F.sequence(F.lit(0), F.size(marks) - 1), at))
    return F.when(F.size(marks) == 0, window).otherwise(_let(nearest, side))


def of_keyword_in(word: Column, context: Column, reach: int = 50) -> Column:
    """Polarity of a keyword in its context: the clause it stands in decides, within a number of characters on both sides."""
    alone = of_keyword(word)
    place = F.instr(context, word) - 1
    start = F.greatest(F.lit(0), place - reach)
    window = F.substring(context, start + 1, F.least(F.length(context), place + F.length(word) + reach) - start)
    facts = F.struct(own_clause(window, place - start).alias("clause"), alone.alias("alone"))

    def decide(f: Column) -> Column:
        clause, base = f["clause"], f["alone"]
        exception = clause.rlike(_any(packs.EXCEPTIONS))
        return (
            F.when(double_negation(clause), "positive")
            .when(exception & (base != "negative"), "positive")
            .when((base == "positive") & clause.rlike(_U + packs.NEGATION) & ~exception, "negative")
            .when(base != "neutral", base)
            .when(clause.rlike(_any(packs.NEGATIVE)), "negative")
            .when(clause.rlike(_any(packs.POSITIVE)), "positive")
            .otherwise("neutral")
        )

    found = F.coalesce(F.contains(context, word), F.lit(False)) & (word != "")
    return F.when(~found, alone).when(T.negated_only(word, context, packs.NEGATING_PREFIXES), "negative").otherwise(_let(facts, decide))


def aspects(text: Column, registry: Registry) -> Column:
    """array<struct<aspect, keyword>> of the aspects a text names, in the registry's order, then keywords that need a context.

    Of a keyword in several categories the last one counts; general praise and words that stand only behind a negating prefix don't.
    """
    owner: dict[str, str] = {}
    for category, words in registry.items():
        owner |= dict.fromkeys(words, category)
    pair = lambda aspect, word: F.struct(F.lit(aspect).alias("aspect"), F.lit(word).alias("keyword"))
    known = F.array(*[pair(a, w) for w, a in owner.items() if w not in packs.GENERAL_POSITIVE])
    low = F.lower(text)
    plain = F.filter(known, lambda x: F.contains(low, x["keyword"]) & ~T.negated_only(x["keyword"], low, packs.NEGATING_PREFIXES))
    rare = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)) & _holds(low, words), pair(a, w)) for w, a, words in packs.IN_CONTEXT]))
    return F.array_distinct(F.concat(plain, rare))


def clauses(text: Column) -> Column:
    """Clauses of a review, cut at stops and commas, too; none of a null or blank text."""
    found = T.clauses(F.regexp_replace(text, _U + r"^\s+|\s+$", ""), packs.CONJUNCTIONS, packs.ENDINGS, fine=True)
    return F.when(text.rlike(_U + r"\S"), found).otherwise(F.array().cast("array<string>"))


def by_clause(text: Column, registry: Registry) -> Column:
    """Of each clause that names an aspect: clause, aspects, sentiment and confidence."""
    judged = F.transform(clauses(text), lambda c: F.struct(c.alias("clause"), aspects(c, registry).alias("aspects"), of_text(c).alias("judged")))
    return F.filter(judged, lambda x: F.size(x["aspects"]) > 0)


def _names(found: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(found, lambda x: x["aspects"]["aspect"])))


def _of(found: Column, name: Column) -> Column:
    return F.filter(found, lambda x: F.array_contains(x["aspects"]["aspect"], name))


def _words(x: Column, name: Column) -> Column:
    return F.transform(F.filter(x["aspects"], lambda a: a["aspect"] == name), lambda a: a["keyword"])


def analysed(text: Column, registry: Registry) -> Column:
    """array<struct<aspect, opinion, sentiment, confidence, keywords>>: of an aspect's clauses the surest, first of equals, gives the polarity.

    Opinions are joined in order; keywords are distinct and sorted.  Texts under three characters have none.
    """

    def one(found: Column, name: Column) -> Column:
        def made(own: Column) -> Column:
            best = F.array_min(F.transform(own, lambda x, i: F.struct((-x["judged"]["confidence"]).alias("c"), i.alias("i"), x["judged"].alias("judged"))))
            return F.struct(
                name.alias("aspect"), F.array_join(F.transform(own, lambda x: x["clause"]), " / ").alias("opinion"), best["judged"]["sentiment"].alias("sentiment"), best["judged"]["confidence"].alias("confidence"),
                F.array_sort(F.array_distinct(F.flatten(F.transform(own, lambda x: _words(x, name))))).alias("keywords"),
            )

        return _let(_of(found, name), made)

    kept = F.when(F.length(F.trim(text)) >= 3, text)
    return _let(by_clause(kept, registry), lambda found: F.transform(_names(found), lambda n: one(found, n)))


def classified(text: Column, registry: Registry) -> Column:
    """map from aspect to keywords by polarity (positive, negative, neutral), conflicts resolved."""

    def one(found: Column, name: Column) -> Column:
        def words(own: Column, polarity: str) -> Column:
            return F.array_distinct(F.flatten(F.transform(F.filter(own, lambda x: x["judged"]["sentiment"] == polarity), lambda x: _words(x, name)))).alias(polarity)

        return F.struct(name.alias("key"), _let(_of(found, name), lambda own: F.struct(*[words(own, p) for p in ("positive", "negative", "neutral")])).alias("value"))

    tags = _let(by_clause(text, registry), lambda found: F.map_from_entries(F.transform(_names(found), lambda n: one(found, n))))
    return _let(F.struct(tags.alias("tags"), F.coalesce(text.rlike(_any(packs.CONCESSION)), F.lit(False)).alias("concession")), lambda x: S.resolve_conflicts(x["tags"], x["concession"]))


def rule_tag(word: Column, stem: Column, registry: Registry) -> Column:
    """The first tag whose keyword is the word, or its stem, or stands in it; null if none is."""
    first: dict[str, str] = {}
    for tag, words in registry.items():
        for w in words:
            first.setdefault(w.lower(), tag)
    table = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("tag")) for w, t in first.items()])
    low = F.lower(F.trim(word))
    inside = F.get(F.filter(pairs, lambda x: F.contains(low, x["word"])), F.lit(0))["tag"]
    return F.coalesce(F.element_at(table, low), F.element_at(table, stem), inside)


def hybrid(text: Column, words: Column, tag_of: Callable[[Column], Column], registry: Registry, most: int = 3) -> Column:
    """``classified`` with further keywords: those it lacks join the tag that tag_of gives them, with their polarity in the text.

    A keyword without a tag is left out; conflicts are resolved again, and each list keeps its first most keywords.
    """
    start = F.struct(classified(text, registry).alias("tags"), words.alias("words"))
    empty = F.array().cast("array<string>")
    none = F.struct(*[empty.alias(p) for p in ("positive", "negative", "neutral")])

    def joined(x: Column) -> Column:
        known = F.flatten(F.transform(F.map_values(x["tags"]), lambda v: F.concat(v["positive"], v["negative"], v["neutral"])))
        fresh = F.filter(F.array_distinct(F.coalesce(x["words"], empty)), lambda w: ~F.array_contains(known, w))
        more = F.filter(F.transform(fresh, lambda w: F.struct(w.alias("word"), tag_of(w).alias("tag"), of_keyword_in(w, text).alias("polarity"))), lambda m: m["tag"].isNotNull())

        def entry(tag: Column) -> Column:
            old = F.coalesce(F.element_at(x["tags"], tag), none)
            added = lambda p: F.transform(F.filter(more, lambda m: (m["tag"] == tag) & (m["polarity"] == p)), lambda m: m["word"])
            return F.struct(tag.alias("key"), F.struct(*[F.concat(old[p], added(p)).alias(p) for p in ("positive", "negative", "neutral")]).alias("value"))

        tags = F.array_distinct(F.concat(F.map_keys(x["tags"]), F.transform(more, lambda m: m["tag"])))
        return F.map_from_entries(F.transform(tags, entry))

    settled = S.resolve_conflicts(_let(start, joined), F.coalesce(text.rlike(_any(packs.CONCESSION)), F.lit(False)))
    return F.transform_values(settled, lambda _, v: F.struct(*[F.slice(v[p], 1, most).alias(p) for p in ("positive", "negative", "neutral")]))


def overview(tags: Column) -> Column:
    """struct(aspects, positive_aspects, negative_aspects, overall, confidence) of a map of tags; overall may be mixed, and the confidence is Laplace's."""
    entries = F.map_entries(tags)
    named = lambda keep: F.transform(F.filter(entries, keep), lambda e: e["key"])
    sizes = lambda e: (F.size(e["value"]["positive"]), F.size(e["value"]["negative"]))
    up, down = named(lambda e: sizes(e)[0] > sizes(e)[1]), named(lambda e: sizes(e)[1] > sizes(e)[0])
    facts = F.struct(F.map_keys(tags).alias("aspects"), up.alias("positive_aspects"), down.alias("negative_aspects"))

    def decide(f: Column) -> Column:
        p, n = F.size(f["positive_aspects"]), F.size(f["negative_aspects"])
        overall = F.when((p > 0) & (n > 0), "mixed").when(p > 0, "positive").when(n > 0, "negative").otherwise("neutral")
        settled = S.majority(p, n)
        sure = F.when(settled == "neutral", 0.5).otherwise(S.laplace(F.greatest(p, n), p + n))
        return F.struct(f["aspects"].alias("aspects"), f["positive_aspects"].alias("positive_aspects"), f["negative_aspects"].alias("negative_aspects"), overall.alias("overall"), settled.alias("sentiment"), sure.alias("confidence"))

    return _let(facts, decide)


def unified(text: Column, registry: Registry) -> Column:
    """struct(sentiment, confidence, method) of a text: its own rules and its aspects' overview in one; blank texts are neutral with 0."""
    facts = F.struct(of_text(text).alias("rule"), overview(classified(text, registry)).alias("tags"))
    got = _let(facts, lambda f: S.combined(f["rule"]["sentiment"], f["rule"]["confidence"], f["tags"]["sentiment"], f["tags"]["confidence"]))
    blank = text.isNull() | ~text.rlike(_U + r"\S")
    return F.when(blank, F.struct(F.lit("neutral").alias("sentiment"), F.lit(0.0).alias("confidence"), F.lit("empty").alias("method"))).otherwise(got)


def corrected(judged: Column, *ratings: Column) -> Column:
    """A judgement (sentiment, confidence, method) corrected by the ratings that aren't null."""
    return F.when(S.mean_rating(*ratings).isNull(), judged).otherwise(S.with_ratings(judged["sentiment"], judged["confidence"], *ratings))


def rated(text: Column, registry: Registry, *ratings: Column) -> Column:
    """struct(sentiment, confidence, method) of a text and its ratings in one: ``unified``, corrected by them."""
    return _let(unified(text, registry), lambda u: corrected(u, *ratings))
