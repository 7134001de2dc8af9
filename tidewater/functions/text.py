"""Text expressions on columns.

Java's patterns get ``(?U)(?d)`` where white space is meant as Unicode's and the dot as everything but a line feed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNICODE = "(?U)(?d)"


def quoted(words: Sequence[str]) -> str:
    """A pattern that matches any of the words."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def strip_html(text: Column) -> Column:
    """Tags become spaces, NUL goes, runs of white space become one space, ends are trimmed."""
    plain = strip_nul(F.regexp_replace(text, "<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(plain, _UNICODE + r"\s{2,}", " "), _UNICODE + r"^\s+|\s+$", "")


def strip_markdown(text: Column) -> Column:
    """Headings, emphasis, code, links, list marks, quotes and rules give way to their text."""
    passes = (
        (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^[-*+]\s+", ""), (r"(?m)^>\s?", ""), (r"(?m)^-{3,}$", ""),
    )
    for pattern, new in passes:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def strip_report_marks(text: Column) -> Column:
    """A report without section brackets, bold and italic stars, bullets, numbers at line starts, headings, and surplus blank lines and spaces."""
    passes = (
        (r"\[([^\]]+)\]", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"(?<!\w)\*([^*]+)\*(?!\w)", "$1"), (r"(?m)^\s*[-*•]\s+", ""),
        (r"(?m)^\s*\d+\.\s+", ""), (r"(?m)^#+\s+", ""), (r"\n{2,}", "\n"), (r"  +", " "), (r"^\s+|\s+$", ""),
    )
    for pattern, new in passes:
        text = F.regexp_replace(text, _UNICODE + pattern, new)
    return text


def replaced(text: Column, names: Mapping[str, str]) -> Column:
    """Each name replaced by its new one, in order; texts without any are left as they are."""
    out = text
    for old, new in names.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(text.rlike(quoted(list(names))), out).otherwise(text)


def first_non_blank(*texts: Column) -> Column:
    """The first text that has more than white space."""
    return F.coalesce(*[F.when(t.rlike(_UNICODE + r"\S"), t) for t in texts])


def split_brand(model: Column, brands: Sequence[tuple[str, str]]) -> Column:
    """A model's name with its brand apart: the first prefix of (prefix, brand) that isn't the whole name."""
    cases = [F.when(F.startswith(model, F.lit(p)) & (F.length(model) > len(p)), F.concat(F.lit(b + " "), F.ltrim(F.substr(model, F.lit(len(p) + 1))))) for p, b in brands]
    return F.coalesce(*cases, model)


def corrected_numbers(text: Column, known: Column, unit: str = "건", off: float = 0.05, least: int = 10) -> Column:
    """Counts such as ``1,234건`` that are within a share of a known number, and none themselves, replaced by the nearest, the smaller of equals."""
    between, found = F.split(text, f"[0-9,]+{unit}", -1), F.regexp_extract_all(text, F.lit(f"([0-9,]+){unit}"), F.lit(1))
    valid = F.filter(known.cast("array<bigint>"), lambda n: n >= least)

    def one(raw: Column) -> Column:
        n = F.replace(raw, F.lit(","), F.lit("")).try_cast("bigint")
        near = F.array_min(F.transform(F.filter(valid, lambda c: F.abs(n - c) / c <= off), lambda c: F.struct(F.abs(n - c).alias("far"), c.alias("c"))))["c"]
        shown = F.when(F.contains(raw, F.lit(",")), F.format_number(near, 0)).otherwise(near.cast("string"))
        return F.concat(F.when((n >= least) & ~F.array_contains(valid, n) & near.isNotNull(), shown).otherwise(raw), F.lit(unit))

    pieces = F.zip_with(between, F.transform(found, one), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))


def keywords(text: Column, pattern: str = "[가-힣]{2,}", stop: Sequence[str] = (), least: int = 2) -> Column:
    """Matches of a pattern, in order, without stop words and shorter ones."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= least)
    return F.filter(found, lambda w: ~w.isin(list(stop))) if stop else found


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased text holds any of the words."""
    return F.lower(text).rlike(quoted([w.lower() for w in words]))


def clauses(text: Column, conjunctions: Sequence[str], endings: Sequence[str] = (), fine: bool = False, least: int = 3, space: str = r"\s", alone: bool = True) -> Column:
    """Clauses of a text: cut at conjunctions (dropped) between white space, then after connective endings, and, if fine, after stops and commas.

    Clauses are trimmed of spaces and those under least characters go; a text of which none is left is its own clause if it is long enough, unless alone is
    false.  White space around conjunctions is Unicode's, or what another pattern states.
    """
    parts = F.split(text, _UNICODE + f"{space}+(?:" + "|".join(conjunctions) + f"){space}+")
    if endings:
        parts = F.flatten(F.transform(parts, lambda x: F.split(F.regexp_replace(x, _UNICODE + r"((?<=[가-힣])(?:" + "|".join(endings) + r"))\s+", "$1\u0001"), "\u0001")))
    if fine:
        parts = F.flatten(F.transform(parts, lambda x: F.split(x, _UNICODE + r"[.!?]\s+|,\s+")))
    # Not F.trim itself: transform would pass the place as the characters to trim
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    if not alone:
        return parts
    whole = F.when(F.length(F.trim(text)) >= least, F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def stem(word: Column, suffixes: Sequence[str]) -> Column:
    """A word without its longest suffix of the list that leaves a character."""
    tail = "|".join(sorted(suffixes, key=len, reverse=True))
    return F.when(F.trim(word) == "", word).otherwise(F.regexp_replace(word, r"(?s)^(.+?)(?:" + tail + r")$", "$1"))


def matched_words(text: Column, words: Sequence[str]) -> Column:
    """The words of a dictionary that the text holds, in the dictionary's order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def negated_only(word: Column, text: Column, prefixes: Sequence[str]) -> Column:
    """Whether the text holds the word only behind one of the prefixes."""
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.contains(text, F.concat(p, word)) & ~F.contains(F.replace(text, F.concat(p, word), F.lit("")), word))


def matches(text: Column, pattern: str) -> Column:
    """Number of matches, not overlapping."""
    return F.regexp_count(text, F.lit(_UNICODE + pattern))


def count_of(text: Column, word: str) -> Column:
    """How often the text holds a word, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def sentences(text: Column) -> Column:
    """Number of non-blank parts between full stops."""
    return F.size(F.filter(F.split(text, r"\."), lambda s: s.rlike(_UNICODE + r"\S")))


def first_containing(text: Column, words: Sequence[str], default: str | None = None) -> Column:
    """The first word of an ordered list that the text holds."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(default))


def branch_name(company: Column, name: Column, most: int = 100) -> Column:
    return F.left(F.trim(F.concat_ws(" ", company, name)), F.lit(most))


def excerpt(text: Column, most: int = 250) -> Column:
    return F.left(text, F.lit(most))


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r'[\\/:*?"<>|]', "_")
