"""What generated summaries must keep to: number of sentences and characters, words, and no marks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sentences


@dataclass(frozen=True)
class Bounds:
    least_chars: int
    most_chars: int
    least_sentences: int
    most_sentences: int


# Bounds by mode.
BOUNDS = {"summary": Bounds(100, 350, 3, 8), "report": Bounds(200, 800, 3, 20), "operational": Bounds(150, 450, 3, 10)}
# Words that a summary must not hold.
FORBIDDEN = ("최고", "완벽", "강력추천", "무조건", "대박", "짱", "굿", "베스트", "넘버원")
#: Bold, italic, headings, links, code, bullets, numbers at line starts and section titles.  Each tells whether there is a mark, so what must
#: not stand beside one is taken with it, and no pattern looks around; W is a letter, digit or underscore.
_W = r"\p{L}\p{N}_"
MARKS = (
    r"\*\*[^*]+\*\*", r"__[^_]+__", rf"(?:^|[^{_W}])\*[^*]+\*(?:[^{_W}]|$)", rf"#+\s+[{_W}]", r"\[.+\]\(.+\)", r"`[^`]+`", r"^\s*[-*•]\s+", r"^\s*\p{Nd}+\.\s+", r"\[[^\]]{2,}\]",
)
# Ranges of emoji.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"


#: A character that a text with the mark must have, for each of the marks; texts without it aren't searched.
_SIGNS = ("**", "__", "*", "#", "](", "`", None, ".", "[")


def marked(text: Column) -> Column:
    """Whether a text has marks or emoji."""
    found = text.rlike(EMOJI)
    for sign, pattern in zip(_SIGNS, MARKS, strict=True):
        here = text.rlike("(?m)" + pattern)
        found = found | (here if sign is None else F.contains(text, F.lit(sign)) & here)
    return found


def errors(text: Column, mode: str = "summary", forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    """What is wrong with a summary, in order: empty, or few or many sentences (ended by full stops), few or many characters, forbidden words, marks."""
    b = BOUNDS[mode]
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")

    def judged(x: Column) -> Column:
        body, n, length, words = x["body"], x["n"], x["length"], x["words"]
        found = F.array_compact(F.array(
            F.when(n < b.least_sentences, F.concat(F.lit("few sentences: "), n.cast("string"))).when(n > b.most_sentences, F.concat(F.lit("many sentences: "), n.cast("string"))),
            F.when(length < b.least_chars, F.concat(F.lit("few characters: "), length.cast("string"))).when(length > b.most_chars, F.concat(F.lit("many characters: "), length.cast("string"))),
            F.when(F.size(words) > 0, F.concat(F.lit("forbidden: "), F.array_join(words, ", "))), F.when(marked(body), F.lit("marks")),
        ))
        return F.when(F.coalesce(body, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(found)

    def measured(body: Column) -> Column:
        low = F.lower(body)
        words = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in forbidden]))
        return F.struct(body.alias("body"), sentences(body).alias("n"), F.length(body).alias("length"), words.alias("words"))

    # Each step is worked out once and handed on
    return F.transform(F.transform(F.array(trimmed), measured), judged)[0]
