"""Character classes, kana and width conversion, affix tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = {
    "kanji": r"[\p{IsHan}々〆]",
    "hiragana": r"[\p{IsHiragana}ー]",
    "katakana": r"[\p{IsKatakana}ー]",
    "digit": r"\p{N}",
    "letter": r"\p{IsLatin}",
    "symbol": r"[\p{P}\p{S}]",
}

#: Classes of single characters of any script, for counts.
KINDS = {"upper": r"\p{Lu}", "lower": r"\p{Ll}", "digit": r"\p{N}", "symbol": r"[\p{P}\p{S}]"}

_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "


def all_of(c: Column, *classes: str) -> Column:
    """Whether the text is not empty and every character is of one of the classes."""
    return c.rlike("^(?:" + "|".join(CLASSES[x] for x in classes) + ")+$")


def ends_in(c: Column, name: str) -> Column:
    return c.rlike(CLASSES[name] + "$")


def char_class(c: Column) -> Column:
    """The class of all characters: the first that holds, `kana_kanji` for a mix of those, else `mixed`."""
    out = F.when(F.char_length(c) == 0, F.lit("none"))
    for name in CLASSES:
        out = out.when(all_of(c, name), F.lit(name))
    return out.when(all_of(c, "kanji", "hiragana", "katakana"), F.lit("kana_kanji")).otherwise("mixed")


def to_hiragana(c: Column) -> Column:
    return F.translate(c, _KATAKANA, _HIRAGANA)


def to_katakana(c: Column) -> Column:
    return F.translate(c, _HIRAGANA, _KATAKANA)


def to_half_width(c: Column) -> Column:
    return F.translate(c, _FULL, _HALF)


def to_full_width(c: Column) -> Column:
    return F.translate(c, _HALF, _FULL)


def count_of(c: Column, kind: str) -> Column:
    """How many characters of the text are of a kind, or of a class."""
    return F.regexp_count(c, F.lit(KINDS.get(kind) or CLASSES[kind]))


def is_single(c: Column) -> Column:
    return F.char_length(c) == 1


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters a and b share from the start."""
    n = F.least(F.char_length(a), F.char_length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: a.substr(F.lit(1), i) == b.substr(F.lit(1), i))
    return F.array_max(same)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def in_category(semantics: Column, category: str) -> Column:
    """Whether a `;`-separated list holds the category."""
    return F.array_contains(F.split(semantics, ";"), category)


#: A- < A < B- < B < B+ < C; levels that are missing come under `level_at_least`.
LEVELS = ["A-", "A", "B-", "B", "B+", "C"]


def level_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), c)


def level_at_least(a: Column, b: Column) -> Column:
    """Whether level a is b or stronger; a missing a holds, a missing b doesn't."""
    return F.when(a.isNull(), True).when(b.isNull(), False).otherwise(level_rank(a) >= level_rank(b))
