"""Text functions as Column -> Column, with Unicode classes and without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of list markers and prefixes, of space and of closing marks below decide results.
#: One character of a word, one of anything else, white space.
W, N, S = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]", r"[\s ]"


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it, in its own lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def group(c: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match, null without one or if it is empty."""
    return null_if_empty(F.regexp_extract(c, pattern, index))


def strip(c: Column, chars: str = r"\s ") -> Column:
    """c without the characters of a class at both ends."""
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def block_text(c: Column) -> Column:
    """No-break spaces and tabs become spaces, runs of spaces one; line feeds stay."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]", " "), " {2,}", " "))


def collapsed(c: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{S}+", " "))


#: Characters whose full case folding is not their lower case, to one character and to several.
_FOLDED = {c: c.casefold() for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.casefold() != c.lower()}
_ONE = {c: f for c, f in _FOLDED.items() if len(f) == 1 and len(c.lower()) == 1}
_SEVERAL = {c: f for c, f in _FOLDED.items() if c not in _ONE}


def folded(c: Column) -> Column:
    """Full case folding: lower case, but for the characters that fold otherwise, such as the sharp s to ss.

    Texts of ASCII alone, and those without such characters, cost no more than their lower case and a scan.
    """
    low = F.lower(c)
    one = F.translate(low, "".join(_ONE), "".join(_ONE.values()))
    pairs = F.split(F.lit("\n".join(a + b for a, b in _SEVERAL.items())), "\n")
    several = F.aggregate(pairs, one, lambda s, p: F.replace(s, F.substring(p, 1, 1), F.substr(p, F.lit(2))))
    plain = F.octet_length(low) == F.char_length(low)
    return F.when(plain, low).when(F.translate(low, "".join(_SEVERAL), "") == low, one).otherwise(several)


def whole_word(words: list[str]) -> str:
    """Pattern for any of the words as a whole, any case; matches what stands before, too."""
    return rf"(?iu)(?:^|{N})(?:{'|'.join(words)})(?:{N}|$)"


def cut_at_word(words: list[str]) -> str:
    """Pattern with groups: before the first of the words, the word, after it."""
    return rf"(?ius)^((?:.*?{N})??)({'|'.join(words)})((?:{N}.*)?)$"


def word_total(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0)))


def preview(c: Column, size: int = 120) -> Column:
    return null_if_empty(F.substring(strip(F.coalesce(c, F.lit(""))), 1, size))


def joined(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > "))


def requirement_text(c: Column) -> Column:
    """One line, without a list marker, spaces before punctuation, and one closing colon or semicolon."""
    out = F.regexp_replace(collapsed(c), r"^(?:[-•–]|[0-9]+[.)]|[A-Za-zА-Яа-я]\))\s+", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+([:;,.])", "$1"), r"[:;]$", "")
    return strip(out)


def list_marker(c: Column) -> Column:
    """The first of a lettered, numbered or bulleted marker that white space follows."""
    patterns = (r"^\s*([A-Za-zА-Яа-я]\))\s+", r"^\s*([0-9]+[.)])\s+", r"^\s*([-•–])\s+")
    return F.coalesce(*[group(c, p) for p in patterns])
