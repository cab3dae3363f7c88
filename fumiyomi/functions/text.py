"""Column functions on text: what the rules share, all visible to the optimizer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMINATORS = "。！？!?"
#: All white space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def u_trim(c: Column) -> Column:
    """Trims all Unicode white space; trim() alone knows only the blank."""
    return F.btrim(c, F.lit(SPACES))


def is_heading(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*#{1,6}(?:[\t\n\f\r ]|\z)")


def heading_level(c: Column) -> Column:
    return F.length(F.regexp_extract(c, r"^(?U)\s*(#{1,6})(?:[\t\n\f\r ]|\z)", 1))


def heading_text(c: Column) -> Column:
    """Without the marks before and after."""
    body = F.regexp_replace(c, r"^(?U)\s*#{1,6}", "")
    return u_trim(F.regexp_replace(u_trim(body), r"#+\z", ""))


def is_list_item(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*(?:[-*+] |[0-9]+[.)][\t\n\f\r ])")


def is_quote(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*>")


def is_table(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*\|[^|]*\|") | (c.contains("|") & c.rlike(r"^(?U)[\s|:-]*\z"))


def is_reference(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*\[(?:[0-9]+\][ \t:]|\^[^\]]+\]:)")


def is_code_note(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*#[A-Z] ")


def is_embed(c: Column) -> Column:
    return c.rlike(r"^(?U)\s*\[https?://[^\]\n]+:embed:cite\]\z")


def is_blank(c: Column) -> Column:
    return u_trim(c) == ""


def occurrences(c: Column, phrase: str) -> Column:
    """How often a literal phrase stands in a text, without overlaps."""
    p = F.lit(phrase)
    return ((F.length(c) - F.length(F.replace(c, p, F.lit("")))) / len(phrase)).cast("long")


def any_of(phrases: list[str]) -> str:
    """A pattern that finds any of these literal phrases."""
    return "|".join("\\Q" + p + "\\E" for p in phrases)


def pattern_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def reading_length(c: Column) -> Column:
    return F.length(u_trim(F.regexp_replace(c, r"(?U)\s{2,}", " "))).cast("long")


def japanese_chars(c: Column) -> Column:
    return pattern_count(c, "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]")


def first_of(c: Column, words: list[str], test=lambda c, w: c.startswith(w)) -> Column:
    """The first word of a list, in its order, for which the test holds."""
    return F.coalesce(*[F.when(test(c, w), F.lit(w)) for w in words])


def script(c: Column) -> Column:
    """Script of a surface."""
    return (
        F.when(c.rlike(r"\A[一-鿿々]+\z"), "kanji")
        .when(c.rlike(r"\A[ぁ-ゟ]+\z"), "hiragana")
        .when(c.rlike(r"\A[゠-ヿ]+\z"), "katakana")
        .when(c.rlike(r"\A[\x00-\x7F]+\z"), "ascii")
        .otherwise("mixed_or_other")
    )


def half_up(c: Column, digits: int) -> Column:
    """Half away from zero, on the scaled value."""
    return F.signum(c) * F.floor(F.abs(c) * 10**digits + 0.5) / 10**digits


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the score interval; null without trials."""
    p = F.try_divide(k, n)
    centre = p + z * z / (2 * n)
    spread = z * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + z * z / (4 * n * n)))
    scale = 1 + z * z / n
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), (centre - spread) / scale)), F.when(some, F.least(F.lit(1.0), (centre + spread) / scale))


def escape_data(c: Column) -> Column:
    """For the text of an annotation line."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")], c)


def escape_property(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [(",", "%2C"), (":", "%3A")], escape_data(c))
