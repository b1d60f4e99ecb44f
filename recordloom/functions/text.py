"""Text, number and date expressions on all-text columns.

Everything here is a Catalyst expression over one column: no UDF, so a filter or
projection built from it stays inside one code-generated stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_CLASS = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
INVISIBLE_PATTERN = r"\A[" + _SPACE_CLASS + r"\p{Cf}]*\z"
NUMBER_PATTERN = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE_PATTERN = (
    r"\A(?:([0-9]{4})(?:-([0-9]{1,2})-([0-9]{1,2})|/([0-9]{1,2})/([0-9]{1,2})"
    r"|\.([0-9]{2})\.([0-9]{2})|([0-9]{2})([0-9]{2}))|[\s\S]*)\z"
)
INFINITY_PATTERN = r"\A[+-]?(?i:inf|infinity)\z"


def trim_text(c: Column) -> Column:
    """Unicode trim; null reads as the empty string.

    ``trim`` with an explicit character list walks in from both ends, which is
    cheaper than a regular expression and, unlike plain ``trim``, knows more
    than U+0020. It mentions ``c`` once, so it nests without growing.
    """
    return F.trim(F.coalesce(c, F.lit("")), F.lit(WHITESPACE))


def trim_key(c: Column) -> Column:
    """The same value as :func:`trim_text`, faster on a plain column.

    A first and a last character in the visible ASCII range settle nearly every
    key. It mentions ``c`` several times: meant for stored key columns, which
    every row evaluates, not for nesting.
    """
    text = F.coalesce(c, F.lit(""))
    last = F.substring(text, -1, 1)
    tidy = text.between("!", "~") & last.between("!", "~")
    return F.when(tidy, text).otherwise(F.trim(text, F.lit(WHITESPACE)))


def is_blank(c: Column) -> Column:
    """No visible character: null, white space, or invisible format characters.

    A first character in the visible ASCII range settles nearly every cell
    before the regular expression is reached.
    """
    return (
        F.when(c.isNull() | (c == ""), True)
        .when(c.between("!", "~"), False)
        .otherwise(c.rlike(INVISIBLE_PATTERN))
    )


def is_empty(c: Column, empty_words: Iterable[str] = ()) -> Column:
    """Blank after trimming, or one of the configured words such as NA."""
    text = trim_text(c)
    words = [w.strip(WHITESPACE) for w in empty_words if w is not None]
    return text.isin("", *words)


def to_number(c: Column) -> Column:
    """Trim, drop thousands commas, parse; anything unparsable is null.

    The pattern keeps out spellings that only the engine's cast knows (``1d``);
    a decimal too large for a double is unparsable, a spelled infinity is not.
    """
    text = F.replace(trim_text(c), F.lit(","), F.lit(""))
    number = text.try_cast("double")
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return F.when(text.rlike(NUMBER_PATTERN), finite).when(
        text.rlike(INFINITY_PATTERN), number
    )


def parse_date(c: Column) -> Column:
    """Date part of y-m-d, y/m/d, y.mm.dd or yyyymmdd; null when unparsable.

    One replacement writes any of the four spellings as y-m-d and everything
    else as something that is no date.
    """
    head = F.substring_index(F.substring_index(trim_text(c), " ", 1), "T", 1)
    dashed = F.regexp_replace(trim_text(head), DATE_PATTERN, "$1-$2$4$6$8-$3$5$7$9")
    return dashed.try_cast("date")


def map_values(c: Column, value_map: Mapping[str, str]) -> Column:
    """Exact, untrimmed replacement; blank cells and blank targets change nothing."""
    kept = {
        source: target
        for source, target in value_map.items()
        if not _blank_text(source) and not _blank_text(target)
    }
    if not kept:
        return c
    lookup = F.create_map(*[F.lit(part) for pair in kept.items() for part in pair])
    return F.coalesce(F.try_element_at(lookup, c), c)


def accepted(c: Column, allowed: Iterable[str]) -> Column:
    """Blank, or equal to an allowed spelling after trimming, in any case."""
    text = trim_text(c)
    spellings = sorted({a.strip(WHITESPACE).lower() for a in allowed})
    return (text == "") | F.lower(text).isin(spellings)


def _blank_text(value: str | None) -> bool:
    import unicodedata

    return all(ch in WHITESPACE or unicodedata.category(ch) == "Cf" for ch in value or "")
