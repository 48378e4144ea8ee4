"""String, date and number expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts a data frame CSV reader takes for null by default.
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def strip(c: Column) -> Column:
    """Remove white space of every kind from both ends.

    Trimming by a set of characters is slow and only done for texts with more
    than plain spaces around them.
    """
    plain, all_kinds = F.trim(c), F.lit(WHITESPACE)
    rest = F.contains(all_kinds, F.substring(plain, 1, 1)) | F.contains(all_kinds, F.substring(plain, -1, 1))
    return F.when(rest, F.btrim(c, all_kinds)).otherwise(plain)


def strip_or_empty(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column) -> Column:
    """Keep the text as it is, but turn blank text into null."""
    return F.when(strip(c) != "", c)


def tokens_to_null(c: Column, tokens: Iterable[str] = CSV_NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def title_case(c: Column) -> Column:
    """Capitalise the first letter after every character that has no case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substr(run, F.lit(2)))), ""
    )


def is_two_letters(c: Column) -> Column:
    return c.rlike(r"^\p{L}{2}$")


def full_name(first: Column, last: Column) -> Column:
    def part(c: Column) -> Column:
        return F.nullif(strip(c), F.lit(""))

    return F.concat_ws(" ", part(first), part(last))


def label(name: Column, country: Column) -> Column:
    """``name  [country]``, null when either part is null."""
    return F.concat(name, F.lit("  ["), country, F.lit("]"))


def parse_date(c: Column) -> Column:
    """A date from ``yyyy-MM-dd`` or ``yyyy-M-d``; anything else becomes null."""
    return F.try_to_date(strip(c), "yyyy-M-d")


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def fold_ascii(c: Column) -> Column:
    """Lower-case A to Z only; accented letters keep their case."""
    return F.translate(c, _UPPER, _UPPER.lower())


def like_pattern(keyword: str) -> str:
    """The substring pattern for a keyword; its own ``%`` and ``_`` stay wildcards."""
    return "%" + "".join(ch.lower() if ch in _UPPER else ch for ch in keyword) + "%"


def matches_keyword(c: Column, keyword: str) -> Column:
    """ASCII-case-insensitive LIKE in which no character escapes another."""
    escape = next(ch for ch in "~^!|\x01\x02\x03" + "".join(map(chr, range(0x100, 0x2000))) if ch not in keyword)
    return F.like(fold_ascii(c), F.lit(like_pattern(keyword)), F.lit(escape))


def share(part: Column, total: Column, digits: int) -> Column:
    """Percent of a total in floating point, null for an empty total."""
    return F.round(F.try_divide(part * F.lit(100.0), total), digits)


def thousands(c: Column) -> Column:
    return F.format_string("%,d", c)


def percent(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", c)


def pad_right(c: Column, width: int) -> Column:
    """Pad with spaces on the right; longer text is kept whole."""
    return F.format_string(f"%-{width}s", c)


def pad_left(c: Column, width: int) -> Column:
    return F.format_string(f"%{width}s", c)


def scaled_bar_length(c: Column, largest: Column, width: int = 30) -> Column:
    return (F.try_divide(c.cast("double"), largest) * F.lit(width)).cast("int")


def bar(length: Column) -> Column:
    return F.repeat(F.lit("█"), length)
