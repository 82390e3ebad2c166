"""Text expressions. All of them keep null as null and turn blanks into null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What a Unicode-aware strip removes. As a plain character set it needs no pattern to trim.
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
           + "\u2028\u2029\u202f\u205f\u3000")
# The same characters as ranges: a pattern tests each range once, not each character.
_SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Characters a location may keep.
_ILLEGAL_IN_LOCATION = r"[^A-Z0-9,()&/ .'-]"


def trimmed(c: Column) -> Column:
    """Without surrounding whitespace; an empty rest stays."""
    return F.btrim(c, F.lit(_BLANKS))


def strip_blank(c: Column) -> Column:
    """Trim all surrounding whitespace; an empty rest is missing."""
    return F.nullif(trimmed(c), F.lit(""))


def upper_text(c: Column) -> Column:
    return F.upper(c)


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}+", " ")


def tidy_commas(c: Column) -> Column:
    return F.regexp_replace(c, f"{_SPACE}*,{_SPACE}*", ", ")


def drop_illegal(c: Column) -> Column:
    return F.regexp_replace(c, _ILLEGAL_IN_LOCATION, "")


def normalize_location(c: Column) -> Column:
    """Upper-case, single-spaced location with ``", "`` commas and legal characters only.

    Illegal characters go last, so the blanks around them stay.
    """
    text = upper_text(strip_blank(c))
    return F.nullif(drop_illegal(tidy_commas(collapse_spaces(text))), F.lit(""))


def clean_gender(c: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(c, f"^{_SPACE}*([MFmf]){_SPACE}*$", 1)), F.lit(""))


def trailing_number(c: Column) -> Column:
    """Digits at the end of a text as int (``n_clusters=3`` -> 3)."""
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).try_cast("int")


def display_name(c: Column) -> Column:
    """``01_portfolio_overview`` -> ``01 Portfolio Overview``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def contains_pattern(c: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; null never matches."""
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))
