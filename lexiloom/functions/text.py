"""Tokens and white space with the reference semantics of Unicode, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character is a letter, a number or the underscore; white space as strip() and split() see it.
TOKEN = r"[\p{L}\p{N}_]+"
BLANKS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def pystrip(x: Column | str) -> Column:
    """x without white space at its ends (all of Unicode's, the no-break space included); NULL stays NULL."""
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def words(x: Column | str) -> Column:
    """x split at runs of white space; no empty parts, so "" gives an empty array."""
    return F.filter(F.split(pystrip(x), f"{WS}+"), lambda w: w != "")


def tokens(*fields: Column | str) -> Column:
    """Lower-case word tokens of the fields joined by a blank, in order. NULL fields are left out."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *fields)), F.lit(TOKEN), F.lit(0))


def is_alpha(x: Column | str) -> Column:
    """Whether x is letters only, and at least one."""
    return F.rlike(x if isinstance(x, Column) else F.col(x), F.lit(r"^\p{L}+$"))


def clean_token(x: Column | str) -> Column:
    """A stored token as it counts: stripped and in lower case; NULL if nothing is left."""
    return F.nullif(F.lower(F.btrim(x, F.lit(BLANKS))), F.lit(""))
