"""Column expressions on text: blanks, markup, dates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every Unicode white space character, as a Java character class body.
BLANK = r"\s\x1c-\x1f\u0085\p{Z}"

_DATE = (
    r"^(\d{4})(?:[-/.年](\d{1,2})[-/.月](\d{1,2})日?|(\d{2})(\d{2}))"
    r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)


#: The same characters one by one, for trimming without a pattern.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"[{BLANK}]+", "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def plain_title(c: Column) -> Column:
    """A title without markup tags and white space; null where nothing is left."""
    return F.nullif(without_blanks(without_tags(c)), F.lit(""))


def iso_date(c: Column) -> Column:
    """The day as YYYY-MM-DD whatever the notation; '' for null and blank; anything else as it stands, stripped."""
    s = F.coalesce(stripped(c), F.lit(""))
    joined = F.regexp_replace(s, _DATE, "$1-$2$4-$3$5")
    padded = F.regexp_replace(joined, r"-(\d)(?!\d)", "-0$1")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).when(s.rlike(_DATE), padded).otherwise(s)


def void_as_empty(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit(""))


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same values from different starts: a 128-bit key."""
    return F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit("lawmill"), *cols, F.lit(29))
