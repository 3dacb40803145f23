"""String expressions of ingestion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNKNOWN

#: All Unicode white space, at both ends; trim() knows U+0020 only.
_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space at the ends; the pattern tries every character, so texts that begin and end with visible ASCII pass it by."""
    visible = lambda at: F.substring(c, at, 1).between("!", "~")
    return F.when(visible(1) & visible(-1), c).otherwise(F.regexp_replace(c, _ENDS, ""))


def first_filled(*columns: Column) -> Column:
    """The first non-empty of the columns, else the default; the choice is made before stripping."""
    return strip(F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(UNKNOWN)))


def resource_type(op: Column) -> Column:
    """An operation without its last segment; all of it if it has one segment."""
    return F.regexp_replace(op, "/[^/]*$", "")


def header(raw: str) -> str:
    return raw.strip().lower().replace(" ", "_").replace("-", "_")
