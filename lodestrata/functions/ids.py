"""Identifier clean-up shared by the operators: all JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters taken as outer blanks.
BLANKS = " \t\r\n\f\v"


def clean_id(col: Column | str) -> Column:
    """Trimmed, lower-case id; null where it is null or blank."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def id16(col: Column) -> Column:
    """A 16-byte key of an id string: joins and loops shuffle this instead of the long text."""
    return F.unhex(F.md5(col))


def micros(col: Column | str) -> Column:
    """Timestamp as microseconds; a timestamp without zone counts as UTC."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))
