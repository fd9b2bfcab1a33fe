"""Family names in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


BLANKS = " \t\n\x0b\f\r"


def clean_name(c: Column | str) -> Column:
    """Outer blanks off, upper case, trailing version (point and digits) off.

    Null, an empty name and ``N/A`` mean a missing name: null.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.upper(F.btrim(c, F.lit(BLANKS)))
    s = F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.[0-9]+$", "")).otherwise(s)  # few names have a version
    return F.when((s != "") & (s != "N/A"), s)


#: The same rule as SQL text; {c} is the column.
CLEAN_NAME_SQL = r"nullif(nullif(regexp_replace(upper(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '\.[0-9]+$', ''), ''), 'N/A')"
