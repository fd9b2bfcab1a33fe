"""Tables with columns under several names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], optional: dict[str, str] | None = None) -> DataFrame:
    """Select ``wanted`` (name -> known aliases, compared without case, blanks and BOM).

    A missing column is an error unless ``optional`` gives the type of its
    null column.
    """
    tidy = lambda s: s.strip().lstrip("﻿").lower()
    have = {tidy(c): c for c in reversed(df.columns)}
    out, missing = [], []
    for name, aliases in wanted.items():
        found = next((have[tidy(a)] for a in [*aliases, name] if tidy(a) in have), None)
        if found is not None:
            out.append(F.col(f"`{found}`").alias(name))
        elif optional and name in optional:
            out.append(F.lit(None).cast(optional[name]).alias(name))
        else:
            missing.append(name)
    if missing:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df.select(*out)
