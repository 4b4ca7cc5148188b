"""Presentation of result columns for comparison between engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
# Decimal averages often end exactly on a rounding tie, where the last bit of
# the double decides.  A shift far below the printed digits settles ties the
# same way in every engine.
TIE_SHIFT = 1e-10


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, widen integers and print timestamps as text."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if t in ("double", "float"):
            c = F.round(c + F.lit(TIE_SHIFT), digits) + F.lit(0.0)
        elif t in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        elif t in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif t == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)
