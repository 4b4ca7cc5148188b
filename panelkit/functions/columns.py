"""Small column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def time_bucket(ts: str | Column, width_seconds: int) -> Column:
    """Fixed-width time bucket number; non-decreasing in ``ts``."""
    return F.floor(F.unix_seconds(col(ts).cast("timestamp")) / F.lit(width_seconds))


def magnitude_bucket(value: str | Column, per_octave: int = 4096) -> Column:
    """Order-preserving bucket of a double by sign and logarithm.

    The bucket is arithmetic, so no sampling pass is needed; 4096 buckets per
    doubling keep each bucket a small share of any spread-out distribution.
    """
    v = col(value).cast("double")
    # 2**-1100 is below the smallest double, so every non-zero level is >= 1.
    level = F.floor((F.log2(F.abs(v)) + F.lit(1100.0)) * F.lit(per_octave))
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, level).otherwise(-level)


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def floor_mod(x: Column, m: Column | float) -> Column:
    """Modulus with the sign of the divisor."""
    return F.pmod(x, m if isinstance(m, Column) else F.lit(m))


def circular_difference(a: Column, b: Column, period: float = 360.0) -> Column:
    """``a - b`` wrapped to [-period/2, period/2)."""
    half = period / 2.0
    return F.pmod(a - b + F.lit(half), F.lit(float(period))) - F.lit(half)


def slug(name: str | Column) -> Column:
    """Lower case, spaces to underscores: the join key of the dimension tables."""
    return F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))


def calendar(ts: str | Column, prefix: str = "") -> dict[str, Column]:
    """hour, dow (Monday = 0), month and a 0/1 weekend flag."""
    t = col(ts)
    dow = F.weekday(t)
    return {
        f"{prefix}hour": F.hour(t),
        f"{prefix}dow": dow,
        f"{prefix}month": F.month(t),
        f"{prefix}is_weekend": (dow >= 5).cast("int"),
    }


def hashed_integer(*parts: Column | int | str) -> Column:
    """Uniform integer in [0, 2**32) from an md5 of the parts joined by '|'.

    Unlike ``rand`` it depends on the row's own key only, so a recomputed task
    or another partitioning yields the same draw.
    """
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hashed_uniform(*parts: Column | int | str) -> Column:
    """Uniform double in (0, 1)."""
    return (hashed_integer(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def hashed_normal(*parts: Column | int | str) -> Column:
    """Standard normal draw by Box-Muller on two hashed uniforms."""
    u, v = hashed_uniform(*parts, "u"), hashed_uniform(*parts, "v")
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def significant(value: Column, size: Column, digits: int = 12) -> Column:
    """``value`` on the decimal grid of so many digits of ``size``, the typical magnitude of what it was made of."""
    scale = F.pow(F.lit(10.0), digits - F.ceil(F.log10(F.when(size > 0, size))))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)
