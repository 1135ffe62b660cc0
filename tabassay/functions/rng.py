"""Random numbers as functions of a row's key: equal on any partitioning, and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(parts: tuple) -> Column:
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) from the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal draw from two uniforms of the parts (Box-Muller)."""
    u1, u2 = uniform(*parts, "a"), uniform(*parts, "b")
    return F.sqrt(F.lit(-2.0) * F.ln(F.greatest(u1, F.lit(1e-12)))) * F.cos(F.lit(2.0) * F.pi() * u2)


def order_key(*parts: Column | str | int) -> Column:
    """Hexadecimal sort key for a shuffle by hash."""
    return F.md5(_key(parts))
