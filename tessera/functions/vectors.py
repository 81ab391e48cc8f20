"""Vector arithmetic over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import UNIT_TOLERANCE


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def norm(u: Column) -> Column:
    return F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(u: Column, v: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(u) * norm(v)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(u, v) / n)


def l2_normalize(u: Column) -> Column:
    """Unit length; vectors of no or no finite length raise an error."""
    n = norm(u)
    bad = n.isNull() | F.isnan(n) | (n == 0) | (n == float("inf"))
    return F.when(bad, F.raise_error(F.lit("vector cannot be normalised")).cast("array<double>")).otherwise(F.transform(u, lambda x: x.cast("double") / n))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def distance_to_similarity(d: Column, space: str, u: Column | None = None, v: Column | None = None) -> tuple[Column, Column]:
    """(clamped, raw) similarity. ``space`` is cosine, ip or l2 (squared); with l2 and vectors given, their true cosine."""
    if space in ("cosine", "ip"):
        raw = 1 - d
    elif space == "l2":
        raw = cosine(u, v) if u is not None and v is not None else 1 - d / 2
    else:
        raise ValueError(f"unknown space {space!r}")
    return clamp01(raw), raw


def is_unit(u: Column) -> Column:
    return F.abs(norm(u) - 1) < UNIT_TOLERANCE


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
