"""Bounded training samples, checked broadcasts and the split that the contracts fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str) -> Column:
    """crc32 of the identifier as text, modulo 4; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(rows: DataFrame, by: str, keys: list[str], bound: int) -> tuple[DataFrame, dict]:
    """At most about ``bound`` rows of each value of ``by``, and the number of rows of each value.

    The rows whose hash of ``keys`` is smallest: deterministic, whatever the partitions. Rows that repeat all keys and ``by``
    count once, so that one repeated row cannot exceed the bound.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(by).count().collect()}  # a row a label value
    keep = F.lit(False)
    unit = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(1_000_003)) / 1_000_003.0
    for value, n in sizes.items():
        keep = keep | (F.col(by).eqNullSafe(F.lit(value)) & (unit < min(1.0, bound / n)))
    return rows.where(keep).dropDuplicates([by, *keys]), sizes
