"""Small column helpers shared by all expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x, low=None, high=None) -> Column:
    """Bounded value; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    x = as_col(x)
    out = x
    if high is not None:
        out = F.least(out, as_col(high))
    if low is not None:
        out = F.greatest(out, as_col(low))
    return F.when(x.isNotNull(), out)


def bound(x, low, high) -> Column:
    """Bounded value of an expression known to be non-null (names ``x`` once, so nesting stays
    small in generated code)."""
    return F.greatest(F.least(as_col(x), as_col(high)), as_col(low))


def nan_to_null(x) -> Column:
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def safe_ratio(a, b, otherwise=None) -> Column:
    """a / b where b > 0."""
    a, b = as_col(a), as_col(b)
    ratio = F.when(b > 0, a / b)
    return ratio if otherwise is None else ratio.otherwise(otherwise)


def round6(x) -> Column:
    """Six decimals, ties up. Written with floor so that any SQL engine gives the same digits."""
    return F.floor(as_col(x) * 1000000.0 + 0.5001) / 1000000.0


def fixed_rows(rows, names) -> Column:
    """Array literal of a small fixed table, for ``explode`` or a lookup by position."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def with_fixed_rows(df, rows, names):
    """Every row of ``df`` next to every row of a small fixed table; no join is planned."""
    return df.select("*", F.explode(fixed_rows(rows, names)).alias("_fixed")).select("*", "_fixed.*").drop("_fixed")


def share(condition) -> Column:
    """Fraction of rows for which a non-null condition holds."""
    return F.avg(as_col(condition).cast("double"))
