"""Column expressions used by the operators.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probabilities are clipped to [EPS, 1 - EPS] before any logarithm.
EPS = 1e-15


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(*parts) -> Column:
    """First 8 hex digits of md5 of the '-'-joined parts, as a bigint.

    Stable across engines and partition layouts, so every split or fold
    built on it is reproducible. DuckDB twin:
    ``cast('0x' || substr(md5(concat_ws('-', ...)), 1, 8) as bigint)``.
    """
    text = F.concat_ws("-", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def flag(c, positive: str = "Yes") -> Column:
    """1 where the column equals ``positive``, else 0 (nulls included)."""
    return F.when(_col(c) == F.lit(positive), F.lit(1)).otherwise(F.lit(0))


def str_suffix(c, n: int) -> Column:
    """Last ``n`` characters; shorter strings whole, null stays null."""
    return F.right(_col(c), F.lit(n))


def str_prefix(c, n: int) -> Column:
    """First ``n`` characters."""
    return F.left(_col(c), F.lit(n))


def binarize(c, cut: float | None = 0.5, strict_above: bool = True) -> Column:
    """1 where the score is above ``cut`` (or below it when not strict_above); without a cut, 0."""
    cond = _col(c) > F.lit(cut) if strict_above else _col(c) < F.lit(cut)
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def clip_prob(c, eps: float = EPS) -> Column:
    return F.least(F.greatest(_col(c), F.lit(eps)), F.lit(1.0 - eps))


def inverse_log(c, eps: float = EPS) -> Column:
    """``1 / ln(p)`` with p clipped into (0, 1), so it never divides by 0."""
    return F.lit(1.0) / F.ln(clip_prob(c, eps))
