"""Number rendering with script-language rounding.

``toFixed`` rounds the *exact* binary value of a double, ties away from zero:
``(0.35).toFixed(1)`` is ``0.3`` (0.35 is stored a little below), while
Spark's ``round`` and DuckDB's ``round`` give 0.4. The report text and the
rules that test a rounded percentage use these helpers.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, Dekker's splitting constant


def fixed_value(x: Column, digits: int) -> Column:
    """Spark twin of ``Number(x.toFixed(digits))`` for finite doubles.

    ``x * 10**digits`` is computed with its exact rounding error (Dekker
    two-product, the power of ten has few bits), so the half-way test is
    made on the exact value, as the script engine does.
    """
    scale = float(10 ** digits)
    a = F.abs(x)
    p = a * F.lit(scale)
    t = a * F.lit(_SPLIT)
    a_hi = t - (t - a)
    a_lo = a - a_hi
    err = (a_hi * F.lit(scale) - p) + a_lo * F.lit(scale)
    f = F.floor(p)
    frac = (p - f) + err
    n = f + F.when(frac >= F.lit(0.5), F.lit(1)).otherwise(F.lit(0))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.signum(x) * n / F.lit(scale))


def to_fixed(x: float, digits: int) -> str:
    """``x.toFixed(digits)`` on the driver (exact decimal of the double)."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    q = Decimal(1).scaleb(-digits)
    d = Decimal(x).copy_abs().quantize(q, rounding=ROUND_HALF_UP)
    s = f"{d:.{digits}f}"
    return ("-" + s) if x < 0 and d != 0 else s


def locale(x: float | int, max_fraction: int = 3) -> str:
    """``x.toLocaleString()`` in an en-US locale: grouped thousands, at most
    ``max_fraction`` fraction digits, trailing zeros dropped."""
    if isinstance(x, int):
        return f"{x:,}"
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "∞" if x > 0 else "-∞"
    q = Decimal(1).scaleb(-max_fraction)
    d = Decimal(x).copy_abs().quantize(q, rounding=ROUND_HALF_UP)
    whole, _, frac = f"{d:.{max_fraction}f}".partition(".")
    frac = frac.rstrip("0")
    body = f"{int(whole):,}" + (f".{frac}" if frac else "")
    return ("-" + body) if x < 0 and d != 0 else body
