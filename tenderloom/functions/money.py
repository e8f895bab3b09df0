"""Money is double in the notice schema; sums are taken as decimal so that the
result does not depend on the order in which partitions arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"


def as_money(col: Column | str) -> Column:
    return _col(col).cast(MONEY)


def clamp(col: Column | str, keep_null: bool = False) -> Column:
    """Negative sentinels become 0; null becomes 0 too unless ``keep_null``."""
    c = _col(col)
    if keep_null:
        return F.when(c < 0, F.lit(0.0)).otherwise(c)
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def to_double(col: Column | str, digits: int = 2) -> Column:
    """Rounded decimal sum back to the double of the output contract."""
    return F.round(_col(col), digits).cast("double")


def lot_value(amount: Column, is_percent: Column, total_budget: Column, percent_scale: str = "0.01") -> Column:
    """Money value of a lot: a percentage is taken of the notice's budget.

    ``percent_scale`` is 0.01 for amounts given in percent; pass "1" for data in
    which the amount is already a fraction.
    """
    scaled = (
        amount.cast("decimal(16,4)") * F.lit(percent_scale).cast("decimal(3,2)")
    ).cast("decimal(18,6)") * clamp(total_budget, keep_null=True).cast("decimal(18,4)")
    return F.when(is_percent, scaled.cast("decimal(36,10)")).otherwise(
        as_money(amount).cast("decimal(36,10)")
    )


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
