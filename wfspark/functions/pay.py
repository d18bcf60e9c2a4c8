"""Pay-band metrics as Column expressions: column, name or number in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | float | int


def col(x: Value) -> Column:
    """A name is a column; a number is a literal; NaN counts as missing."""
    out = x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
    return F.nanvl(out.cast("double"), F.lit(None).cast("double"))


def band_midpoint(band_min: Value, band_max: Value | None = None, spread: Value | None = None) -> Column:
    """Middle of a band given by its ends, or by its low end and relative width. A band that ends below its start raises."""
    low = col(band_min)
    if band_max is not None:
        high = col(band_max)
        return F.when(low > high, F.raise_error(F.lit("band_min is above band_max"))).otherwise((low + high) / 2)
    if spread is None:
        raise ValueError("band_max or spread is needed")
    width = col(spread)
    return F.when(width < 0, F.raise_error(F.lit("spread is negative"))).otherwise(low * (1 + width / 2))


def compa_ratio(salary: Value, midpoint: Value | None = None, band_min: Value | None = None, band_max: Value | None = None) -> Column:
    """Salary over the band's midpoint; null where that isn't positive."""
    if midpoint is None and (band_min is None or band_max is None):
        raise ValueError("midpoint or both ends of the band are needed")
    mid = col(midpoint) if midpoint is not None else band_midpoint(band_min, band_max)
    return F.when(mid > 0, col(salary) / mid)


def range_penetration(salary: Value, band_min: Value, band_max: Value) -> Column:
    """Place of a salary in its band: 0 at the low end, 1 at the high; null for a band without width."""
    low, high = col(band_min), col(band_max)
    return F.when(high > low, (col(salary) - low) / (high - low))


def pay_band_status(salary: Value, band_min: Value | None = None, band_max: Value | None = None) -> Column:
    """Quarter of the band, or which side of it; with no band the first value is a penetration already."""
    at = col(salary) if band_min is None else range_penetration(salary, band_min, band_max)
    return (
        F.when(at.isNull(), "Unknown")
        .when(at < 0, "Green-Circled (<Min)")
        .when(at < 0.25, "Q1: Developing (0-25%)")
        .when(at < 0.5, "Q2: Core Proficient (25-50%)")
        .when(at < 0.75, "Q3: Advanced (50-75%)")
        .when(at <= 1, "Q4: Senior Cap (75-100%)")
        .otherwise("Red-Circled (>Max)")
    )


def red_circled(salary: Value, band_max: Value | None = None) -> Column:
    """Above the band; false where unknown."""
    return F.coalesce(col(salary) > (col(band_max) if band_max is not None else 1.0), F.lit(False))


def green_circled(salary: Value, band_min: Value | None = None) -> Column:
    """Below the band; false where unknown."""
    return F.coalesce(col(salary) < (col(band_min) if band_min is not None else 0.0), F.lit(False))
