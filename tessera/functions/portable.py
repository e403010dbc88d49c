"""Numbers that come out alike in any engine: scaled to whole numbers, rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micro(col: Column | str) -> Column:
    """Millionths as a whole number; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c.cast("double") * 1e6 + 0.5).cast("long")


def cents(col: Column | str) -> Column:
    """Hundredths as a whole number, so that sums don't depend on their order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c.cast("double") * 100 + 0.5).cast("long")
