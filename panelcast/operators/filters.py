"""Row filters with the cleaning layer's coercion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import lenient_int
from panelcast.sources.readers import require_columns

__all__ = ["filter_upper_equals", "year_at_least"]


def filter_upper_equals(df: DataFrame, col: str, code: str) -> DataFrame:
    """Keep rows whose upper-cased text equals ``code`` upper-cased; a missing column is an error."""
    require_columns(df, [col])
    return df.filter(F.upper(F.col(col).cast("string")) == F.lit(code.upper()))


def year_at_least(df: DataFrame, col: str, year: int) -> DataFrame:
    """Numeric coercion first (bad text -> NULL -> dropped), then the lower bound. A lenient cast is not pushed to the scan."""
    return df.filter(lenient_int(col) >= F.lit(int(year)))
