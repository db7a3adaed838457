"""Scalar functions: every one is a Column expression, so it stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "lenient_double", "lenient_int", "timestamp_from_parts", "scale", "iso_year", "iso_week", "iso_year_week",
    "log1p", "round_half_even", "parse_date", "format_date", "log_column_name", "log_name_expr", "clamp", "clamp_p",
    "significant", "vif_class", "stationarity_class", "linearity_class", "quantile_expr", "nan_to_null",
    "week_end_monday", "week_start_monday", "joined_key",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def joined_key(cols, sep: str = "|") -> Column:
    """One text key of several columns, different for different values: separator and backslash are escaped
    within a part, NULL is written \\N. Ordinary parts read a|b."""
    def part(c):
        text = F.replace(_c(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit(sep), F.lit("\\" + sep)), F.lit("\\N"))
    return F.concat_ws(sep, *[part(c) for c in cols]) if cols else F.lit("")


def nan_to_null(c) -> Column:
    """NaN is not 'missing' for Spark aggregates; make it NULL at the boundary."""
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def lenient_double(c) -> Column:
    """Bad text -> NULL (never raises under ANSI mode), NaN -> NULL."""
    return nan_to_null(_c(c).try_cast("double"))


def lenient_int(c) -> Column:
    """Numeric coercion to int; fractional text such as '2000.0' is accepted like a numeric parse."""
    d = lenient_double(c)
    return F.when(d == F.floor(d), d.try_cast("int"))


def timestamp_from_parts(year, month, day, hour, minute) -> Column:
    """Zone-less timestamp from parts; any bad or out-of-range part gives NULL."""
    return F.try_make_timestamp_ntz(
        lenient_int(year), lenient_int(month), lenient_int(day), lenient_int(hour), lenient_int(minute),
        F.lit(0).cast("decimal(16,6)"),
    )


def scale(c, divisor: float = 10.0) -> Column:
    """Unit scaling (tenths of a degree -> degree by default); divisor is a parameter."""
    return lenient_double(c) / F.lit(float(divisor))


def iso_year(d) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), F.to_date(_c(d))).cast("int")


def iso_week(d) -> Column:
    return F.weekofyear(F.to_date(_c(d))).cast("int")


def iso_year_week(d) -> Column:
    return iso_year(d) * 100 + iso_week(d)


def week_end_monday(d) -> Column:
    """Label of a Tuesday..Monday bin: the closing Monday (pandas ``resample('W-MON')``)."""
    return F.next_day(F.date_sub(F.to_date(_c(d)), 1), "Mon")


def week_start_monday(d) -> Column:
    """Label of a Monday..Sunday (ISO) week: its opening Monday."""
    return F.date_trunc("week", F.to_date(_c(d))).cast("date")


def log1p(c) -> Column:
    return F.log1p(_c(c))


def round_half_even(c, digits: int = 0) -> Column:
    return F.bround(_c(c), digits)


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(_c(c).cast("string"), fmt)


def format_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_c(c), fmt)


def log_column_name(name: str) -> str:
    """Name of a generated log column: LOG_<NAME upper-cased, spaces to underscores>."""
    return "LOG_" + name.upper().replace(" ", "_")


def log_name_expr(c) -> Column:
    """Column version of ``log_column_name`` for names held in data."""
    return F.concat(F.lit("LOG_"), F.upper(F.regexp_replace(_c(c), " ", "_")))


def clamp(c, lo=None, hi=None) -> Column:
    c = _c(c)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def clamp_p(c) -> Column:
    return clamp(c, 0.0, 1.0)


def significant(p, alpha: float = 0.05) -> Column:
    return _c(p) < F.lit(alpha)


# Fixed class labels and thresholds used by the diagnostics report.
VIF_OK, VIF_MODERATE, VIF_HIGH, VIF_NA = "OK", "Moderate", "High", "Could not calculate"
STATIONARY, PARTIAL, NON_STATIONARY = "Stationary", "Partially stationary", "Non-stationary"
LINEAR, NON_LINEAR = "Linear", "Non-linear"


def vif_class(v) -> Column:
    v = _c(v)
    return (F.when(v.isNull() | F.isnan(v), F.lit(VIF_NA))
            .when(v < 5, F.lit(VIF_OK))
            .when(v < 10, F.lit(VIF_MODERATE))
            .otherwise(F.lit(VIF_HIGH)))


def stationarity_class(adf_ok, kpss_ok) -> Column:
    a = F.coalesce(_c(adf_ok), F.lit(False))
    k = F.coalesce(_c(kpss_ok), F.lit(False))
    return F.when(a & k, F.lit(STATIONARY)).when(a | k, F.lit(PARTIAL)).otherwise(F.lit(NON_STATIONARY))


def linearity_class(is_linear) -> Column:
    return F.when(F.coalesce(_c(is_linear), F.lit(False)), F.lit(LINEAR)).otherwise(F.lit(NON_LINEAR))


def quantile_expr(c, q: float) -> Column:
    """Exact quantile with linear interpolation between order statistics; q is clamped to [0, 1]."""
    q = min(max(float(q), 0.0), 1.0)
    return F.percentile(_c(c), F.lit(q))
