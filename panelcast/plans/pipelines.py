"""End-to-end jobs: the VAR report (load -> fit -> forecast -> Granger -> IRF) and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.forecast import forecast
from panelcast.operators.granger import granger_matrix
from panelcast.operators.interp import interpolate_linear
from panelcast.operators.irf import irf
from panelcast.operators.var import fit_var
from panelcast.plans import derived as D
from panelcast.session import cut_lineage
from panelcast.sources.sinks import forecast_wide
from panelcast.spec import Det, VarSpec

FLAG_VARS = ["qty", "price", "disc"]


def flag_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly lineitem panel per return flag: quantity, revenue (millions), mean discount; weeks
    without any line (mean undefined) are filled by linear interpolation along the series.

    The panel is tiny next to its source (one row per flag and week), so it is written once
    to the checkpoint folder: fit, forecast, residuals and bootstrap then reuse it instead of
    rescanning lineitem."""
    lw = D.lineitem_weekly(spark, sf_dir)
    panel = lw.select(F.col("l_returnflag").alias("series_id"), "t", F.col("l_quantity").alias("qty"),
                      (F.col("l_extendedprice") / 1e6).alias("price"), F.col("l_discount").alias("disc"))
    return cut_lineage(interpolate_linear(panel, ["series_id"], ["t"], FLAG_VARS, position="t"))


def flagship_forecast(spark: SparkSession, sf_dir: str, steps: int = 10, lags: int = 2) -> DataFrame:
    panel = flag_panel(spark, sf_dir)
    model = fit_var(panel, FLAG_VARS, VarSpec(lags, Det.CONST))
    return forecast_wide(forecast(model, panel, steps), FLAG_VARS)


def var_report(spark: SparkSession, panel: DataFrame, variables: list[str], lags: int = 6, det: Det = Det.CONST,
               steps: int = 10, horizon: int = 12, response: str | None = None, out: str | None = None) -> dict[str, DataFrame]:
    """Fit -> forecast -> Granger matrix -> IRF of one response to every shock; all series in one job.

    With ``out`` every table is written below that folder in its published layout and read back.
    """
    from panelcast.sources.readers import read_table
    from panelcast.sources.sinks import granger_output, irf_wide, write_table
    model = fit_var(panel, variables, VarSpec(lags, det))
    resp = response or variables[0]
    impulses = irf(model, horizon)
    report = {
        "model": model.summary(),
        "forecast": forecast(model, panel, steps),
        "granger": granger_matrix(model),
        "irf": impulses.filter(F.col("response") == resp),
    }
    if out is None:
        return report
    report |= {"forecast": forecast_wide(report["forecast"], variables), "granger": granger_output(report["granger"]),
               "irf": irf_wide(impulses, variables, resp)}
    for name, df in report.items():
        write_table(df, f"{out}/{name}.parquet")
    return {name: read_table(spark, f"{out}/{name}.parquet") for name in report}


COVARIATES = ["l_discount", "l_tax", "l_quantity", "l_extendedprice"]
SHARED_COVARIATES = ["l_discount", "l_quantity", "l_extendedprice"]  # kept in every country


def country_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, source, covariates): one row per configured country. ``source`` names the covariate
    series that the country is joined to, ``covariates`` the columns that it keeps, in order."""
    n = D.read_test_table(spark, sf_dir, "nation")
    source = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    listed = F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, COVARIATES))).otherwise(F.array(*map(F.lit, SHARED_COVARIATES)))
    return n.select(F.upper("n_name").alias("code"), source.alias("source"), listed.alias("covariates"))


def training_table(spark: SparkSession, sf_dir: str, config: DataFrame | None = None) -> DataFrame:
    """Training panel of all configured countries: their weekly counts, gap-filled, joined to the weekly
    means of their covariate source on (iso_year, iso_week); log1p targets, one series per country|strain.

    Rows without a usable week key are dropped, the covariates are interpolated along their own series
    before the weekly means are taken, and a covariate that a country's configuration leaves out is NULL.
    """
    from panelcast.operators import interp, reshape
    from panelcast.operators.joins import join_many_to_one
    config = country_config(spark, sf_dir) if config is None else config
    weekly = D.nation_weekly(spark, sf_dir).drop("isoyw").where(F.col("iso_year").isNotNull() & F.col("iso_week").between(1, 53))
    flu = join_many_to_one(weekly.withColumn("code", F.upper("n_name")), config, ["code"])
    flu = interp.fill_gaps(flu, ["n_name"], ["week"], D.NW_MEASURES, round_digits=0, position="t")
    weather = D.lineitem_weekly(spark, sf_dir)
    weather = interp.fill_gaps(weather, ["l_returnflag"], ["week"], COVARIATES, position="t", zero=False)
    weather = weather.groupBy(F.col("l_returnflag").alias("source"), "iso_year", "iso_week").agg(*[F.avg(c).alias(c) for c in COVARIATES])
    merged = join_many_to_one(flu, weather, ["source", "iso_year", "iso_week"], validate="plan")
    kept = {c: F.when(F.array_contains("covariates", c), F.col(c)) for c in COVARIATES}
    merged = merged.withColumns(kept | {"LOG_INF_A": F.log1p("INF_A"), "LOG_INF_B": F.log1p("INF_B")})
    return reshape.split_series(merged, ["n_name"], ["LOG_INF_A", "LOG_INF_B"],
                                ["source", "week", "iso_year", "iso_week", *COVARIATES])


STRAIN_FOLDERS = ["n_name", "strain"]


def write_training_tables(table: DataFrame, path: str) -> None:
    """One folder per country and strain; countries that ``table`` has no rows of stay as they are on disk."""
    from panelcast.sources.sinks import write_table
    write_table(table, path, partition_by=STRAIN_FOLDERS, replace_partitions=True)


def read_training_tables(spark: SparkSession, path: str, country: str | None = None, strain: str | None = None) -> DataFrame:
    """The written tables, in the columns of the training table; only the folders asked for are listed and read."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(path)
    for column, value in zip(STRAIN_FOLDERS, (country, strain)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    first = ["series_id", *STRAIN_FOLDERS]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def training_panel(spark: SparkSession, sf_dir: str, config: DataFrame | None = None) -> DataFrame:
    """Model input from the training table: positional index per series over its weeks."""
    from panelcast.sources.readers import load_series
    tt = cut_lineage(training_table(spark, sf_dir, config))
    return cut_lineage(load_series(tt, ["target", *SHARED_COVARIATES], "series_id", order_col="week"))


# Fixed column groups of the station weekly roll-up.
STATION_MEAN_COLUMNS = ["temperature", "dew_point_temperature", "relative_humidity", "wind_speed", "wind_direction",
                        "sea_level_pressure", "station_level_pressure", "visibility", "wind_gust",
                        "wet_bulb_temperature", "altimeter", "pressure_3hr_change"]
STATION_SUM_COLUMNS = ["precipitation", "precipitation_3_hour", "precipitation_6_hour", "precipitation_9_hour",
                       "precipitation_12_hour", "precipitation_15_hour", "precipitation_18_hour",
                       "precipitation_21_hour", "precipitation_24_hour"]
STATION_FIRST_COLUMNS = ["Station_ID", "Station_name", "Latitude", "Longitude", "Elevation"]
STATION_TENTHS_COLUMNS = ["temperature", "dew_point_temperature", "wet_bulb_temperature"]


def station_weekly(raw: DataFrame, scale_divisor: float = 10.0, mode: str = "truncate",
                   key: str = "Station_ID") -> tuple[DataFrame, DataFrame]:
    """Station file (all-string columns) -> (weekly table, NaN summary), every station in one job.

    Timestamp from Year..Minute parts (bad -> dropped), tenths-of-degree columns divided by
    ``scale_divisor``, other measures parsed leniently, complete hourly grid per station, then
    weekly W-MON bins: mean of the measures, sum of the precipitation windows (0 for an empty
    week), first non-null metadata; sky-cover columns are not aggregated. Only columns present
    in the file take part.
    """
    from panelcast.functions.scalar import lenient_double, scale, timestamp_from_parts
    from panelcast.operators.quality import nan_summary
    from panelcast.operators.resample import hourly_grid, weekly_rollup
    from panelcast.sources.readers import present_columns
    means = present_columns(raw, STATION_MEAN_COLUMNS)
    sums = present_columns(raw, STATION_SUM_COLUMNS)
    meta = [c for c in present_columns(raw, STATION_FIRST_COLUMNS) if c != key]
    ts = timestamp_from_parts("Year", "Month", "Day", "Hour", "Minute")
    typed = raw.select(
        F.col(key), ts.alias("datetime"),
        *[(scale(c, scale_divisor) if c in STATION_TENTHS_COLUMNS else lenient_double(c)).alias(c) for c in means + sums],
        *[(lenient_double(c) if c in ("Latitude", "Longitude", "Elevation") else F.col(c)).alias(c) for c in meta],
    ).dropna(subset=["datetime"])
    hourly = hourly_grid(typed, [key], "datetime", means + sums, mode=mode, first_cols=meta)
    weekly = weekly_rollup(hourly, [key], "datetime", means, sums, meta, week_col="iso_weekstartdate")
    return weekly, nan_summary(weekly.drop("t"))
