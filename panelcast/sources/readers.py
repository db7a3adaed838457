"""Readers: station files, header CSV/parquet tables and typed model input."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelcast.functions.scalar import lenient_int

__all__ = [
    "STATION_COLUMNS", "station_layouts", "read_station_file", "read_table", "require_columns", "present_columns",
    "select_present", "load_series", "read_test_table",
]

# Fixed column whitelist of a station file (time/meta, core, optional weather, precipitation windows, sky cover).
STATION_COLUMNS = [
    "Station_ID", "Station_name", "Year", "Month", "Day", "Hour", "Minute",
    "Latitude", "Longitude", "Elevation",
    "temperature", "dew_point_temperature", "relative_humidity", "precipitation", "wind_speed",
    "wind_direction", "sea_level_pressure", "station_level_pressure",
    "visibility", "wind_gust", "wet_bulb_temperature", "altimeter", "pressure_3hr_change",
    "precipitation_3_hour", "precipitation_6_hour", "precipitation_9_hour", "precipitation_12_hour",
    "precipitation_15_hour", "precipitation_18_hour", "precipitation_21_hour", "precipitation_24_hour",
    "sky_cover_1", "sky_cover_2", "sky_cover_3",
]


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    """Raise ValueError naming every required column the frame lacks."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in cols if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def present_columns(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """Keep only the names that exist (optional-column tolerance), in the given order."""
    have = {c.lower() for c in df.columns}
    return [c for c in cols if c.lower() in have]


def select_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*present_columns(df, cols))


def station_layouts(spark: SparkSession, path: str | Sequence[str], sep: str = "|") -> dict[tuple[str, ...], list[str]]:
    """Files by the columns of their header, found by one job however many files there are.

    The scan deals one file to a task, and a task stops after the first line, so of a large file little more
    than its head is read. Headers meet in a grouped aggregate; the driver gets one row per header. Files without a
    line are left out.
    """
    scan = spark.newSession()  # settings of this scan only
    scan.conf.set("spark.sql.files.maxPartitionBytes", str(2**44))
    scan.conf.set("spark.sql.files.openCostInBytes", str(2**44))
    scan.conf.set("spark.sql.files.minPartitionNum", "1")
    scan.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = None
        for b in batches:
            for file, line in zip(b["file"], b["value"]):
                if file != seen:
                    names = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep))
                    yield pd.DataFrame({"names": [names], "file": [file]})
                seen = file
            if len(b):
                return

    lines = scan.read.text(path if isinstance(path, str) else list(path)).select("value", F.input_file_name().alias("file"))
    heads = lines.mapInPandas(first, "names array<string>, file string")
    found = heads.groupBy("names").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return {tuple(r["names"]): r["files"] for r in sorted(found, key=lambda r: r["files"])}


def read_station_file(spark: SparkSession, path: str | Sequence[str], year_min: int = 2000,
                      columns: Sequence[str] = STATION_COLUMNS, sep: str = "|",
                      check_nonempty: bool = False) -> DataFrame:
    """Scan '|'-separated station files as all-string columns, keep the whitelist, filter Year >= year_min.

    Several paths (or a glob) are read as one bag union. Every file's columns follow its own header: files
    of one header are one scan, scans are united by name, and a column that a file lacks is NULL. The
    whitelist reaches the scans as pruned read schemas. Values stay strings; typing is the cleaning
    step's job (lenient casts).
    """
    layouts = station_layouts(spark, path, sep)
    if not layouts:
        raise ValueError(f"no station file at {path}")
    out = None
    for names, files in layouts.items():
        schema = StructType([StructField(c, StringType(), True) for c in names])
        raw = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(files)
        raw = raw.select(*present_columns(raw, columns))
        out = raw if out is None else out.unionByName(raw, allowMissingColumns=True)
    out = out.select(*present_columns(out, columns)).filter(lenient_int("Year") >= F.lit(year_min))
    if check_nonempty and out.isEmpty():
        raise ValueError(f"no rows found for Year >= {year_min}")
    return out


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | str | None = None,
               header: bool = True) -> DataFrame:
    """CSV (header, explicit schema when given, strings otherwise) or parquet by extension."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return reader.option("header", header).csv(path)
    return reader.format(fmt).load(path)


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_series(df: DataFrame, variables: Sequence[str], series_col: str = "series_id",
                order_col: str | None = None, time_col: str = "t", check: bool | str = False) -> DataFrame:
    """Typed model input: every variable cast to double (strict: bad text raises under ANSI).

    When ``order_col`` is given the positional index 0..T-1 is assigned per series by the
    distributed ``positional_index``. ``check`` raises on an empty input, a NULL value or, for a given
    ``time_col``, an index that does not run 0..T-1 (one aggregation over the input). With "plan" a NULL
    value raises when it is read, without a scan of its own; the index is not looked at.
    """
    def typed_value(v: str):
        value = F.col(v).cast("double")
        if check == "plan":
            value = F.coalesce(value, F.raise_error(F.lit(f"NULL value in column {v}")).cast("double"))
        return value.alias(v)

    cols = [typed_value(v) for v in variables]
    series = F.col(series_col).cast("string").alias(series_col)
    if order_col is None:
        out = df.select(series, F.col(time_col).cast("bigint").alias(time_col), *cols)
    else:
        from panelcast.operators.lags import positional_index
        typed = df.select(series, F.col(order_col), *cols)
        out = positional_index(typed, series_col, [order_col], time_col).select(series_col, time_col, *variables)
    if check and check != "plan":
        t = F.col(time_col)
        bad = F.count_if(F.expr(" or ".join(f"`{c}` is null" for c in [*variables, time_col])))
        per = out.groupBy(series_col).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"),
                                          F.count_distinct(t).alias("d"), bad.alias("bad"))
        whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))
        found = per.agg(F.count(F.lit(1)).alias("series"), F.sum("bad").alias("bad"), F.count_if(~whole).alias("holes")).first()
        if not found["series"]:
            raise ValueError("the input is empty")
        if found["bad"]:
            raise ValueError(f"{found['bad']} rows have NULL values")
        if found["holes"]:
            raise ValueError(f"the index of {found['holes']} series does not run 0..T-1")
    return out
