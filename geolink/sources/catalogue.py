"""Indicator catalogue and argument validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolink.functions.text import indicator_card

#: Data sets by temporal resolution and the indicators each of them offers.
DAILY = ("derived-era5-land-daily-statistics", "derived-era5-single-levels-daily-statistics")
MONTHLY = ("reanalysis-era5-land-monthly-means", "reanalysis-era5-single-levels-monthly-means")
INDICATORS = {
    "reanalysis-era5-land-monthly-means": (
        "2m_temperature", "total_precipitation", "10m_u_component_of_wind", "10m_v_component_of_wind",
        "leaf_area_index_high_vegetation", "leaf_area_index_low_vegetation", "snow_cover", "snowfall",
    ),
    "reanalysis-era5-single-levels-monthly-means": (
        "2m_temperature", "total_precipitation", "10m_u_component_of_wind", "10m_v_component_of_wind", "instantaneous_10m_wind_gust",
        "downward_uv_radiation_at_the_surface", "total_cloud_cover", "k_index", "leaf_area_index_high_vegetation", "leaf_area_index_low_vegetation", "snowfall",
    ),
    "derived-era5-land-daily-statistics": (
        "2m_temperature", "snow_cover", "10m_u_component_of_wind", "10m_v_component_of_wind", "leaf_area_index_high_vegetation", "leaf_area_index_low_vegetation",
    ),
    "derived-era5-single-levels-daily-statistics": (
        "2m_temperature", "total_precipitation", "10m_u_component_of_wind", "10m_v_component_of_wind", "instantaneous_10m_wind_gust",
        "downward_uv_radiation_at_the_surface", "total_cloud_cover", "k_index", "leaf_area_index_high_vegetation", "leaf_area_index_low_vegetation", "snowfall",
    ),
}
STATISTICS = ("daily_mean", "daily_maximum", "daily_minimum")
HOURS = tuple(f"{h:02d}:00" for h in range(24))
ZONES = tuple(f"utc{h:+03d}:00" for h in range(-12, 15))
#: Days from a monthly layer's stamp to the month it stands for.
STAMPS = {"first": 0, "last": 0, "last_of_previous": 1, "first_of_next": -1}
#: Monthly indicators that are not stamped in their own month, for means over all hours and for those of one hour.
STAMP_OF = {
    ("reanalysis-era5-land-monthly-means", "snow_cover"): ("first_of_next", "last"),
    ("reanalysis-era5-single-levels-monthly-means", "total_precipitation"): ("last_of_previous", "last_of_previous"),
    ("reanalysis-era5-single-levels-monthly-means", "instantaneous_10m_wind_gust"): ("last_of_previous", "first"),
    ("reanalysis-era5-single-levels-monthly-means", "downward_uv_radiation_at_the_surface"): ("last_of_previous", "last_of_previous"),
    ("reanalysis-era5-single-levels-monthly-means", "snowfall"): ("last_of_previous", "last_of_previous"),
    ("reanalysis-era5-single-levels-monthly-means", "k_index"): ("last", "last"),
}
METHODS = ("near", "bilinear", "cubic", "cubicspline", "lanczos", "average", "sum", "min", "max", "rms")
#: Indicator, name, parameter id, category, unit, subsets of reanalysis indicators (two ids by the public parameter list).
_REANALYSIS = (
    ("2m_temperature", "2 metre temperature", 167, "Temperature", "K", "single_levels land"),
    ("total_precipitation", "Total precipitation", 228, "Precipitation", "m", "single_levels land"),
    ("10m_u_component_of_wind", "10 metre U wind component", 165, "Wind", "m s**-1", "single_levels land pressure_levels"),
    ("10m_v_component_of_wind", "10 metre V wind component", 166, "Wind", "m s**-1", "single_levels land pressure_levels"),
    ("leaf_area_index_high_vegetation", "Leaf area index, high vegetation", 67, "Vegetation", "m**2 m**-2", "single_levels land"),
    ("leaf_area_index_low_vegetation", "Leaf area index, low vegetation", 66, "Vegetation", "m**2 m**-2", "single_levels land"),
    ("snow_cover", "Snow cover", 260038, "Snow", "%", "land"),
    ("snowfall", "Snowfall", 144, "Snow", "m to water equivalent", "land"),
    ("total_cloud_cover", "Total cloud cover", 164, "Clouds", "(0 - 1)", "land"),
)
#: Indicator, name, category, unit, temporal resolution of derived climate indicators.
_DERIVED = (
    ("fire_weather_index", "Fire weather index", "Extreme weather", None, "monthly seasonal yearly"),
    ("extreme_wind_speed_days", "Extreme wind speed days", "Extreme weather", "days", "monthly seasonal yearly"),
    ("mean_wind_speed", "Mean wind speed", "Wind", "m s**-1", "monthly seasonal yearly"),
    ("days_with_high_fire_danger", "Days with high fire danger", "Extreme weather", "days", "monthly seasonal yearly"),
    ("magnitude_of_meteorological_droughts", "Magnitude of meteorological droughts", "Extreme weather", None, "yearly"),
    ("duration_of_meteorological_droughts", "Duration of meteorological droughts", "Extreme weather", "months", "yearly"),
    ("consecutive_dry_days", "Consecutive dry days", "Extreme weather", "days", "yearly"),
    ("frequency_of_extreme_precipitation", "Frequency of extreme precipitation", "Extreme weather", "days", "yearly"),
    ("extreme_precipitation_total", "Total extreme precipitation", "Extreme weather", "mm", "yearly"),
    ("maximum_consecutive_five_day_precipitation", "Maximum consecutive five-day precipitation", "Extreme weather", "mm", "yearly"),
)
#: Default arguments of reanalysis indicators; a warning of one of them.
_ARGUMENTS = {"only_land": "true", "statistic": "daily_mean", "time_zone": "utc+00:00"}
_WARNINGS = {"total_precipitation": {"by_hour && !only_land": "Stamps of one hour's layers are an hour early unless only land is asked for."}}
ITEM = (
    "name string, id long, category string, project string, data_type string, subsets array<string>, unit string, spatial_resolution string, spatial_coverage string,"
    " temporal_resolution array<string>, temporal_coverage string, arguments map<string,string>, warning map<string,string>"
)
SCHEMA = f"indicator string, {ITEM}"


def _one_of(value, choices, what: str):
    if value not in choices:
        raise ValueError(f"{what} must be one of {', '.join(map(str, choices))}; got {value!r}")
    return value


def check_catalogue(catalogue: str, resolution: str) -> str:
    return _one_of(catalogue, DAILY if resolution == "daily" else MONTHLY, f"catalogue for {resolution} data")


def check_indicator(indicator: str, catalogue: str) -> str:
    return _one_of(indicator, INDICATORS[catalogue], f"indicator of {catalogue}")


def check_by_hour(by_hour: str | bool) -> str | bool:
    return by_hour if by_hour is False else _one_of(by_hour, HOURS, "by_hour")


def check_statistic(statistic: str) -> str:
    return _one_of(statistic, STATISTICS, "statistic")


def check_time_zone(zone: str) -> str:
    return _one_of(zone, ZONES, "time_zone")


def check_stamp(stamp: str) -> str:
    return _one_of(stamp, ("catalogue", *STAMPS), "stamp")


def stamp_shift(stamp: str, indicator: str, catalogue: str, by_hour: str | bool = False) -> int:
    """Days to add to a stamp to be in the month that it stands for."""
    if stamp == "catalogue":
        stamp = STAMP_OF.get((catalogue, indicator), ("first", "first"))[by_hour is not False]
    return STAMPS[stamp]


def check_baseline(baseline) -> tuple[int, int] | None:
    """None for no baseline, else (first, last) year; strings of digits are accepted."""
    if baseline is None or baseline is False:
        return None
    if len(baseline) != 2:
        raise ValueError("baseline must be two years")
    first, last = (int(y) for y in baseline)
    if first > last:
        raise ValueError("baseline must not end before it begins")
    return first, last


def check_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_uniform_date(df: DataFrame, col: str = "date") -> None:
    """A target grid has one date; one aggregate job."""
    n = df.agg(F.count_distinct(col).alias("n")).first()["n"]
    if n != 1:
        raise ValueError(f"a grid needs exactly one date, found {n}")


def valid_arguments(df: DataFrame, resolution: str = "daily") -> DataFrame:
    """``df`` with ``ok_<argument>`` for each argument that it has as a column, by the rules of the checks above.

    For tables of link requests; arguments: catalogue, indicator (with catalogue),
    by_hour, statistic, time_zone, and baseline as ``first`` and ``last``.
    """
    offers = F.create_map(*[x for name, all_ in INDICATORS.items() for x in (F.lit(name), F.array(*map(F.lit, all_)))])
    rules = {
        "catalogue": lambda: F.col("catalogue").isin(*(DAILY if resolution == "daily" else MONTHLY)),
        "indicator": lambda: F.array_contains(F.try_element_at(offers, F.col("catalogue")), F.col("indicator")),
        "by_hour": lambda: F.col("by_hour").isin(*HOURS), "statistic": lambda: F.col("statistic").isin(*STATISTICS), "time_zone": lambda: F.col("time_zone").isin(*ZONES),
        "last": lambda: F.col("first") <= F.col("last"),
    }
    return df.select("*", *[F.coalesce(rule(), F.lit(False)).alias(f"ok_{name}") for name, rule in rules.items() if name in df.columns])


def indicators(spark: SparkSession) -> DataFrame:
    """All indicators, by category from the end of the alphabet, then by name."""
    common = ("gridded", "0.25° x 0.25°", "global")
    kind, grid, area = common
    rows = [
        (i, n, k, c, "era5", kind, s.split(), u, grid, area, ["hourly", "daily", "monthly"], "1950-01-01 00:00", _ARGUMENTS | ({"pressure_levels": None} if "pressure_levels" in s else {}), _WARNINGS.get(i))
        for i, n, k, c, u, s in _REANALYSIS
    ]
    rows += [(i, n, None, c, "era5-ecde", kind, None, u, grid, area, t.split(), "1940-01-01", None, None) for i, n, c, u, t in _DERIVED]
    return spark.createDataFrame(rows, SCHEMA).orderBy(F.desc("category"), "indicator")


def lookup(spark: SparkSession, indicator: str) -> DataFrame:
    """One row: the indicator's fields and its ``card`` text; no row for an unknown one."""
    return indicators(spark).where(F.col("indicator") == indicator).withColumn("card", indicator_card())


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Read a catalogue file: one JSON object whose members are indicators."""
    return parse_indicators(spark.read.text(path, wholetext=True), "value")


def parse_indicators(df: DataFrame, col: str) -> DataFrame:
    """One row per indicator of the JSON objects in a column."""
    item = ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ") for f in ITEM.split(", ")))
    return df.select(F.explode(F.from_json(col, f"map<string,struct<{item}>>")).alias("indicator", "v")).select("indicator", "v.*")
