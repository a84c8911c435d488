"""Typed paths into semi-structured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.city.coord.lat`` or ``$.weather[0].main``; NULL if absent or not of the kind."""
    return F.try_variant_get(v, path, kind)


def weather_columns(v: Column) -> dict[str, Column]:
    """A weather report's columns, temperatures in degrees Celsius."""
    k = lambda p: field(v, p, "double") - 273.15
    return {
        "observation_time": field(v, "$.time", "timestamp"), "city_id": field(v, "$.city.id", "int"), "city_name": field(v, "$.city.name"),
        "country": field(v, "$.city.country"), "city_lat": field(v, "$.city.coord.lat", "double"), "city_lon": field(v, "$.city.coord.lon", "double"),
        "clouds": field(v, "$.clouds.all", "int"), "temp_avg": k("$.main.temp"), "temp_min": k("$.main.temp_min"), "temp_max": k("$.main.temp_max"),
        "conditions": field(v, "$.weather[0].main"), "conditions_desc": field(v, "$.weather[0].description"), "icon": field(v, "$.weather[0].icon"),
        "wind_dir": field(v, "$.wind.deg", "double"), "wind_speed": field(v, "$.wind.speed", "double"),
    }
