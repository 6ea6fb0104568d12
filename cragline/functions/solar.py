"""Solar position as column expressions (the NOAA series): no UDF, whole-stage codegen throughout."""

from __future__ import annotations

import calendar
import datetime as dt
import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The series' coefficients. Equation of time in minutes, then declination in radians.
EQUATION = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
MICROS_A_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, taken as UTC; no session zone is involved."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def days_in_year(year: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(leap, 366.0).otherwise(365.0)


#: The functions that the series needs, for columns and for arrays.
COLUMNS = SimpleNamespace(
    cos=F.cos, sin=F.sin, radians=F.radians, degrees=F.degrees, atan2=F.atan2, asin=F.asin, mod=lambda x, y: F.pmod(x, F.lit(y)),
    held=lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)),
)
ARRAYS = SimpleNamespace(
    cos=np.cos, sin=np.sin, radians=np.radians, degrees=np.degrees, atan2=np.arctan2, asin=np.arcsin, mod=np.mod, held=lambda x: np.clip(x, -1.0, 1.0)
)


def _series(gamma: Column, m: SimpleNamespace = COLUMNS) -> tuple[Column, Column]:
    """Equation of time (minutes) and declination (radians)."""
    e0, e1, e2, e3, e4 = EQUATION
    equation = 229.18 * (e0 + e1 * m.cos(gamma) + e2 * m.sin(gamma) + e3 * m.cos(2 * gamma) + e4 * m.sin(2 * gamma))
    d0, d1, d2, d3, d4, d5, d6 = DECLINATION
    declination = (
        d0 + d1 * m.cos(gamma) + d2 * m.sin(gamma) + d3 * m.cos(2 * gamma) + d4 * m.sin(2 * gamma) + d5 * m.cos(3 * gamma) + d6 * m.sin(3 * gamma)
    )
    return equation, declination


def position(day_of_year, year_days, hour, latitude, longitude, m: SimpleNamespace = COLUMNS) -> dict:
    """east, north, up (a unit vector), azimuth (degrees from north, 0..360) and altitude (degrees), of columns or arrays."""
    gamma = 2 * math.pi / year_days * (day_of_year - 1 + (hour - 12) / 24)
    equation, declination = _series(gamma, m)
    angle = m.radians(m.mod((hour * 60 + equation + 4 * longitude) / 4, 360.0) - 180)
    lat = m.radians(latitude)
    east = -m.cos(declination) * m.sin(angle)
    north = m.cos(lat) * m.sin(declination) - m.sin(lat) * m.cos(declination) * m.cos(angle)
    up = m.sin(lat) * m.sin(declination) + m.cos(lat) * m.cos(declination) * m.cos(angle)
    return {
        "east": east, "north": north, "up": up, "azimuth": m.mod(m.degrees(m.atan2(east, north)), 360.0), "altitude": m.degrees(m.asin(m.held(up))),
    }


def of_day(day: str, second: np.ndarray, latitude: float, longitude: float) -> tuple[np.ndarray, np.ndarray]:
    """(azimuth, altitude) at seconds (0 to 86400) of a UTC date."""
    date = dt.date.fromisoformat(day)
    year_days = 366.0 if calendar.isleap(date.year) else 365.0
    at = position(date.timetuple().tm_yday, year_days, second / 3600, latitude, longitude, ARRAYS)
    return at["azimuth"], at["altitude"]


def at_timestamp(ts: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """position() at a timestamp without zone (UTC)."""
    hour = F.pmod(micros(ts), F.lit(MICROS_A_DAY)) / 3.6e9
    return position(F.dayofyear(ts), days_in_year(F.year(ts)), hour, latitude, longitude)


def at_second(day: str, second: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """position() at a second (0 to below 86400) of a UTC date."""
    date = F.lit(day).cast("date")
    return position(F.dayofyear(date), days_in_year(F.year(date)), second / 3600, latitude, longitude)


def position_sql(day_of_year: str, year_days: str, hour: str, lat: str, lon: str, want: str) -> str:
    """The same series as DuckDB text, for oracles. want: azimuth, altitude, east, north or up."""
    g = f"(2 * pi() / {year_days} * ({day_of_year} - 1 + ({hour} - 12) / 24))"
    e, d = EQUATION, DECLINATION
    c = lambda v: f"({v}::DOUBLE)"
    equation = f"({c(229.18)} * ({c(e[0])} + {c(e[1])} * cos({g}) + {c(e[2])} * sin({g}) + {c(e[3])} * cos(2 * {g}) + {c(e[4])} * sin(2 * {g})))"
    dec = f"({c(d[0])} + {c(d[1])} * cos({g}) + {c(d[2])} * sin({g}) + {c(d[3])} * cos(2 * {g}) + {c(d[4])} * sin(2 * {g}) + {c(d[5])} * cos(3 * {g}) + {c(d[6])} * sin(3 * {g}))"
    raw = f"(({hour} * 60 + {equation} + 4 * {lon}) / 4)"
    angle = f"radians(({raw} - 360 * floor({raw} / 360)) - 180)"
    la = f"radians({lat})"
    east = f"(-cos({dec}) * sin({angle}))"
    north = f"(cos({la}) * sin({dec}) - sin({la}) * cos({dec}) * cos({angle}))"
    up = f"(sin({la}) * sin({dec}) + cos({la}) * cos({dec}) * cos({angle}))"
    azimuth = f"((degrees(atan2({east}, {north})) + 360) % 360)"
    return {"east": east, "north": north, "up": up, "azimuth": azimuth, "altitude": f"degrees(asin(greatest(-1, least(1, {up}))))"}[want]
