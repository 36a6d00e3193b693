"""Column expressions over triaxial and clock values; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vector_magnitude(x, y, z) -> Column:
    x, y, z = map(_c, (x, y, z))
    return F.sqrt(x * x + y * y + z * z)


def enmo(vm) -> Column:
    """Acceleration beyond 1 g in mg, 0 at least."""
    return F.greatest((_c(vm) - 1) * 1000, F.lit(0.0))


def enmo_a(vm) -> Column:
    """Distance from 1 g in mg."""
    return F.abs((_c(vm) - 1) * 1000)


def pitch(x, y, z) -> Column:
    """Angle of x to the plane of y and z in degrees; 0 where all are 0."""
    x, y, z = map(_c, (x, y, z))
    return F.degrees(F.atan2(x, F.sqrt(y * y + z * z)))


def roll(x, y, z) -> Column:
    return pitch(y, x, z)


def on_sphere(x, y, z) -> Column:
    """The nearest point of the unit sphere, a struct; null for the origin."""
    vm = F.nullif(vector_magnitude(x, y, z), F.lit(0.0))
    return F.struct(*((_c(v) / vm).alias(n) for v, n in ((x, "x"), (y, "y"), (z, "z"))))


def calibrated(value, offset, scale) -> Column:
    return _c(offset) + _c(value) * _c(scale)


def uncalibrated(value, offset, scale) -> Column:
    """The exact inverse of calibrated."""
    return (_c(value) - _c(offset)) / _c(scale)


def minute_of_day(ts) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def sine_wave(ts, wavelength_minutes: float = 1440) -> Column:
    return F.sin(minute_of_day(ts) * 2 * F.pi() / float(wavelength_minutes))


def cosine_wave(ts, wavelength_minutes: float = 1440) -> Column:
    return F.cos(minute_of_day(ts) * 2 * F.pi() / float(wavelength_minutes))


def start_of(unit: str, ts) -> Column:
    """Start of the day, hour or minute."""
    return F.date_trunc(unit, _c(ts)).cast("timestamp_ntz")


def end_of(unit: str, ts) -> Column:
    """Last microsecond of the day, hour or minute."""
    step = {"day": "INTERVAL '1' DAY", "hour": "INTERVAL '1' HOUR", "minute": "INTERVAL '1' MINUTE"}[unit.lower()]
    return start_of(unit, ts) + F.expr(step) - F.expr("INTERVAL '0.000001' SECOND")


def is_midnight(ts) -> Column:
    return _c(ts) == start_of("day", ts)


def time_parts(ts) -> list[Column]:
    """Date, clock time, day, month, year, day of the week (Sunday 0) and day of the year."""
    t = _c(ts)
    parts = {
        "date": F.date_format(t, "yyyy-MM-dd"), "time": F.date_format(t, "HH:mm:ss"), "day": F.dayofmonth(t), "month": F.month(t), "year": F.year(t), "dow": F.dayofweek(t) - 1, "doy": F.dayofyear(t),
    }
    return [c.alias(n) for n, c in parts.items()]
