"""Times as text: SS, MM:SS and HH:MM:SS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse(text: Column) -> Column:
    """Seconds of one to three parts; null unless all are numbers with minutes
    and seconds from 0 to under 60 and hours from 0.  NaN and infinity are
    not numbers here."""
    parts = F.split(F.btrim(text), ":")
    n = F.size(parts)

    def part(i: Column) -> Column:
        p = F.btrim(F.get(parts, i))
        return F.when(p.rlike(_NUMBER), p.try_cast("double"))

    s, m, h = part(n - 1), F.when(n >= 2, part(n - 2)).otherwise(0.0), F.when(n >= 3, part(n - 3)).otherwise(0.0)
    valid = (n <= 3) & (h >= 0) & (m >= 0) & (m < 60) & (s >= 0) & (s < 60)
    return F.when(valid, h * 3600.0 + m * 60.0 + s)


def format(seconds: Column) -> Column:  # noqa: A001
    """HH:MM:SS.mmm; negative is zero, milliseconds carry."""

    def div(x: Column, y: int) -> Column:
        return F.call_function("div", x, F.lit(y).cast("bigint"))

    def whole_ms(s: Column) -> Column:
        return (F.floor(s) * 1000 + F.round((s - F.floor(s)) * 1000.0).cast("bigint")).cast("bigint")

    def text(ms: Column) -> Column:
        return F.printf(F.lit("%02d:%02d:%02d.%03d"), div(ms, 3600000), div(ms, 60000) % 60, div(ms, 1000) % 60, ms % 1000)

    # as functions of an array's element, so that each step is computed once
    steps = F.transform(F.transform(F.array(F.greatest(seconds, F.lit(0.0))), whole_ms), text)
    return F.when(seconds.isNotNull(), F.get(steps, F.lit(0)))


def deciseconds(seconds: Column) -> Column:
    return F.round(seconds * 10.0).cast("bigint")


def duration(total_samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, total_samples.cast("double") / rate)
