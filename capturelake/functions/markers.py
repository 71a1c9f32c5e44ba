"""IN and OUT markers: clamps in the order in which they apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 0.1
NOT_AFTER = "OUT must be after IN."


def set_in(t: Column, out: Column) -> Column:
    """IN for a time: from 0, and at least SPAN before OUT."""
    t = F.greatest(t, F.lit(0.0))
    return F.when(out - t < SPAN, out - F.lit(SPAN)).otherwise(t)


def set_out(t: Column, in_: Column, total: Column) -> Column:
    """OUT for a time: up to the total if that is positive, at least SPAN after IN."""
    t = F.when((total > 0) & (t > total), total).otherwise(t)
    return F.when(t - in_ < SPAN, in_ + F.lit(SPAN)).otherwise(t)


def slider_in(v: Column, low: Column, high: Column, out: Column, span: Column) -> Column:
    """The slider's IN for a value: between the range's start and OUT less the span."""
    span = F.greatest(span, F.lit(1))
    return F.when(high <= low, low).otherwise(F.greatest(low, F.least(v, out - span)))


def slider_out(v: Column, low: Column, high: Column, in_: Column, span: Column) -> Column:
    span = F.greatest(span, F.lit(1))
    return F.when(high <= low, high).otherwise(F.greatest(in_ + span, F.least(v, high)))


def slider_range(low: Column, high: Column, in_: Column, out: Column, span: Column) -> tuple[Column, Column, Column]:
    """(high, in, out) of the markers under a new range."""
    span, high = F.greatest(span, F.lit(1)), F.greatest(high, low)
    in_, out = F.greatest(in_, low), F.least(out, high)
    out = F.when(out < in_ + span, F.least(high, in_ + span)).otherwise(out)
    in_ = F.when(in_ > out - span, F.greatest(low, out - span)).otherwise(in_)
    return high, in_, out


def cut_error(in_: Column, out: Column) -> Column:
    return F.when(out - in_ <= 0, F.lit(NOT_AFTER))
