"""Column expressions shared by sources, operators and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """NaN becomes null; both mean "no reading"."""
    return F.when(~F.isnan(value), value)


def attribute(name: Column) -> Column:
    """The part of an export's column name after the last ``__``."""
    return F.element_at(F.split(name, "__"), -1)


def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Whether a text contains any keyword, whatever the case."""
    return reduce(lambda a, b: a | b, (F.lower(text).contains(k.lower()) for k in keywords), F.lit(False))


def split_list(text: Column) -> Column:
    """Comma-separated names: trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with ``+00:00``; microseconds only where there are any."""
    ts = ts.cast("timestamp")
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def ramp(i: Column, n: Column) -> Column:
    """1 at the first of ``n`` places, 0 at the last; 1 where there is only one."""
    return F.when(n > 1, 1 - i / F.greatest(n - 1, F.lit(1))).otherwise(1.0)


def blend(forward: Column, backward: Column, i: Column, n: Column) -> Column:
    """Forward forecast fading into the backward one over ``n`` places."""
    w = ramp(i, n)
    return forward * w + backward * (1 - w)


def feather(y: Column, first: Column, last: Column, before: Column, after: Column, i: Column, n: Column, points: int, has_before: Column, has_after: Column) -> Column:
    """Pulls the ends of a window towards its neighbours over ``points`` places.

    ``first`` and ``last`` are the window's own end values. The start is corrected first;
    the correction of the end starts from the last value after that. ``points`` 0 is off.
    """
    if points <= 0:
        return y
    k = F.least(F.lit(points), n)
    start = lambda at: F.greatest(F.lit(0.0), 1 - at / k)
    shift = F.when(has_before, before - first).otherwise(0.0)
    started = y + shift * start(i)
    end = last + shift * start(n - 1)
    return started + F.when(has_after, after - end).otherwise(0.0) * F.greatest(F.lit(0.0), 1 - (n - 1 - i) / k)


def confidence(method: Column) -> Column:
    """A forward-only reconstruction is provisional, all others are reconciled."""
    return F.when(method.endswith("forward-only"), "PROVISIONAL").otherwise("RECONCILED")
