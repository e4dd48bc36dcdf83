"""Display values: numbers, rates, latencies, chart points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
#: Traffic by hour of the day, and the share of it at weekends.
HOUR_WEIGHT = (0.25, 0.2, 0.2, 0.2, 0.25, 0.3, 0.4, 0.6, 0.8, 1.0, 1.0, 0.95, 0.9, 0.95, 1.0, 1.0, 0.9, 0.75, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25)
WEEKEND = 0.55


def finite(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column) -> Column:
    return F.coalesce(F.format_number(finite(x), 0), F.lit(DASH))


def rate(x: Column) -> Column:
    """A share as percent; a value over 1 is percent already."""
    x = finite(x)
    return F.coalesce(F.concat(F.format_number(F.when(x > 1, x).otherwise(100 * x), 1), F.lit("%")), F.lit(DASH))


def latency(ms: Column) -> Column:
    ms = finite(ms)
    return F.coalesce(F.when(ms >= 1000, F.concat(F.format_number(ms / 1000, 2), F.lit(" s"))).otherwise(F.concat(F.format_number(ms, 1), F.lit(" ms"))), F.lit(DASH))


def point_time(x: Column) -> Column:
    """A timestamp from text: seconds or milliseconds since 1970, or ISO form."""
    n = F.try_to_number(F.when(x.rlike(r"^[0-9]{1,13}$"), x), F.lit("9999999999999")).cast("long")
    seconds = F.when(n >= 100_000_000_000, n / 1000).otherwise(n.cast("double"))
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.try_to_timestamp(x))


def first_of(columns: list[str], *aliases: str) -> Column:
    """The first of the aliases that is there and not null, as a chart's points name their parts differently."""
    have = [F.col(f"`{a}`") for a in aliases if a in columns]
    return F.coalesce(*have) if have else F.lit(None)


def with_both_latencies(avg: Column, p95: Column) -> tuple[Column, Column]:
    """A missing side is imputed from the other by a factor of 1.8."""
    return F.coalesce(finite(avg), finite(p95) / 1.8), F.coalesce(finite(p95), finite(avg) * 1.8)


def tenth(low: Column) -> Column:
    """The bin, of ten over [0, 1], that a finer bin's lower edge falls in."""
    return F.least(F.lit(9), F.greatest(F.lit(0), F.floor(low * 10))).cast("int")


def traffic_weight(at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, HOUR_WEIGHT)), F.hour(at) + 1) * F.when(F.weekday(at) >= 5, WEEKEND).otherwise(1.0)
