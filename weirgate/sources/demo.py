"""A synthetic threat log of any size: weighted kinds, and times with a daily rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirgate.functions.format import HOUR_WEIGHT, WEEKEND
from weirgate.sources.tables import threat_logs


def demo_logs(spark: SparkSession, rows: int, days: int, as_of: str, seed: int = 7) -> DataFrame:
    """`rows` log rows of the last `days` days before as_of, decided by a hash of the row's number and the seed.

    A time is drawn by inverting the cumulative traffic of the days' hours, so no draw is rejected.
    """
    draw = lambda salt: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), 11) / F.lit(float(1 << 53))
    day_share = lambda d: F.when(F.weekday(d) >= 5, WEEKEND).otherwise(1.0)
    calendar = F.transform(F.sequence(F.lit(1), F.lit(days)), lambda i: F.date_sub(F.to_date(F.lit(as_of)), i))
    total = sum(HOUR_WEIGHT)
    bounds = F.array(*(F.lit(sum(HOUR_WEIGHT[: i + 1]) / total) for i in range(24)))
    first_over = lambda values, x: F.size(F.filter(values, lambda v: v <= x))
    rows_ = spark.range(rows).select("id", draw("day").alias("d"), draw("hour").alias("h"), draw("second").alias("s"), draw("kind").alias("k"), draw("app").alias("a"), draw("ms").alias("m"))
    weights = F.transform(calendar, day_share)
    # Cumulative shares of the days, as one constant array for all rows.
    cumulative = F.transform(weights, lambda w, i: F.aggregate(F.slice(weights, F.lit(1), i + 1), F.lit(0.0), lambda acc, x: acc + x) / F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x))
    timed = rows_.select("*", F.element_at(calendar, F.least(F.lit(days), first_over(cumulative, F.col("d")) + 1)).alias("day"), F.least(F.lit(23), first_over(bounds, F.col("h"))).alias("hour"))
    ts = F.make_timestamp_ntz(F.year("day"), F.month("day"), F.dayofmonth("day"), F.col("hour"), F.floor(F.col("s") * 60).cast("int"), (F.col("s") * 3600 % 60).cast("decimal(8,6)"))
    # threat_logs takes the kind from (37 * event_id) mod 1000, and 37 * 973 = 1 mod 1000.
    number = F.floor(F.col("k") * 1000).cast("long") * 973 % 1000 + F.col("id") * 1000
    app = F.element_at(F.array(*map(F.lit, ("click", "view", "purchase", "login"))), F.floor(F.col("a") * 4).cast("int") + 1)
    return threat_logs(timed.select(number.alias("event_id"), ts.alias("ts"), app.alias("event_type"), (20 + 180 * F.col("m")).alias("value")))


