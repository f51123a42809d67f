"""Short-term forecast of the daily mean score.

The windows below run over one row per date, so they hold a few thousand rows however many comments there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Shape of the forecast.
LONG_SHARE, SHORT_SHARE, SHORT_DAYS = 0.3, 0.7, 7
LEAST_WINDOW = 14
DECAY = 0.1
LOWEST, HIGHEST = 0.1, 0.9
FLAT = 0.02


def trend(daily: DataFrame, value: str = "avg_sentiment") -> DataFrame:
    """One row: combined slope, baseline, label and confidence; no row for fewer than two days."""
    y = F.col(value).cast("double")
    by_date = Window.orderBy("date")
    everything = Window.partitionBy()
    rows = (daily.select("date", y.alias("y"))
            .withColumn("i", F.row_number().over(by_date).cast("double"))
            .withColumn("n", F.count(F.lit(1)).over(everything).cast("double")))
    window = F.least(F.greatest(F.lit(float(LEAST_WINDOW)), F.floor(F.col("n") / 4).cast("double")), F.col("n"))
    rows = rows.filter(F.col("n") >= 2).withColumn("w", window)
    start = F.col("n") - F.col("w")
    in_long, in_short = F.col("i") > start, F.col("i") > F.col("n") - SHORT_DAYS
    weight = F.when(in_long, F.exp((F.col("i") - start - 1) / (F.col("w") - 1)))

    def slope(inside):
        return F.regr_slope(F.when(inside, F.col("y")), F.when(inside, F.col("i")))

    one = rows.groupBy().agg(
        slope(in_long).alias("long_slope"), slope(in_short).alias("short_slope"),
        (F.sum(weight * F.col("y")) / F.sum(weight)).alias("baseline"),
        F.count(F.lit(1)).alias("data_days")).filter(F.col("data_days") > 0)
    combined = F.col("long_slope") * LONG_SHARE + F.col("short_slope") * SHORT_SHARE
    return (one.withColumn("slope", combined)
            .withColumn("current_trend", F.when(F.col("slope") > FLAT, "up").when(F.col("slope") < -FLAT, "down")
                        .otherwise("flat"))
            .withColumn("confidence", F.least(F.lit(0.5) + F.col("data_days") / 200.0 + F.abs("slope") * 5, F.lit(0.95)))
            .select("slope", "baseline", "current_trend", "confidence", "data_days"))


def forecast(daily: DataFrame, days_ahead: int = 7, value: str = "avg_sentiment", digits: int = 3) -> DataFrame:
    """One row per day ahead."""
    rows = trend(daily, value).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days_ahead))))
    moved = F.col("baseline") + F.col("slope") * F.col("step") / (F.lit(1.0) + F.lit(DECAY) * F.col("step"))
    return rows.select("step", F.round(F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), moved)), digits)
                       .alias("prediction"), "current_trend", F.round("confidence", 6).alias("confidence"), "data_days")
