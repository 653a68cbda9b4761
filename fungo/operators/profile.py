"""Value profiles: counts by season, key, measure and value, written once; many statistics are answered from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.operators.quantiles import exact_quantiles


def value_profile(df: DataFrame, measures: list[str], key: str, season: str = "season") -> DataFrame:
    """(season, key, measure, value, n): how often each value of each measure occurs, by season and key.

    One scan and one exchange of counted values for all measures.  Profiles of different rows
    are merged by adding n, so a season's part can be replaced by itself.  Null values and
    NaN are left out; null seasons and keys are groups of their own.
    """
    long = df.select(F.col(season).alias("season"), F.col(key).alias("key"), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("x"))
    live = long.select("season", "key", "x.measure", "x.value").filter("value is not null and not isnan(value)")
    return live.groupBy("season", "key", "measure", "value").agg(F.count("*").alias("n"))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """One profile of all rows of several."""
    rows = profiles[0]
    for p in profiles[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("season", "key", "measure", "value").agg(F.sum("n").alias("n"))


def profile_median(profile: DataFrame, measure: str) -> DataFrame:
    """(key, median_value)."""
    q = exact_quantiles(profile.filter(F.col("measure") == measure), ["key"], "value", [0.5], "n")
    return q.select("key", F.col("q")[0].alias("median_value"))


def profile_describe(profile: DataFrame, measures: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of measures, one row a measure, those without values too.

    Deviations are taken from the mean in a second pass over the counts, so large means cost no digits.
    """
    rows = profile.filter(F.col("measure").isin(*measures))
    sums = rows.groupBy("measure").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("s"), F.min("value").alias("min"), F.max("value").alias("max"))
    means = sums.select("measure", "n", (F.col("s") / F.col("n")).alias("mean"), "min", "max")
    off = rows.join(F.broadcast(means.select("measure", "mean")), "measure")
    squares = off.groupBy("measure").agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), 2)).alias("ss"))
    q = exact_quantiles(rows, ["measure"], "value", [0.25, 0.5, 0.75], "n")
    every = profile.sparkSession.createDataFrame([(m,) for m in measures], "measure string")
    out = every.join(means, "measure", "left").join(squares, "measure", "left").join(q, "measure", "left")
    std = F.when(F.col("n") > 1, F.sqrt(F.col("ss") / F.when(F.col("n") > 1, F.col("n") - 1)))
    return out.select(F.col("measure").alias("column_name"), F.coalesce("n", F.lit(0)).alias("n"), "mean", std.alias("std"), "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def profile_histogram(profile: DataFrame, measure: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) in equal-width bins over the whole range, see stats.histogram."""
    from fungo.operators.stats import bounds, equal_width_bin

    rows = profile.filter(F.col("measure") == measure)
    lo, hi = F.col("lo_0"), F.col("hi_0")
    keyed = rows.crossJoin(F.broadcast(bounds(rows, "value"))).withColumn("bin", equal_width_bin(F.col("value"), lo, hi, bins))
    width = (hi - lo) / bins
    g = keyed.groupBy("bin", "lo_0", "hi_0").agg(F.sum("n").alias("n"))
    return g.select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n")


def profile_box_stats(profile: DataFrame, measure: str) -> DataFrame:
    """Per key: quartiles, whisker ends and number of outliers, see stats.box_stats."""
    from fungo.operators.stats import box_of_counts

    rows = profile.filter((F.col("measure") == measure) & F.col("key").isNotNull())
    return box_of_counts(rows.groupBy("key", F.col("value").alias("_v")).agg(F.sum("n").alias("_n")), "key")
