"""Counts, profiles, distributions and correlations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.functions.numeric import count_where, round_half_even
from fungo.operators.quantiles import exact_quantiles
from fungo.sources.shared import join_keys, written


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most first; nulls do not count."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def usage_share(df: DataFrame, column: str, min_pct: float = 0.5) -> DataFrame:
    """Each value's percentage of the non-null rows, to one decimal; then those of at least `min_pct`.

    The total is one grouped row that is joined to the few counted ones.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    pct = round_half_even(F.col("n").cast("double") / F.col("_all") * 100, 1)
    return counts.crossJoin(F.broadcast(total)).select(column, pct.alias("pct")).filter(F.col("pct") >= min_pct).orderBy(F.desc("pct"), column)


def count_by(df: DataFrame, events: Iterable[str], key: str, n: int | None = None, column: str = "events") -> DataFrame:
    """A10: rows with one of the events per key, most first; the first `n`."""
    counts = df.filter(F.col(column).isin(*events) & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), key)
    return ordered if n is None else ordered.limit(n)


def mean_by(df: DataFrame, key: str, value: str, min_n: int = 100) -> DataFrame:
    """Mean and count of a measure per key with at least `min_n` values, highest first."""
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    return g.filter(F.col("n") >= min_n).orderBy(F.desc("mean_value"), key)


def median_by(df: DataFrame, key: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Median per key; exact by rank selection (see quantiles.rank_values), or by percentile_approx where `accuracy` is given."""
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    if accuracy is not None:
        return rows.groupBy(key).agg(F.percentile_approx(value, 0.5, accuracy).alias("median_value"))
    return exact_quantiles(rows.select(key, value), [key], value, [0.5]).select(key, F.col("q")[0].alias("median_value"))


def mean_of_medians(df: DataFrame, key: str, value: str, accuracy: int | None = None) -> DataFrame:
    """The mean over the keys' medians."""
    return median_by(df, key, value, accuracy).agg(F.avg("median_value").alias("mean_of_medians"))


def distinct_counts(df: DataFrame, columns: list[str], by: str | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values of columns, overall or per key."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    rows = df if by is None else df.filter(F.col(by).isNotNull())
    return rows.groupBy(*([by] if by else [])).agg(*(count(F.col(c)).alias(f"n_{c}") for c in columns))


def _stacked(one_row: DataFrame, columns: list[str], parts: list[str]) -> DataFrame:
    """One aggregated row with columns <part><i> as one row per column."""
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{p}{i}").alias(p) for p in parts)) for i, c in enumerate(columns)))
    return one_row.select("*", F.explode(rows).alias("_r"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null count and percentage of measures, and rows with any of them (line `any`), in one pass."""
    anything = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    one = df.agg(F.count("*").alias("_rows"), *(F.count(c).alias(f"n{i}") for i, c in enumerate(columns)), count_where(anything).alias(f"n{len(columns)}"))
    pct = F.when(F.col("_rows") > 0, round_half_even(F.col("_r.n").cast("double") / F.col("_rows") * 100, 1))
    return _stacked(one, [*columns, "any"], ["n"]).select("_r.column_name", F.col("_r.n").alias("n_present"), pct.alias("pct_present"))


def missing_profile(df: DataFrame, n: int = 20) -> DataFrame:
    """Null count and percentage per column, the worst `n`, in one pass."""
    one = df.agg(F.count("*").alias("_rows"), *(count_where(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    pct = F.when(F.col("_rows") > 0, round_half_even(F.col("_r.n").cast("double") / F.col("_rows") * 100, 1))
    return _stacked(one, df.columns, ["n"]).select("_r.column_name", F.col("_r.n").alias("n_missing"), pct.alias("pct_missing")).orderBy(F.desc("n_missing"), "column_name").limit(n)


def describe(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of measures.

    Counts to extremes are one pass.  Quartiles are exact by rank selection over the measures
    set one below the other (see quantiles.rank_values), so no task holds a measure's values;
    with `accuracy` they come from percentile_approx in that pass.
    """
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    at = [0.25, 0.5, 0.75]
    quartiles = [] if accuracy is None else [F.percentile_approx(c, F.array(*map(F.lit, at)), accuracy).alias(f"q{i}") for i, c in enumerate(columns)]
    r = _stacked(df.agg(*(f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in parts.items()), *quartiles), columns, [*parts, *(["q"] if quartiles else [])])
    r = r.select("_r.*")
    if accuracy is None:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
        r = r.join(F.broadcast(exact_quantiles(long, ["column_name"], "value", at)), "column_name", "left")
    return r.select("column_name", "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def bounds(df: DataFrame, *columns: str) -> DataFrame:
    """One row with lo_<i> and hi_<i> of each column."""
    return df.agg(*(f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin from 0, left-closed, the last one closed; one bin where all values are equal."""
    at = F.coalesce(F.floor((x - lo) / F.when(hi > lo, (hi - lo) / bins)), F.lit(0))  # least() skips nulls
    return F.least(at, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts in equal-width bins over the whole range, per key where one is given; empty bins are absent.

    The range is one aggregated row, broadcast; values never leave their partition.
    """
    rows = df.filter(F.col(column).isNotNull())
    lo, hi = F.col("lo_0"), F.col("hi_0")
    keyed = rows.crossJoin(F.broadcast(bounds(rows, column))).withColumn("bin", equal_width_bin(F.col(column), lo, hi, bins))
    g = keyed.groupBy(*([by] if by else []), "bin", "lo_0", "hi_0").agg(F.count("*").alias("n"))
    width = (hi - lo) / bins
    return g.select(*([by] if by else []), "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "n")


def box_of_counts(counts: DataFrame, key: str, quartiles: DataFrame | None = None) -> DataFrame:
    """Quartiles, whisker ends and outliers per key from counted values (key, _v, _n)."""
    if quartiles is None:
        counts = written(counts)
        quartiles = exact_quantiles(counts, [key], "_v", [0.25, 0.5, 0.75], "_n")
    sizes = counts.groupBy(key).agg(F.count("*").alias("_size"))
    told = quartiles.select(key, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")).join(sizes, key)
    joined = join_keys(counts, told, [key], "_size")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(key, "q1", "median", "q3").agg(F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high"), F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"))


def box_stats(df: DataFrame, key: str, value: str, order: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Per key: quartiles, whisker ends (furthest values within 1.5 quartile ranges) and number of outliers; `order` restricts and ranks the keys.

    Rows are first counted by key and value, with map-side partials; quartiles are exact by
    rank selection over these counts, whiskers and outliers are grouped sums of them, so
    neither a hot key nor a key of very many values is one task.  With `accuracy`, quartiles
    come from percentile_approx over the rows.
    """
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    if order is not None:
        rows = rows.filter(F.col(key).isin(*order))
    counts = rows.groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    quartiles = None if accuracy is None else rows.groupBy(key).agg(F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy).alias("q"))
    out = box_of_counts(counts, key, quartiles)
    if order is not None:
        out = out.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col(key)))
    return out


def binned_mean(df: DataFrame, x: str, y: str, value: str, bins: int = 20) -> DataFrame:
    """Mean of a measure in bins x bins equal-width, right-closed cells (the lowest value belongs to the first); empty cells are absent."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull())
    keyed = rows.crossJoin(F.broadcast(bounds(rows, x, y)))

    def cell(c: str, i: int) -> Column:
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        at = F.coalesce(F.ceil((F.col(c) - lo) / F.when(hi > lo, (hi - lo) / bins)) - 1, F.lit(0))
        return F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")

    return keyed.groupBy(cell(x, 0).alias("x_bin"), cell(y, 1).alias("y_bin")).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))


def correlation(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Pearson correlation over complete pairs, and their number."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*([by] if by else [])).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def linear_fit(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Least-squares line of y on x, the range of x and the number of pairs."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*([by] if by else [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.count("*").alias("n"))


def column_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Totals over count columns, one row a column, largest first."""
    one = df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"total{i}") for i, c in enumerate(columns)))
    return _stacked(one, columns, ["total"]).select("_r.column_name", "_r.total").orderBy(F.desc("total"), "column_name")


def extrapolate(df: DataFrame, days_sample: int, days_full: int, column: str) -> DataFrame:
    """Rows and covered rows of a sample, carried to the full period in proportion to its days."""
    scale = days_full / days_sample
    one = df.agg(F.count("*").alias("n_rows"), F.count(column).alias("n_covered"))
    return one.select("n_rows", "n_covered", round_half_even(F.col("n_rows") * F.lit(scale), 0).alias("estimated_rows"), round_half_even(F.col("n_covered") * F.lit(scale), 0).alias("estimated_covered"))


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's share of its key's total."""
    return df.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(key)))
