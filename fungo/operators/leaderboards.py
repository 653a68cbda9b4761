"""Rankings and comparisons of seasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fungo.operators.clean import require
from fungo.operators.stats import histogram
from fungo.plans.schema import LEADERBOARDS


def leaderboard(df: DataFrame, season: int, metric: str, label: str, n: int | None = 20, ascending: bool = False, season_column: str = "year") -> DataFrame:
    """The first or last n of a season by a metric; rows without it are out, the label breaks ties.  Planned as take-ordered, no full sort."""
    rows = df.filter((F.col(season_column) == season) & F.col(metric).isNotNull())
    ordered = rows.orderBy(F.asc(metric) if ascending else F.desc(metric), label)
    return ordered if n is None else ordered.limit(n)


def leaderboards(frames: dict[str, DataFrame], season: int, labels: dict[str, str]) -> dict[str, DataFrame]:
    """T1 for every configured board whose table is given."""
    return {f"{board}_{metric}_{'bottom' if asc else 'top'}": leaderboard(frames[board], season, metric, labels[board], n, asc, col) for board, metric, asc, n, col in LEADERBOARDS if board in frames}


def qualified_top(df: DataFrame, qualifier: str, least: float, metric: str, label: str, n: int = 20, ascending: bool = False) -> DataFrame:
    """The n best of those with a large enough sample."""
    rows = df.filter((F.col(qualifier) >= least) & F.col(metric).isNotNull())
    return rows.orderBy(F.asc(metric) if ascending else F.desc(metric), label).limit(n)


def component_top_n(df: DataFrame, columns: list[str], name: str, n: int = 15) -> DataFrame:
    """The n best by each of several columns, ranked."""
    rows = df.select(name, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([name], columns, "component", "value").filter("value is not null")
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("value"), name))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n)


def year_over_year(df: DataFrame, key: str, season_column: str, first: int, second: int, metrics: list[str]) -> DataFrame:
    """Entities present in both seasons, each metric with both years as suffixes; one grouped pass instead of a self-join."""
    s = F.col(season_column)
    picked = [F.max(F.when(s == y, F.col(m))).alias(f"{m}_{y}") for m in metrics for y in (first, second)]
    g = df.filter(s.isin(first, second) & F.col(key).isNotNull()).groupBy(key).agg(*(F.max(s == y).alias(f"_{y}") for y in (first, second)), *picked)
    return g.filter(f"_{first} and _{second}").drop(f"_{first}", f"_{second}")


def yoy_delta(df: DataFrame, key: str, season_column: str, first: int, second: int, metric: str, n: int | None = 15, ascending: bool = False) -> DataFrame:
    """Change of a metric between two seasons, largest (or smallest) first; entities that lack a value are out."""
    both = require(year_over_year(df, key, season_column, first, second, [metric]), f"{metric}_{first}", f"{metric}_{second}")
    rows = both.withColumn("delta", F.col(f"{metric}_{second}") - F.col(f"{metric}_{first}"))
    ordered = rows.orderBy(F.asc("delta") if ascending else F.desc("delta"), key)
    return ordered if n is None else ordered.limit(n)


def change_histogram(df: DataFrame, columns: list[str], bins: int = 30) -> DataFrame:
    """A19 over the newest change that the table has: the first of `columns` that exists, its name beside the bins; no rows where none does."""
    found = next((c for c in columns if c in df.columns), None)
    if found is None:
        return histogram(df.select(F.lit(None).cast("double").alias("none")), "none", bins).withColumn("measure", F.lit(None).cast("string"))
    return histogram(df, found, bins).withColumn("measure", F.lit(found))


def restrict_to(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among the keys."""
    return df.join(keys, keys.columns, "left_semi")


def preview(df: DataFrame, columns: list[str], required: list[str], n: int = 20) -> DataFrame:
    """The first n rows that have the required measures, in the order of the shown columns."""
    return require(df, *required).select(*columns).orderBy(*columns).limit(n)
