"""Projections, filters and scalar work on rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions.text import matches_name
from fungo.plans.schema import AB_EVENTS, HIT_EVENTS, PA_EVENTS, WALK_EVENTS


def coerce_numeric(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """String columns of which more than `threshold` of the non-null values are numbers become doubles, other values null.

    One pass over all string columns; only two counts a column reach the driver.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if not texts:
        return df
    counts = df.agg(*(F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(texts)), *(F.count(F.trim(F.col(f"`{c}`")).try_cast("double")).alias(f"k{i}") for i, c in enumerate(texts))).first()
    numeric = {c for i, c in enumerate(texts) if counts[f"k{i}"] > threshold * counts[f"n{i}"]}
    return df.select(*(F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) if c in numeric else F.col(f"`{c}`") for c in df.columns))


def label_codes(df: DataFrame, column: str, labels: dict[str, str] | DataFrame) -> DataFrame:
    """P5: codes replaced by labels, the code itself where there is none; a mapping is broadcast, a table of labels only if Spark finds it small."""
    if isinstance(labels, dict):
        labels = F.broadcast(df.sparkSession.createDataFrame(list(labels.items()), "_code string, _label string"))
    else:
        labels = labels.toDF("_code", "_label")
    joined = df.join(labels, F.col(column) == F.col("_code"), "left")
    return joined.withColumn(column, F.coalesce("_label", column)).drop("_code", "_label")


def with_outcome_flags(df: DataFrame, column: str = "events") -> DataFrame:
    """0/1 flags for at bat, plate appearance, hit, walk and strikeout."""
    e = F.col(column)

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return df.withColumns({"is_ab": flag(e.isin(*AB_EVENTS)), "is_pa": flag(e.isin(*PA_EVENTS)), "is_hit": flag(e.isin(*HIT_EVENTS)), "is_walk": flag(e.isin(*WALK_EVENTS)), "is_strikeout": flag(e.isin(*AB_EVENTS) & e.contains("strikeout"))})


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with all these measures."""
    return df.dropna(subset=list(columns))


def with_hit(df: DataFrame, column: str = "events", hits: Iterable[str] = HIT_EVENTS) -> DataFrame:
    """Whether a row is a hit, in column `hit` (a null outcome is none); both halves from one scan."""
    return df.withColumn("hit", F.coalesce(F.col(column).isin(*hits), F.lit(False)))


def split_hits_outs(df: DataFrame, column: str = "events", hits: Iterable[str] = HIT_EVENTS) -> tuple[DataFrame, DataFrame]:
    """Hits, and all else, as two tables; who counts both uses with_hit."""
    hit = F.coalesce(F.col(column).isin(*hits), F.lit(False))
    return df.filter(hit), df.filter(~hit)


def search_players(df: DataFrame, text: str, name: str = "player_name", season: str = "season") -> DataFrame:
    """Rows whose name holds the text in any case, by season."""
    return df.filter(matches_name(F.col(name), text)).orderBy(season, name)


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    """Column names with a prefix and a suffix, in the table's order."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def select_available(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Those of the columns that exist, renamed."""
    return df.select(*(F.col(c).alias(new) for c, new in names.items() if c in df.columns))


def neutral_flag(df: DataFrame, column: str, neutral: float, name: str = "side") -> DataFrame:
    """`above` or `below` a neutral value; a value at it counts as below, null stays null."""
    return df.withColumn(name, F.when(F.col(column) > neutral, "above").when(F.col(column).isNotNull(), "below"))


def metric_pair(df: DataFrame, x: str, y: str, season: int | None = None, group: str | None = None, season_column: str = "season") -> DataFrame:
    """Two measures of one season, rows with both, and a group column."""
    rows = df if season is None else df.filter(F.col(season_column) == season)
    return require(rows, x, y).select(*([group] if group else []), x, y)


def with_absent(df: DataFrame, *columns: str) -> DataFrame:
    """Measures that the table lacks, as null doubles."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns}) if set(columns) - set(df.columns) else df
