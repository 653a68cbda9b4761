"""Pitch arsenals by pitcher and season."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fungo.functions.numeric import count_where, round_half_up, row_sum, safe_ratio
from fungo.functions.text import matches_name
from fungo.operators.clean import columns_like
from fungo.plans.schema import ARSENAL_METRICS, PITCH_TYPES

_WHIFF = ("swinging_strike", "swinging_strike_blocked")


_MEANS = ("release_speed", "release_spin_rate", "pfx_x", "pfx_z")


def arsenal_states(pitches: DataFrame, denominator: str = "strikes") -> DataFrame:
    """What pitches add to A1: (pitcher, season, pitch_type, n, sums and counts of measures, missed and seen swings)."""
    d = F.col("description")
    seen = d.contains("strike") | d.contains("foul") | (d == "hit_into_play")
    if denominator == "swings":
        seen = seen & (d != "called_strike")
    sums = [f(c).alias(f"{n}_{c}") for c in _MEANS for n, f in (("s", F.sum), ("n", F.count))]
    return pitches.filter("pitch_type is not null and pitcher is not null").groupBy("pitcher", "season", "pitch_type").agg(F.count("*").alias("n"), *sums, count_where(d.isin(*_WHIFF)).alias("missed"), count_where(seen).alias("seen"))


def fold_arsenal(states: DataFrame, min_pitches: int = 100, merge: bool = True) -> DataFrame:
    """A1 from states; `merge` adds up states of one key (from several writes), which are one row otherwise."""
    if merge:
        states = states.groupBy("pitcher", "season", "pitch_type").agg(*(F.sum(c).alias(c) for c in states.columns if c not in ("pitcher", "season", "pitch_type")))
    total = F.sum("n").over(Window.partitionBy("pitcher", "season"))

    def mean(c: str, digits: int):
        return round_half_up(safe_ratio(F.col(f"s_{c}"), F.col(f"n_{c}")), digits)

    return (
        states.withColumn("_total", total)
        .filter(F.col("_total") >= min_pitches)
        .select(
            "pitcher", "season", "pitch_type", F.col("n").alias("n_pitches"),
            round_half_up(F.lit(100.0) * F.col("n") / F.col("_total"), 2).alias("usage_pct"),
            mean("release_speed", 2).alias("avg_speed"), mean("release_spin_rate", 0).alias("avg_spin"),
            round_half_up(safe_ratio(F.col("missed"), F.col("seen")), 4).alias("whiff_rate"),
            mean("pfx_x", 2).alias("avg_pfx_x"), mean("pfx_z", 2).alias("avg_pfx_z"),
        )
    )


def arsenal_long(pitches: DataFrame, min_pitches: int = 100, denominator: str = "strikes") -> DataFrame:
    """A1: per pitcher, season and pitch type: count, share, mean speed, spin and movement, whiff rate.

    `denominator`: "strikes" takes every description with strike or foul in it and balls in
    play, so called strikes too; "swings" leaves called strikes out.  Pitcher-seasons under
    `min_pitches` are dropped.  Pitches are shuffled as partial sums by type only; the total
    is a window over the grouped rows, a few per pitcher and season, not a second scan.  On
    facts bucketed by pitcher and season (tables.write_facts) nothing is shuffled.
    """
    return fold_arsenal(arsenal_states(pitches, denominator), min_pitches, merge=False)


def arsenal_wide(long: DataFrame, types: tuple[str, ...] = PITCH_TYPES, metrics: tuple[str, ...] = ARSENAL_METRICS) -> DataFrame:
    """A2: one row per pitcher and season with <TYPE>_<metric> columns, metric by metric; types are fixed, so columns never depend on the data."""
    wide = long.groupBy(F.col("pitcher").alias("player_id"), "season").pivot("pitch_type", list(types)).agg(*(F.first(m).alias(m) for m in metrics))
    return wide.select("player_id", "season", *(F.col(f"{t}_{m}") for m in metrics for t in types))


def enrich_names(df: DataFrame, players: DataFrame, id_column: str = "player_id") -> DataFrame:
    """`first last` from a player table (id, name_first, name_last); null where the id is not in it, Player_<id> where it has no name."""
    names = players.groupBy(F.col("id").alias("_id")).agg(F.coalesce(F.min(F.concat_ws(" ", "name_first", "name_last")), F.lit("")).alias("_name"))  # the least of several
    joined = df.join(names, F.col(id_column) == F.col("_id"), "left")
    name = F.when(F.col("_name") == "", F.concat(F.lit("Player_"), F.col(id_column).cast("string"))).otherwise(F.col("_name"))
    return joined.withColumn("player_name", name).drop("_id", "_name")


def usage_means(wide: DataFrame, suffix: str = "_usage_pct", above: float = 1.0) -> DataFrame:
    """Mean of every metric column over all rows, those above a value, highest first."""
    columns = columns_like(wide, suffix=suffix)
    means = wide.agg(*(F.avg(c).alias(c) for c in columns))
    rows = means.unpivot([], columns, "metric", "mean_value").filter(F.col("mean_value") > above)
    return rows.orderBy(F.desc("mean_value"), "metric")


def season_trend(wide: DataFrame, metric: str, types: tuple[str, ...]) -> DataFrame:
    """Mean of a wide metric per season and pitch type; means without a value are left out."""
    columns = [f"{t}_{metric}" for t in types]
    means = wide.groupBy("season").agg(*(F.avg(c).alias(c) for c in columns))
    rows = means.unpivot(["season"], columns, "pitch_type", "mean_value").filter("mean_value is not null")
    return rows.withColumn("pitch_type", F.substring_index("pitch_type", "_", 1))


def player_trend(wide: DataFrame, text: str, types: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """A player's metrics by season in long form, with the previous season's value and the change."""
    columns = [f"{t}_{m}" for t in types for m in metrics]
    rows = wide.filter(matches_name(F.col("player_name"), text)).unpivot(["player_id", "player_name", "season"], columns, "measure", "value").filter("value is not null")
    before = F.lag("value").over(Window.partitionBy("player_id", "measure").orderBy("season"))
    return rows.withColumn("previous", before).withColumn("change", F.col("value") - F.col("previous"))


def usage_matrix(wide: DataFrame, season: int, types: tuple[str, ...], n: int = 20) -> DataFrame:
    """T4: usage by type of the n pitchers of a season with the largest total."""
    columns = [f"{t}_usage_pct" for t in types]
    rows = wide.filter(F.col("season") == season).withColumn("total_usage", row_sum(*columns))
    return rows.orderBy(F.desc("total_usage"), "player_id").limit(n).select("player_id", "total_usage", *columns)


def component_matrix(df: DataFrame, labels: dict[str, str], rank: str = "stuff_plus", innings: str = "ip", min_ip: float = 100, n: int = 15, name: str = "name") -> DataFrame:
    """T4: component columns of the n best with enough innings, as doubles under their labels; without the rank column the first n by name, without innings all take part."""
    rows = df.filter(F.col(innings) >= min_ip) if innings in df.columns else df
    ranked = rank in df.columns
    top = (rows.filter(F.col(rank).isNotNull()).orderBy(F.desc(rank), name) if ranked else rows.orderBy(name)).limit(n)
    return top.select(name, *([rank] if ranked else []), *(F.col(c).try_cast("double").alias(label) for c, label in labels.items() if c in df.columns))
