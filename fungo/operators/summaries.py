"""Player and country summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions.numeric import count_where, round_half_even, safe_ratio
from fungo.plans.schema import AB_EVENTS, HIT_EVENTS, PA_EVENTS, WALK_EVENTS


def _outcomes() -> dict[str, Column]:
    e = F.col("events")
    return {
        "PA": count_where(e.isin(*PA_EVENTS)), "AB": count_where(e.isin(*AB_EVENTS)), "H": count_where(e.isin(*HIT_EVENTS)),
        "1B": count_where(e == "single"), "2B": count_where(e == "double"), "3B": count_where(e == "triple"), "HR": count_where(e == "home_run"),
        "BB": count_where(e.isin(*WALK_EVENTS)), "HBP": count_where(e == "hit_by_pitch"), "K": count_where(e.isin(*AB_EVENTS) & e.contains("strikeout")),
    }


def _total_bases() -> Column:
    return F.col("1B") + 2 * F.col("2B") + 3 * F.col("3B") + 4 * F.col("HR")


def _sums(pitches: DataFrame, measures: dict[str, str]) -> dict[str, Column]:
    """Sum and count of each measure under a short name; nothing where the table lacks it."""
    out = {}
    for name, c in measures.items():
        out |= {f"{name}s": F.sum(c) if c in pitches.columns else F.lit(None).cast("double"), f"{name}n": F.count(c) if c in pitches.columns else F.lit(0)}
    return out


def _mean(name: str, digits: int) -> Column:
    return round_half_even(safe_ratio(F.col(f"{name}s"), F.col(f"{name}n")), digits)


def _added(states: DataFrame, keys: tuple[str, ...], drop: tuple[str, ...] = ("season",)) -> DataFrame:
    """States of the same keys in one row: sums of what is counted, the least name."""
    return states.groupBy(*keys).agg(F.min("player_name").alias("player_name"), *(F.sum(c).alias(c) for c in states.columns if c not in (*keys, *drop, "player_name")))


def batting_states(pitches: DataFrame, keys: tuple[str, str] = ("batter", "country"), more: tuple[str, ...] = ()) -> DataFrame:
    """What pitches add to A3, by the keys and columns `more`: the least name, outcome counts, sums and counts of measures."""
    known = pitches.filter(" and ".join(f"{k} is not null" for k in keys))
    sums = _sums(pitches, {"_x": "estimated_woba_using_speedangle", "_ev": "launch_speed", "_la": "launch_angle"})
    return known.groupBy(*keys, *more).agg(F.min("player_name").alias("player_name"), *(c.alias(n) for n, c in (_outcomes() | sums).items()))


def fold_batting(states: DataFrame, keys: tuple[str, str] = ("batter", "country"), merge: bool = True) -> DataFrame:
    """A3 from states; `merge` adds up states of one key (of several seasons)."""
    g = (_added(states, keys) if merge else states).withColumn("TB", _total_bases())
    obp, slg = safe_ratio(F.col("H") + F.col("BB") + F.col("HBP"), F.col("PA")), safe_ratio(F.col("TB"), F.col("AB"))
    return g.select(
        F.col(keys[0]).alias("mlbam_id"), "player_name", keys[1], "PA", "AB", "H", "1B", "2B", "3B", "HR", "BB", "HBP", "K", "TB",
        round_half_even(safe_ratio(F.col("H"), F.col("AB")), 3).alias("AVG"), round_half_even(obp, 3).alias("OBP"), round_half_even(slg, 3).alias("SLG"), round_half_even(obp + slg, 3).alias("OPS"),
        round_half_even(safe_ratio(F.col("K"), F.col("PA")) * 100, 1).alias("K_pct"), round_half_even(safe_ratio(F.col("BB"), F.col("PA")) * 100, 1).alias("BB_pct"),
        _mean("_x", 3).alias("xwOBA"), _mean("_ev", 1).alias("avg_exit_velo"), _mean("_la", 1).alias("avg_launch_angle"),
    )


def batting_summary(pitches: DataFrame, keys: tuple[str, str] = ("batter", "country")) -> DataFrame:
    """A3: batting line of every batter and country, from one grouped pass of conditional counts.

    On-base percentage is (H + BB + HBP) / PA; rates of nobody are null; means are over all
    pitches of the group, null where the table lacks the measure.  The name is the least of
    the group's (a function of the id).  See `presented` for the published order.
    """
    return fold_batting(batting_states(pitches, keys), keys, merge=False)


def pitching_states(pitches: DataFrame, keys: tuple[str, str] = ("pitcher", "country"), more: tuple[str, ...] = ()) -> DataFrame:
    """What pitches add to A4, by the keys, pitch type and columns `more`: the least name, pitches, outcome counts, sums and counts of measures."""
    known = pitches.filter(" and ".join(f"{k} is not null" for k in keys))
    sums = _outcomes() | _sums(pitches, {"_x": "estimated_woba_using_speedangle", "_v": "release_speed", "_r": "release_spin_rate"})
    return known.groupBy(*keys, "pitch_type", *more).agg(F.min("player_name").alias("player_name"), F.count("*").alias("n"), *(c.alias(n) for n, c in sums.items()))


def fold_pitching(states: DataFrame, keys: tuple[str, str] = ("pitcher", "country"), merge: bool = True) -> DataFrame:
    """A4 from states; `merge` adds up states of one key and pitch type (of several seasons)."""
    by_type = _added(states, (*keys, "pitch_type")) if merge else states
    sums = [c for c in by_type.columns if c not in (*keys, "pitch_type", "player_name", "n")]
    has_type = F.col("pitch_type").isNotNull()
    g = by_type.groupBy(*keys).agg(
        F.min("player_name").alias("player_name"), F.sum("n").alias("total_pitches"), *(F.sum(n).alias(n) for n in sums),
        count_where(has_type).alias("pitch_type_count"), F.min(F.when(has_type, F.struct(-F.col("n"), "pitch_type")))["pitch_type"].alias("primary_pitch"),
    ).withColumn("TB", _total_bases())
    return g.select(
        F.col(keys[0]).alias("mlbam_id"), "player_name", keys[1], "total_pitches", F.col("PA").alias("PA_faced"), "K", "BB", F.col("HR").alias("HR_allowed"), F.col("H").alias("H_allowed"),
        round_half_even(safe_ratio(F.col("H"), F.col("AB")), 3).alias("opp_AVG"), round_half_even(safe_ratio(F.col("TB"), F.col("AB")), 3).alias("opp_SLG"),
        round_half_even(safe_ratio(F.col("K"), F.col("PA")) * 100, 1).alias("K_pct"), round_half_even(safe_ratio(F.col("BB"), F.col("PA")) * 100, 1).alias("BB_pct"),
        _mean("_x", 3).alias("xwOBA_against"), _mean("_v", 1).alias("avg_velo"), _mean("_r", 0).alias("avg_spin_rate"), "pitch_type_count", "primary_pitch",
    )


def pitching_summary(pitches: DataFrame, keys: tuple[str, str] = ("pitcher", "country")) -> DataFrame:
    """A4: pitching line of every pitcher and country, with the number of pitch types and the primary one.

    Everything is first counted per pitch type, then folded: the second grouping reads a few
    rows a player, and the primary pitch (most thrown, then the least code) needs no join.
    """
    return fold_pitching(pitching_states(pitches, keys), keys, merge=False)


def presented(summary: DataFrame, *order: str) -> DataFrame:
    """T5: a published table in its order (A3 and A4: country, player_name, mlbam_id; A1: pitcher, season, pitch_type), by ranges over all tasks.

    For output only, where rows are written or shown next; nulls come last.
    """
    return summary.orderBy(*(F.asc_nulls_last(c) for c in order or ("country", "player_name", "mlbam_id")))


def _mean_of_rounded(column: str, digits: int) -> Column:
    """Mean of a column of `digits` decimals, to as many: whole units are summed, so the order of the rows cannot tip a tie."""
    scale = float(10**digits)
    return F.rint(F.avg(F.rint(F.col(column) * scale))) / scale


def country_batting(summary: DataFrame, min_pa: int = 50) -> DataFrame:
    """A5: unweighted means of the players' rates per country, best OPS first."""
    rates = ("AVG", "OBP", "SLG", "OPS", "xwOBA")
    g = summary.filter((F.col("PA") >= min_pa) & F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("players"), F.sum("PA").alias("total_PA"), *(_mean_of_rounded(r, 3).alias(f"avg_{r}") for r in rates))
    return g.orderBy(F.desc_nulls_last("avg_OPS"), "country")


def country_pitching(summary: DataFrame, min_pitches: int = 200) -> DataFrame:
    """The same for pitchers, lowest expected average first."""
    digits = {"xwOBA_against": 3, "K_pct": 1, "BB_pct": 1, "avg_velo": 1}
    g = summary.filter((F.col("total_pitches") >= min_pitches) & F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("pitchers"), *(_mean_of_rounded(c, k).alias(f"mean_{c}") for c, k in digits.items()))
    return g.orderBy(F.asc_nulls_last("mean_xwOBA_against"), "country")


def roster_counts(rosters: DataFrame, keys: tuple[str, ...] = ("country", "pool"), role: str = "role", roles: tuple[str, ...] = ("batter", "pitcher")) -> DataFrame:
    """Players per key with one column a role, zero where there are none, and their total."""
    g = rosters.groupBy(*keys).pivot(role, list(roles)).count().fillna(0, list(roles))
    total = F.lit(0)
    for r in roles:
        total = total + F.col(r)
    return g.withColumn("total", total)


def mode_by(df: DataFrame, key: str, column: str) -> DataFrame:
    """Each key's commonest value, the least of equals; nulls do not count."""
    counts = df.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct(-F.col("_n"), F.col(column).alias("v")))["v"].alias("mode_value"))


def country_arsenal(summary: DataFrame) -> DataFrame:
    """Modal primary pitch and mean number of pitch types per country, widest first."""
    modes = mode_by(summary, "country", "primary_pitch").withColumnRenamed("mode_value", "most_common_primary")
    variety = summary.filter("country is not null").groupBy("country").agg(round_half_even(F.avg("pitch_type_count"), 1).alias("avg_pitch_types"))
    return modes.join(variety, "country").orderBy(F.desc("avg_pitch_types"), "country")
