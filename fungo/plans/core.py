"""Queries: arsenals, summaries and country tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import arsenal, clean, stats, summaries
from fungo.plans.fixture import PITCHES, duck, pitches, view
from fungo.plans.registry import register
from fungo.plans.schema import AB_EVENTS, ARSENAL_METRICS, HIT_EVENTS, PA_EVENTS, PITCH_NAMES, PITCH_TYPES, WALK_EVENTS

WITH = f"WITH pitches AS ({duck(PITCHES)})"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def even(x: str, digits: int) -> str:
    return f"round_even(({x}) * 1e{digits}, 0) / 1e{digits}"


def up(x: str, digits: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e{digits} + 0.5) / 1e{digits})"


def unit_mean(x: str, digits: int) -> str:
    return f"round_even(avg(round_even({x} * 1e{digits}, 0)), 0) / 1e{digits}"


LONG = f"""{WITH}, by_type AS (
  SELECT pitcher, season, pitch_type, count(*) AS n, avg(release_speed) AS v, avg(release_spin_rate) AS r, avg(pfx_x) AS x, avg(pfx_z) AS z,
         count(*) FILTER (WHERE description IN ('swinging_strike', 'swinging_strike_blocked')) AS missed,
         count(*) FILTER (WHERE description LIKE '%strike%' OR description LIKE '%foul%' OR description = 'hit_into_play') AS seen
  FROM pitches WHERE pitch_type IS NOT NULL AND pitcher IS NOT NULL GROUP BY pitcher, season, pitch_type
), shares AS (
  SELECT *, sum(n) OVER (PARTITION BY pitcher, season) AS thrown FROM by_type
), long AS (
  SELECT pitcher, season, pitch_type, n AS n_pitches, {up("100.0::DOUBLE * n / thrown::DOUBLE", 2)} AS usage_pct, {up("v", 2)} AS avg_speed, {up("r", 0)} AS avg_spin,
         {up("missed::DOUBLE / nullif(seen, 0)", 4)} AS whiff_rate, {up("x", 2)} AS avg_pfx_x, {up("z", 2)} AS avg_pfx_z
  FROM shares WHERE thrown >= 100
)"""
WIDE = LONG + ", wide AS (SELECT pitcher AS player_id, season, " + ", ".join(f"max(CASE WHEN pitch_type = '{t}' THEN {m} END) AS \"{t}_{m}\"" for m in ARSENAL_METRICS for t in PITCH_TYPES) + " FROM long GROUP BY pitcher, season)"
NAMES = "players AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN 'First' END AS name_first, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS name_last FROM supplier WHERE s_suppkey % 7 <> 0)"


def long(spark, sf_dir):
    return arsenal.arsenal_long(pitches(spark, sf_dir))


def wide(spark, sf_dir):
    return arsenal.arsenal_wide(long(spark, sf_dir))


def players(spark, sf_dir):
    return view(spark, sf_dir, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 <> 0 THEN 'First' END AS name_first, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS name_last FROM {supplier} WHERE s_suppkey % 7 <> 0")


@register(LONG + " SELECT * FROM long")
def arsenal_long(spark, sf_dir):
    return long(spark, sf_dir)


@register(WIDE + " SELECT * FROM wide")
def arsenal_wide(spark, sf_dir):
    return wide(spark, sf_dir)


@register(WIDE + f", {NAMES} SELECT w.*, CASE WHEN p.id IS NULL THEN NULL WHEN name_first IS NULL AND name_last IS NULL THEN concat('Player_', CAST(player_id AS VARCHAR)) ELSE concat_ws(' ', name_first, name_last) END AS player_name FROM wide w LEFT JOIN players p ON w.player_id = p.id")
def enrich_names(spark, sf_dir):
    return arsenal.enrich_names(wide(spark, sf_dir), players(spark, sf_dir))


@register(WIDE + ", m AS (" + " UNION ALL ".join(f"SELECT '{t}_usage_pct' AS metric, avg(\"{t}_usage_pct\") AS mean_value FROM wide" for t in PITCH_TYPES) + ") SELECT * FROM m WHERE mean_value > 1.0")
def usage_means(spark, sf_dir):
    return arsenal.usage_means(wide(spark, sf_dir))


@register(WIDE + ", m AS (" + " UNION ALL ".join(f"SELECT season, '{t}' AS pitch_type, avg(\"{t}_avg_speed\") AS mean_value FROM wide GROUP BY season" for t in ("FF", "SL", "SI", "EP")) + ") SELECT * FROM m WHERE mean_value IS NOT NULL")
def season_trend(spark, sf_dir):
    return arsenal.season_trend(wide(spark, sf_dir), "avg_speed", ("FF", "SL", "SI", "EP"))


@register(
    WIDE + f", {NAMES}, named AS (SELECT w.*, concat_ws(' ', name_first, name_last) AS player_name FROM wide w JOIN players p ON w.player_id = p.id WHERE p.name_last IS NOT NULL), m AS ("
    + " UNION ALL ".join(f"SELECT player_id, player_name, season, '{t}_{m}' AS measure, \"{t}_{m}\" AS value FROM named" for t in ("FF", "SL") for m in ("usage_pct", "whiff_rate"))
    + "), v AS (SELECT * FROM m WHERE value IS NOT NULL AND contains(lower(player_name), 'supplier#'))"
    " SELECT *, lag(value) OVER (PARTITION BY player_id, measure ORDER BY season) AS previous, value - lag(value) OVER (PARTITION BY player_id, measure ORDER BY season) AS change FROM v"
)
def player_trend(spark, sf_dir):
    return arsenal.player_trend(arsenal.enrich_names(wide(spark, sf_dir), players(spark, sf_dir)), "SUPPLIER#", ("FF", "SL"), ("usage_pct", "whiff_rate"))


_MAIN = ("FF", "SL", "SI", "CH", "CU", "FC")


@register(WIDE + ", u AS (SELECT player_id, " + " + ".join(f'coalesce("{t}_usage_pct", 0)' for t in _MAIN) + " AS total_usage, " + ", ".join(f'"{t}_usage_pct"' for t in _MAIN) + " FROM wide WHERE season = 1997) SELECT * FROM u ORDER BY total_usage DESC, player_id LIMIT 20")
def usage_matrix(spark, sf_dir):
    return arsenal.usage_matrix(wide(spark, sf_dir), 1997, _MAIN)


_COUNTS = f"""count(*) FILTER (WHERE events IN {in_list(PA_EVENTS)}) AS pa, count(*) FILTER (WHERE events IN {in_list(AB_EVENTS)}) AS ab, count(*) FILTER (WHERE events IN {in_list(HIT_EVENTS)}) AS h,
  count(*) FILTER (WHERE events = 'single') AS b1, count(*) FILTER (WHERE events = 'double') AS b2, count(*) FILTER (WHERE events = 'triple') AS b3, count(*) FILTER (WHERE events = 'home_run') AS hr,
  count(*) FILTER (WHERE events IN {in_list(WALK_EVENTS)}) AS bb, count(*) FILTER (WHERE events = 'hit_by_pitch') AS hbp, count(*) FILTER (WHERE events IN {in_list(AB_EVENTS)} AND events LIKE '%strikeout%') AS k"""
_TB = "(b1 + 2 * b2 + 3 * b3 + 4 * hr)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST(nullif({b}, 0) AS DOUBLE))"


BATTING = f"""{WITH}, g AS (SELECT batter, country, min(player_name) AS player_name, {_COUNTS}, avg(estimated_woba_using_speedangle) AS x, avg(launch_speed) AS ev, avg(launch_angle) AS la
  FROM pitches WHERE batter IS NOT NULL AND country IS NOT NULL GROUP BY batter, country),
batting AS (SELECT batter AS mlbam_id, player_name, country, pa AS "PA", ab AS "AB", h AS "H", b1 AS "1B", b2 AS "2B", b3 AS "3B", hr AS "HR", bb AS "BB", hbp AS "HBP", k AS "K", {_TB} AS "TB",
  {even(ratio("h", "ab"), 3)} AS "AVG", {even(ratio("h + bb + hbp", "pa"), 3)} AS "OBP", {even(ratio(_TB, "ab"), 3)} AS "SLG", {even(ratio("h + bb + hbp", "pa") + " + " + ratio(_TB, "ab"), 3)} AS "OPS",
  {even(ratio("k", "pa") + " * 100", 1)} AS "K_pct", {even(ratio("bb", "pa") + " * 100", 1)} AS "BB_pct", {even("x", 3)} AS "xwOBA", {even("ev", 1)} AS avg_exit_velo, {even("la", 1)} AS avg_launch_angle FROM g)"""
PITCHING = f"""{WITH}, g AS (SELECT pitcher, country, min(player_name) AS player_name, count(*) AS n, {_COUNTS}, avg(estimated_woba_using_speedangle) AS x, avg(release_speed) AS v, avg(release_spin_rate) AS r, count(DISTINCT pitch_type) AS types
  FROM pitches WHERE pitcher IS NOT NULL AND country IS NOT NULL GROUP BY pitcher, country),
tops AS (SELECT pitcher, country, pitch_type, row_number() OVER (PARTITION BY pitcher, country ORDER BY count(*) DESC, pitch_type) AS rn FROM pitches WHERE pitch_type IS NOT NULL GROUP BY pitcher, country, pitch_type),
pitching AS (SELECT g.pitcher AS mlbam_id, player_name, g.country, n AS total_pitches, pa AS "PA_faced", k AS "K", bb AS "BB", hr AS "HR_allowed", h AS "H_allowed",
  {even(ratio("h", "ab"), 3)} AS "opp_AVG", {even(ratio(_TB, "ab"), 3)} AS "opp_SLG", {even(ratio("k", "pa") + " * 100", 1)} AS "K_pct", {even(ratio("bb", "pa") + " * 100", 1)} AS "BB_pct",
  {even("x", 3)} AS "xwOBA_against", {even("v", 1)} AS avg_velo, {even("r", 0)} AS avg_spin_rate, types AS pitch_type_count, pitch_type AS primary_pitch
  FROM g LEFT JOIN tops ON g.pitcher = tops.pitcher AND g.country = tops.country AND rn = 1)"""


@register(BATTING + " SELECT * FROM batting")
def batting_summary(spark, sf_dir):
    return summaries.batting_summary(pitches(spark, sf_dir))


@register(PITCHING + " SELECT * FROM pitching")
def pitching_summary(spark, sf_dir):
    return summaries.pitching_summary(pitches(spark, sf_dir))


@register(BATTING + ' SELECT country, count(*) AS players, CAST(sum("PA") AS BIGINT) AS "total_PA", ' + ", ".join(unit_mean(f'"{r}"', 3) + f' AS "avg_{r}"' for r in ("AVG", "OBP", "SLG", "OPS", "xwOBA")) + ' FROM batting WHERE "PA" >= 50 GROUP BY country')
def country_batting(spark, sf_dir):
    return summaries.country_batting(summaries.batting_summary(pitches(spark, sf_dir)))


@register(PITCHING + " SELECT country, count(*) AS pitchers, " + ", ".join(unit_mean(f'"{c}"', k) + f' AS "mean_{c}"' for c, k in (("xwOBA_against", 3), ("K_pct", 1), ("BB_pct", 1), ("avg_velo", 1))) + " FROM pitching WHERE total_pitches >= 200 GROUP BY country")
def country_pitching(spark, sf_dir):
    return summaries.country_pitching(summaries.pitching_summary(pitches(spark, sf_dir)))


@register(PITCHING + f""", c AS (SELECT country, primary_pitch, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, primary_pitch) AS rn FROM pitching WHERE primary_pitch IS NOT NULL GROUP BY country, primary_pitch),
v AS (SELECT country, {even("avg(pitch_type_count)", 1)} AS avg_pitch_types FROM pitching GROUP BY country)
SELECT c.country, primary_pitch AS most_common_primary, avg_pitch_types FROM c JOIN v ON c.country = v.country WHERE rn = 1""")
def country_arsenal(spark, sf_dir):
    return summaries.country_arsenal(summaries.pitching_summary(pitches(spark, sf_dir)))


@register("SELECT o_orderpriority AS country, CAST(o_custkey % 5 AS BIGINT) AS pool, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS total FROM orders GROUP BY ALL")
def roster_counts(spark, sf_dir):
    rows = view(spark, sf_dir, "SELECT o_orderpriority AS country, o_custkey % 5 AS pool, o_orderstatus AS role FROM {orders}")
    return summaries.roster_counts(rows, roles=("F", "O"))


@register(f"{WITH} SELECT pitch_type, count(*) AS n FROM pitches WHERE pitch_type IS NOT NULL GROUP BY pitch_type")
def value_counts(spark, sf_dir):
    return stats.value_counts(pitches(spark, sf_dir), "pitch_type")


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PITCH_NAMES.items())


@register(f"{WITH}, c AS (SELECT pitch_type, {even('CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100', 1)} AS pct FROM pitches WHERE pitch_type IS NOT NULL GROUP BY pitch_type) SELECT CASE pitch_type {_CASES} ELSE pitch_type END AS pitch_type, pct FROM c WHERE pct >= 6")
def usage_share(spark, sf_dir):
    return clean.label_codes(stats.usage_share(pitches(spark, sf_dir), "pitch_type", 6), "pitch_type", PITCH_NAMES)


@register(f"{WITH} SELECT country, count(*) AS n FROM pitches WHERE events = 'home_run' AND country IS NOT NULL GROUP BY country ORDER BY n DESC, country LIMIT 5")
def count_by_country(spark, sf_dir):
    return stats.count_by(pitches(spark, sf_dir), ("home_run",), "country", 5)


@register(f"{WITH} SELECT batter, avg(bat_speed) AS mean_value, count(bat_speed) AS n FROM pitches WHERE batter IS NOT NULL GROUP BY batter HAVING count(bat_speed) >= 100")
def mean_by_player(spark, sf_dir):
    return stats.mean_by(pitches(spark, sf_dir), "batter", "bat_speed", 100)


@register(f"{WITH} SELECT pitch_type, avg(bat_speed) AS mean_value, count(bat_speed) AS n FROM pitches WHERE pitch_type IS NOT NULL GROUP BY pitch_type HAVING count(bat_speed) >= 100")
def mean_by_type(spark, sf_dir):
    return stats.mean_by(pitches(spark, sf_dir), "pitch_type", "bat_speed", 100)


@register(f"{WITH}, c AS (SELECT country, events, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, events) AS rn FROM pitches WHERE events IS NOT NULL AND country IS NOT NULL GROUP BY country, events) SELECT country, events AS mode_value FROM c WHERE rn = 1")
def mode_by(spark, sf_dir):
    return summaries.mode_by(pitches(spark, sf_dir), "country", "events")


_FAST = "pitch_type IN ('FF', 'SI', 'FC')"


@register(f"{WITH} SELECT country, median(release_speed) AS median_value FROM pitches WHERE {_FAST} AND release_speed IS NOT NULL AND country IS NOT NULL GROUP BY country")
def median_by(spark, sf_dir):
    return stats.median_by(pitches(spark, sf_dir).filter(_FAST), "country", "release_speed")


@register(f"{WITH}, m AS (SELECT country, median(release_speed) AS v FROM pitches WHERE {_FAST} AND country IS NOT NULL GROUP BY country) SELECT round(avg(v), 9) AS mean_of_medians FROM m")
def mean_of_medians(spark, sf_dir):
    return stats.mean_of_medians(pitches(spark, sf_dir).filter(_FAST), "country", "release_speed").select(F.round("mean_of_medians", 9).alias("mean_of_medians"))


@register(f"{WITH} SELECT season, count(DISTINCT pitcher) AS n_pitcher, count(DISTINCT batter) AS n_batter, count(DISTINCT pitch_type) AS n_pitch_type FROM pitches WHERE season IS NOT NULL GROUP BY season")
def distinct_counts(spark, sf_dir):
    return stats.distinct_counts(pitches(spark, sf_dir), ["pitcher", "batter", "pitch_type"], "season")
