"""Queries: projections, filters and scalar work."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.functions import numeric, text
from fungo.operators import clean, spatial
from fungo.plans.core import BATTING, WITH, in_list
from fungo.plans.fixture import BOARD, board, duck, pitches, view
from fungo.plans.registry import register
from fungo.plans.schema import AB_EVENTS, HIT_EVENTS, PA_EVENTS, PITCH_NAMES, WALK_EVENTS

BOARD_WITH = f"WITH board AS ({duck(BOARD)})"
_MIXED = "SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 51 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END AS mostly, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) ELSE 'x' END AS half, CASE WHEN o_orderkey % 3 = 0 THEN ' 1.5 ' WHEN o_orderkey % 3 = 1 THEN NULL ELSE '2' END AS gaps, CAST(NULL AS STRING) AS nothing FROM {orders}"


def _adopted(column: str) -> str:
    return f"(SELECT count(TRY_CAST(trim({column}) AS DOUBLE)) > 0.5 * count({column}) FROM m)"


@register(f"WITH m AS ({duck(_MIXED)}) SELECT o_orderkey, CASE WHEN {_adopted('mostly')} THEN TRY_CAST(trim(mostly) AS DOUBLE) END AS mostly, CASE WHEN {_adopted('half')} THEN 'number' ELSE half END AS half, TRY_CAST(trim(gaps) AS DOUBLE) AS gaps, nothing FROM m")
def coerce_numeric(spark, sf_dir):
    return clean.coerce_numeric(view(spark, sf_dir, _MIXED))


@register("SELECT c_custkey, CASE WHEN strpos(n, ',') > 0 THEN substr(n, 1, strpos(n, ',') - 1) ELSE n END AS last_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_mktsegment, ', ', c_name) END AS n FROM customer)")
def surname(spark, sf_dir):
    rows = view(spark, sf_dir, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_mktsegment, ', ', c_name) END AS n FROM {customer}")
    return rows.select("c_custkey", text.surname(F.col("n")).alias("last_name"))


@register(f"{WITH} SELECT CASE pitch_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in PITCH_NAMES.items() if k != 'SI')} ELSE pitch_type END AS pitch_type, count(*) AS n FROM pitches GROUP BY 1")
def label_codes(spark, sf_dir):
    labels = {k: v for k, v in PITCH_NAMES.items() if k != "SI"}
    return clean.label_codes(pitches(spark, sf_dir).select("pitch_type"), "pitch_type", labels).groupBy("pitch_type").agg(F.count("*").alias("n"))


@register(
    f"{WITH} SELECT pitcher, events, CAST(coalesce(events IN {in_list(AB_EVENTS)}, false) AS INT) AS is_ab, CAST(coalesce(events IN {in_list(PA_EVENTS)}, false) AS INT) AS is_pa, CAST(coalesce(events IN {in_list(HIT_EVENTS)}, false) AS INT) AS is_hit,"
    f" CAST(coalesce(events IN {in_list(WALK_EVENTS)}, false) AS INT) AS is_walk, CAST(coalesce(events IN ('strikeout', 'strikeout_double_play'), false) AS INT) AS is_strikeout FROM pitches"
)
def outcome_flags(spark, sf_dir):
    return clean.with_outcome_flags(pitches(spark, sf_dir).select("pitcher", "events"))


@register(f"{WITH} SELECT pitcher, batter, launch_speed, launch_angle FROM pitches WHERE launch_speed IS NOT NULL AND launch_angle IS NOT NULL")
def require_present(spark, sf_dir):
    return clean.require(pitches(spark, sf_dir), "launch_speed", "launch_angle").select("pitcher", "batter", "launch_speed", "launch_angle")


@register(f"{WITH} SELECT country, CAST(coalesce(events IN {in_list(HIT_EVENTS)}, false) AS INT) AS hit, count(*) AS n FROM pitches WHERE hc_x IS NOT NULL GROUP BY 1, 2")
def hits_vs_outs(spark, sf_dir):
    flagged = clean.with_hit(pitches(spark, sf_dir).filter("hc_x is not null"))
    return flagged.groupBy("country", F.col("hit").cast("int").alias("hit")).agg(F.count("*").alias("n"))


@register(f"{BATTING} SELECT player_name, mlbam_id, country FROM batting WHERE contains(lower(player_name), 'last1')")
def search_players(spark, sf_dir):
    from fungo.operators.summaries import batting_summary

    return clean.search_players(batting_summary(pitches(spark, sf_dir)), "LAST1", season="country").select("player_name", "mlbam_id", "country")


@register(f"{WITH} SELECT pitcher, round(2.5 * (hc_x - 125.42), 6) AS x, round(2.5 * (198.27 - hc_y), 6) AS y FROM pitches WHERE hc_x IS NOT NULL")
def spray_coordinates(spark, sf_dir):
    rows = spatial.spray_coordinates(pitches(spark, sf_dir).filter("hc_x is not null"))
    return rows.select("pitcher", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(f"{WITH} SELECT pitch_type, CASE WHEN plate_x IS NULL THEN 'unknown' WHEN abs(plate_x) <= 17.0 / 24 AND plate_z BETWEEN sz_bot AND sz_top THEN 'in' ELSE 'out' END AS zone, count(*) AS n FROM pitches GROUP BY 1, 2")
def in_zone(spark, sf_dir):
    zone = F.when(F.col("in_zone"), "in").when(~F.col("in_zone"), "out").otherwise("unknown")
    return spatial.with_in_zone(pitches(spark, sf_dir).withColumn("plate_z", F.when(F.col("plate_x").isNotNull(), F.col("plate_z")))).withColumn("zone", zone).groupBy("pitch_type", "zone").agg(F.count("*").alias("n"))


@register(f"{BOARD_WITH} SELECT player_id AS id, speed AS velocity, n FROM board")
def select_available(spark, sf_dir):
    return clean.select_available(board(spark, sf_dir), {"player_id": "id", "speed": "velocity", "missing": "absent", "n": "n"})


@register(f"{WITH} SELECT pitcher, coalesce(swing_path_tilt, 0) + coalesce(attack_angle, 0) + coalesce(swing_length, 0) AS total, swing_path_tilt IS NOT NULL OR attack_angle IS NOT NULL OR swing_length IS NOT NULL AS present FROM pitches")
def row_sum_any(spark, sf_dir):
    c = ("swing_path_tilt", "attack_angle", "swing_length")
    return pitches(spark, sf_dir).select("pitcher", numeric.row_sum(*c).alias("total"), numeric.any_present(*c).alias("present"))


@register(f"{BOARD_WITH} SELECT player_id, year, exit_velo, CASE WHEN exit_velo > 84 THEN 'above' WHEN exit_velo IS NOT NULL THEN 'below' END AS side FROM board")
def neutral_flag(spark, sf_dir):
    return clean.neutral_flag(board(spark, sf_dir), "exit_velo", 84.0).select("player_id", "year", "exit_velo", "side")


@register(f"{BOARD_WITH} SELECT entity_name, speed, exit_velo FROM board WHERE year = 1997 AND speed IS NOT NULL AND exit_velo IS NOT NULL")
def metric_pair(spark, sf_dir):
    return clean.metric_pair(board(spark, sf_dir), "speed", "exit_velo", 1997, "entity_name", "year")
