"""Pitch-shaped views over the order tables, in SQL that Spark and DuckDB both run.

Only the shaping is shared; operators are DataFrame code, their oracles independent SQL.
Measures are multiples of a power of two, so sums do not depend on their order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PITCHES = """
SELECT l_suppkey AS pitcher, l_suppkey % 18 + 18 * (l_partkey % 5) AS batter, CAST(year(l_shipdate) AS INT) AS season, CAST(l_shipdate AS DATE) AS game_date,
  concat('Last', CAST(l_suppkey % 37 AS STRING), ', First', CAST(l_partkey % 11 AS STRING)) AS player_name,
  CASE WHEN l_partkey % 20 < 7 THEN 'FF' WHEN l_partkey % 20 < 11 THEN 'SL' WHEN l_partkey % 20 < 14 THEN 'SI' WHEN l_partkey % 20 < 16 THEN 'CH'
       WHEN l_partkey % 20 = 16 THEN 'CU' WHEN l_partkey % 20 = 17 THEN 'FC' WHEN l_partkey % 20 = 18 THEN 'FS' END AS pitch_type,
  CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'ball' WHEN 1 THEN 'called_strike' WHEN 2 THEN 'swinging_strike' WHEN 3 THEN 'swinging_strike_blocked'
       WHEN 4 THEN 'foul' WHEN 5 THEN 'foul_tip' WHEN 6 THEN 'hit_into_play' ELSE 'blocked_ball' END AS description,
  CASE WHEN (l_orderkey + 3 * l_linenumber) % 4 = 0 THEN
    CASE (l_orderkey + l_partkey) % 14 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'triple' WHEN 3 THEN 'home_run' WHEN 4 THEN 'field_out'
      WHEN 5 THEN 'strikeout' WHEN 6 THEN 'strikeout_double_play' WHEN 7 THEN 'walk' WHEN 8 THEN 'intent_walk' WHEN 9 THEN 'hit_by_pitch'
      WHEN 10 THEN 'sac_fly' WHEN 11 THEN 'field_error' WHEN 12 THEN 'catcher_interf' ELSE 'pickoff_1b' END END AS events,
  CAST(70 + l_quantity * 0.5 AS DOUBLE) AS release_speed,
  CASE WHEN l_partkey % 13 <> 0 THEN CAST(1500 + CAST(floor(l_extendedprice) AS BIGINT) % 1200 AS DOUBLE) END AS release_spin_rate,
  CAST((l_partkey % 33 - 16) / 8.0 AS DOUBLE) AS pfx_x, CASE WHEN l_orderkey % 17 <> 0 THEN CAST((l_orderkey % 41 - 20) / 8.0 AS DOUBLE) END AS pfx_z,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 6 THEN CAST(50 + (l_partkey * 7 + l_orderkey) % 140 * 0.5 AS DOUBLE) END AS launch_speed,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 6 THEN CAST((l_orderkey * 5 + l_partkey) % 160 - 80 AS DOUBLE) END AS launch_angle,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 6 THEN CAST((l_orderkey + l_suppkey) % 17 / 16.0 AS DOUBLE) END AS estimated_woba_using_speedangle,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 6 THEN CAST(25 + (l_partkey * 3 + l_orderkey) % 200 AS DOUBLE) END AS hc_x,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 6 THEN CAST(20 + (l_partkey + 11 * l_orderkey) % 170 AS DOUBLE) END AS hc_y,
  CASE WHEN l_partkey % 19 <> 0 THEN CAST((l_partkey % 49 - 24) / 16.0 AS DOUBLE) END AS plate_x,
  CAST((l_orderkey % 37) / 8.0 AS DOUBLE) AS plate_z, CAST(3.5 AS DOUBLE) AS sz_top, CAST(1.5 AS DOUBLE) AS sz_bot,
  CASE WHEN (l_orderkey + l_linenumber) % 8 BETWEEN 2 AND 6 THEN CAST(50 + (l_partkey + l_orderkey) % 64 * 0.5 AS DOUBLE) END AS bat_speed,
  CASE WHEN (l_orderkey + l_linenumber) % 8 BETWEEN 2 AND 6 THEN CAST(5 + (l_partkey * 3 + l_suppkey) % 40 / 8.0 AS DOUBLE) END AS swing_length,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 2 THEN CAST(20 + l_partkey % 25 AS DOUBLE) END AS swing_path_tilt,
  CASE WHEN (l_orderkey + l_linenumber) % 8 = 3 THEN CAST(l_partkey % 31 - 15 AS DOUBLE) END AS attack_angle,
  CAST(NULL AS DOUBLE) AS attack_direction,
  n_name AS country
FROM {lineitem} JOIN {nation} ON l_suppkey % 18 = n_nationkey
"""

#: A leaderboard-shaped table: entity and year with measures.
BOARD = f"""
SELECT pitcher AS player_id, season AS year, concat('Entity ', CAST(pitcher AS STRING)) AS entity_name, avg(release_speed) AS speed, avg(bat_speed) AS bat,
  CAST(count(launch_speed) AS BIGINT) AS n_batted, CASE WHEN pitcher % 9 <> 0 THEN avg(launch_speed) END AS exit_velo, CAST(count(*) AS BIGINT) AS n
FROM ({PITCHES}) AS p GROUP BY pitcher, season
"""

#: Lines of sectioned roster text, one file per order priority.
ROSTER_LINES = """
SELECT f, CAST(row_number() OVER (PARTITION BY f ORDER BY o_orderkey) AS INT) AS pos,
  CASE WHEN o_orderkey % 40 = 0 THEN '選手名,ポジション,チーム,40'
    WHEN o_orderkey % 40 = 1 THEN 'WBC 2026 roster'
    WHEN o_orderkey % 20 = 2 THEN concat(CASE o_custkey % 5 WHEN 0 THEN 'Japan' WHEN 1 THEN 'USA' WHEN 2 THEN 'Atlantis' WHEN 3 THEN 'Dominican Rep.' ELSE 'Cuba' END,
      '（国） — プール', CASE o_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END, '（', CASE o_custkey % 3 WHEN 0 THEN '東京ドーム' WHEN 1 THEN 'マイアミ' ELSE 'Osaka' END, '） — 30')
    WHEN o_orderkey % 40 = 3 THEN ' '
    WHEN o_orderkey % 40 = 5 THEN 'short,line'
    ELSE concat(CASE o_custkey % 3 WHEN 0 THEN concat('選手 / Player ', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('Name', CAST(o_custkey AS STRING), '（投手）') ELSE concat('Plain ', CAST(o_custkey AS STRING)) END,
      ',', CASE o_orderkey % 3 WHEN 0 THEN 'RHP' WHEN 1 THEN 'LHP' ELSE 'C' END, ',',
      CASE o_custkey % 6 WHEN 0 THEN 'シカゴ・カブス' WHEN 1 THEN 'FA（前ヤンキース）' WHEN 2 THEN 'FA' WHEN 3 THEN '引退復帰（前Foo）' WHEN 4 THEN '引退復帰' ELSE 'Local Club' END,
      ',', CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE 'NO' END) END AS line
FROM (SELECT o_orderpriority AS f, o_orderkey, o_custkey FROM {orders}) AS o
"""

_TABLE = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The shaped table on Spark."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(sql))}
    return spark.sql(sql, **tables)


def duck(sql: str) -> str:
    """The same shaping for DuckDB."""
    return _TABLE.sub(r"\1", sql)


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PITCHES)


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BOARD)
