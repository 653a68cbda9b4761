"""Queries: sources, unions and roster text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.functions import text
from fungo.plans.fixture import PITCHES, ROSTER_LINES, duck, pitches, view
from fungo.plans.registry import register
from fungo.plans.schema import POOL_CITIES, ROSTER_COUNTRIES, SOURCE_COUNTRIES, TEAMS
from fungo.sources import tables
from fungo.sources.shared import shared_path

WITH = f"WITH pitches AS ({duck(PITCHES)})"


def case(column: str, mapping: dict, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {otherwise} END"


@register("SELECT o_orderkey, CAST(1995 AS INT) AS season, o_totalprice, CAST(NULL AS STRING) AS o_orderstatus FROM orders WHERE year(o_orderdate) = 1995 UNION ALL SELECT o_orderkey, CAST(1996 AS INT), NULL, o_orderstatus FROM orders WHERE year(o_orderdate) = 1996")
def union_seasons(spark, sf_dir):
    a = view(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE year(o_orderdate) = 1995")
    b = view(spark, sf_dir, "SELECT o_orderkey, o_orderstatus, 1996 AS season FROM {orders} WHERE year(o_orderdate) = 1996")
    return tables.union_seasons({1995: a, 1996: b})


_WINDOWS = [(1995, "1995-03-28", "1995-10-01"), (1996, "1996-04-01", "1996-09-30"), (1997, "1997-04-01", "1997-10-26")]


@register(f"{WITH}, w(season, a, b) AS (VALUES " + ", ".join(f"({s}, DATE '{a}', DATE '{b}')" for s, a, b in _WINDOWS) + ") SELECT w.season, count(*) AS n, CAST(min(game_date) AS VARCHAR) AS first_day, CAST(max(game_date) AS VARCHAR) AS last_day, count(DISTINCT pitcher) AS pitchers FROM pitches p JOIN w ON p.game_date BETWEEN w.a AND w.b GROUP BY w.season")
def season_window(spark, sf_dir):
    rows = tables.season_window(pitches(spark, sf_dir).drop("season"), "game_date", _WINDOWS)
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.min("game_date").cast("string").alias("first_day"), F.max("game_date").cast("string").alias("last_day"), F.count_distinct("pitcher").alias("pitchers"))


_PREFIXES = [*SOURCE_COUNTRIES, "narnia", "oz"]
_SOURCED = "SELECT c_custkey, c_acctbal, " + "CASE CAST(c_custkey % 22 AS INT) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PREFIXES)) + " END AS prefix FROM {customer}"


@register(f"WITH s AS ({duck(_SOURCED)}) SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN concat('no. ', CAST(c_custkey AS VARCHAR)) END AS note, {case('prefix', {k: v[0] for k, v in SOURCE_COUNTRIES.items()}, 'NULL')} AS country, {case('prefix', {k: v[1] for k, v in SOURCE_COUNTRIES.items()}, 'NULL')} AS country_name FROM s WHERE prefix NOT IN ('narnia', 'oz')")
def combine_sources(spark, sf_dir):
    """Sources of unequal columns, and one to leave out, are written by prefix and combined again."""
    rows, folder = view(spark, sf_dir, _SOURCED).withColumn("source", F.concat("prefix", F.lit("_pitches.csv"))), shared_path(spark)
    odd = F.col("c_custkey") % 2 == 1  # one prefix, one parity
    with_note = rows.filter(odd).select("c_acctbal", F.concat(F.lit("no. "), F.col("c_custkey").cast("string")).alias("note"), "c_custkey", "source")
    left_out = rows.select("c_custkey", F.concat("prefix", F.lit("_batters_pitches.csv")).alias("source"))
    for part in (rows.filter(~odd).select("c_custkey", "c_acctbal", "source"), with_note, left_out):
        part.write.partitionBy("source").mode("append").option("header", True).csv(folder)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())])
    return tables.combine_sources(spark, folder, "_pitches.csv", "_batters_pitches", SOURCE_COUNTRIES, schema)[0].select("c_custkey", "c_acctbal", "note", "country", "country_name")


@register("SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN 2 * o_totalprice ELSE o_totalprice END AS price, CAST(year(o_orderdate) AS INT) AS season FROM orders")
def partition_refresh(spark, sf_dir):
    """All seasons are written, then one again with new values: it alone is replaced."""
    rows, path = view(spark, sf_dir, "SELECT o_orderkey, o_totalprice AS price, CAST(year(o_orderdate) AS INT) AS season FROM {orders}"), shared_path(spark)
    tables.write_dataset(rows, path, "parquet", "season")
    tables.write_dataset(rows.filter("season = 1996").withColumn("price", 2 * F.col("price")), path, "parquet", "season")
    return tables.read_table(spark, path, fmt="parquet").select("o_orderkey", "price", "season")


@register(f"WITH s AS ({duck(_SOURCED)}) SELECT prefix, count(*) AS n_rows FROM s WHERE prefix IN ('narnia', 'oz') GROUP BY prefix")
def unmatched_sources(spark, sf_dir):
    return tables.tag_sources(view(spark, sf_dir, _SOURCED), "prefix", SOURCE_COUNTRIES)[1]


_FORMER = "CASE WHEN contains(t, '前') AND contains(split_part(t, '前', 2), '）') THEN split_part(split_part(t, '前', 2), '）', 1) ELSE '' END"


def _team_sql() -> str:
    """DuckDB text for the team label of column `t`."""
    former = f"CASE WHEN {_FORMER} = '' THEN '{{plain}}' ELSE concat('{{label}} (former ', {case(_FORMER, TEAMS, _FORMER)}, ')') END"
    rest = f"CASE WHEN contains(t, 'FA') THEN {former.format(plain='Free Agent', label='FA')} WHEN contains(t, '引退復帰') THEN {former.format(plain='Returning from retirement', label='Returning from retirement')} ELSE t END"
    return case("t", TEAMS, rest)


@register(f"""WITH raw AS ({duck(ROSTER_LINES)}), l AS (SELECT f, pos, trim(line) AS line FROM raw WHERE trim(line) <> '' AND NOT starts_with(trim(line), 'WBC 2026') AND NOT starts_with(trim(line), '出典')),
h AS (SELECT *, contains(line, '— プール') AS is_head, trim(split_part(line, '（', 1)) AS hc, substr(split_part(line, 'プール', 2), 1, 1) AS hp, split_part(split_part(split_part(line, 'プール', 2), '（', 2), '）', 1) AS hcity FROM l),
g AS (SELECT *, count(*) FILTER (WHERE is_head) OVER (PARTITION BY f ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM h),
d AS (SELECT f, section, {case('hc', ROSTER_COUNTRIES, 'NULL')} AS country, concat(hp, ' (', {case('hcity', POOL_CITIES, 'hcity')}, ')') AS pool FROM g WHERE is_head),
p AS (SELECT d.country, d.pool, string_split(line, ',') AS x FROM g JOIN d ON g.f = d.f AND g.section = d.section WHERE NOT is_head AND NOT starts_with(line, '選手名,') AND d.country IS NOT NULL),
q AS (SELECT trim(x[1]) AS nm, country, pool, trim(x[2]) AS position, trim(x[3]) AS t, trim(coalesce(x[4], '')) AS o FROM p WHERE len(x) >= 3 AND trim(x[1]) <> '')
SELECT CASE WHEN contains(nm, ' / ') THEN regexp_extract(nm, '^.*? / (.*)$', 1) ELSE trim(regexp_replace(nm, '（.+?）', '', 'g')) END AS name, country, pool, position, {_team_sql()} AS team, o = 'YES' AS on_40_man, CASE WHEN position IN ('RHP', 'LHP') THEN 'pitcher' ELSE 'batter' END AS role FROM q""")
def roster_sections(spark, sf_dir):
    return tables.roster_rows(view(spark, sf_dir, ROSTER_LINES), "f", "pos", "line", ROSTER_COUNTRIES, POOL_CITIES, TEAMS)


@register("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_roundtrip(spark, sf_dir):
    df = view(spark, sf_dir, "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM {customer}")
    path = shared_path(spark)
    tables.write_dataset(df, path)
    return tables.read_table(spark, path, df.schema)


@register("SELECT s_suppkey, s_name FROM supplier")
def drop_index_column(spark, sf_dir):
    return tables.drop_index_column(view(spark, sf_dir, "SELECT s_suppkey AS `Unnamed: 0`, s_suppkey, s_name FROM {supplier}"))


_TEAM_TEXT = "SELECT o_orderkey, CASE o_custkey % 7 WHEN 0 THEN 'シカゴ・カブス' WHEN 1 THEN 'FA（前ヤンキース）' WHEN 2 THEN 'FA' WHEN 3 THEN '引退復帰（前Foo）' WHEN 4 THEN '引退復帰' WHEN 5 THEN NULL ELSE concat('Club ', CAST(o_custkey AS STRING)) END AS t FROM {orders}"


@register(f"SELECT o_orderkey, CASE WHEN t IS NULL THEN NULL ELSE {_team_sql()} END AS team FROM ({duck(_TEAM_TEXT)})")
def translate_team(spark, sf_dir):
    return view(spark, sf_dir, _TEAM_TEXT).select("o_orderkey", text.translate_team(F.col("t"), TEAMS).alias("team"))


_PLAYERS = "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN concat('選手 / Player / ', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('Name', CAST(o_custkey AS STRING), '（投手） （x）') ELSE 'Plain' END AS name, CASE o_orderkey % 3 WHEN 0 THEN 'RHP' WHEN 1 THEN 'LHP' ELSE 'C' END AS position, 'ドジャース' AS team, CASE WHEN o_orderkey % 2 = 0 THEN 'YES' ELSE '' END AS on_40_man FROM {orders}"


@register(f"SELECT o_orderkey, CASE WHEN contains(name, ' / ') THEN regexp_extract(name, '^.*? / (.*)$', 1) ELSE trim(regexp_replace(name, '（.+?）', '', 'g')) END AS name, position, 'Dodgers' AS team, on_40_man = 'YES' AS on_40_man, CASE WHEN position = 'C' THEN 'batter' ELSE 'pitcher' END AS role FROM ({duck(_PLAYERS)})")
def normalize_roster(spark, sf_dir):
    return tables.normalize_roster(view(spark, sf_dir, _PLAYERS), TEAMS)
