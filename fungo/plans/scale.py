"""Queries: exact quantiles, profiles, states by season, bucketed facts, range joins, mixed parts and density levels."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.operators import arsenal, profile, quantiles, spatial, states, stats
from fungo.plans import profiles, sources
from fungo.plans.core import BATTING, LONG, PITCHING, WITH
from fungo.plans.fixture import PITCHES, ROSTER_LINES, duck, pitches, view
from fungo.plans.registry import register, sql_of
from fungo.plans.schema import POOL_CITIES, ROSTER_COUNTRIES, SOURCE_COUNTRIES, TEAMS
from fungo.sources import tables
from fungo.sources.shared import shared_path


@register(f"{WITH} SELECT pitcher, round(quantile_cont(release_spin_rate, 0.1), 6) AS p10, round(quantile_cont(release_spin_rate, 0.5), 6) AS p50, round(quantile_cont(release_spin_rate, 0.9), 6) AS p90 FROM pitches WHERE pitcher IS NOT NULL AND release_spin_rate IS NOT NULL GROUP BY pitcher")
def quantiles_by_pitcher(spark, sf_dir):
    q = quantiles.exact_quantiles(pitches(spark, sf_dir), ["pitcher"], "release_spin_rate", [0.1, 0.5, 0.9])
    return q.select("pitcher", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


_MEASURES = ["bat_speed", "swing_length", "launch_speed", "attack_direction"]


def value_profile(spark, sf_dir):
    """Profiles are stored by season and read back: each query below scans the stored one."""
    path = shared_path(spark)
    tables.write_dataset(profile.value_profile(pitches(spark, sf_dir), _MEASURES, "pitch_type"), path, "parquet", "season")
    return spark.read.parquet(path)


@register(f"{WITH} SELECT pitch_type AS key, median(swing_length) AS median_value FROM pitches WHERE pitch_type IS NOT NULL AND swing_length IS NOT NULL GROUP BY pitch_type")
def profile_median(spark, sf_dir):
    return profile.profile_median(value_profile(spark, sf_dir), "swing_length")


@register(sql_of("describe"))
def profile_describe(spark, sf_dir):
    return profiles.rounded(profile.profile_describe(value_profile(spark, sf_dir), _MEASURES))


@register(sql_of("histogram"))
def profile_histogram(spark, sf_dir):
    return profiles.rounded(profile.profile_histogram(value_profile(spark, sf_dir), "bat_speed", 30))


@register(sql_of("box_stats"))
def profile_box_stats(spark, sf_dir):
    return profile.profile_box_stats(value_profile(spark, sf_dir), "swing_length").withColumnRenamed("key", "pitch_type")


_COUNTED = ["pitcher", "batter", "pitch_type", "release_spin_rate"]


@register(f"{WITH} " + profiles.union_lines(_COUNTED, lambda c: f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_exact, true AS near FROM pitches"))
def merged_distincts(spark, sf_dir):
    """Sketches stored by season, merged, against exact counts: within four standard errors."""
    rows, path = pitches(spark, sf_dir), shared_path(spark)
    tables.write_dataset(states.distinct_states(rows, _COUNTED), path, "parquet", "season")
    merged = states.merged_distincts(spark.read.parquet(path))
    exact = stats.distinct_counts(rows, _COUNTED).unpivot([], [f"n_{c}" for c in _COUNTED], "column_name", "n_exact").withColumn("column_name", F.substring("column_name", 3, 100))
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(4 * 1.04 / 2**6) * F.col("n_exact"), F.lit(0))
    return exact.join(merged, "column_name").select("column_name", "n_exact", near.alias("near"))


@register(f"{WITH}, f(wanted) AS (VALUES (0.1), (0.5), (0.9)) " + profiles.union_lines(["release_spin_rate", "launch_speed"], lambda c: f"SELECT '{c}' AS column_name, CAST(wanted AS DOUBLE) AS wanted, (SELECT count({c}) FROM pitches) AS n, true AS near FROM f"))
def merged_quantiles(spark, sf_dir):
    """Quantile sketches stored by season, merged; the rank of each answer is counted and lies within 2 % of what was asked for."""
    rows, path, at = pitches(spark, sf_dir), shared_path(spark), [0.1, 0.5, 0.9]
    tables.write_dataset(states.quantile_states(rows, ["release_spin_rate", "launch_speed"]), path, "parquet", "season")
    q = states.merged_quantiles(spark.read.parquet(path), at).select("column_name", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("wanted"), F.col("q").alias("value"))).alias("x")).select("column_name", "n", "x.wanted", "x.value")
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in ("release_spin_rate", "launch_speed")))).alias("y")).select("y.*").filter("v is not null")
    ranks = long.join(F.broadcast(q), "column_name").groupBy("column_name", "wanted", "n").agg(F.count_if(F.col("v") < F.col("value")).alias("less"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    near = (F.col("less") <= (F.col("wanted") + 0.02) * F.col("n")) & (F.col("upto") >= (F.col("wanted") - 0.02) * F.col("n"))
    return ranks.select("column_name", "wanted", "n", near.alias("near"))


_CHANGED = "CASE WHEN season = 1996 THEN release_speed + 1 ELSE release_speed END AS release_speed, CASE WHEN season = 1996 AND pitch_type = 'FF' THEN 'SI' ELSE pitch_type END AS pitch_type, CASE WHEN season = 1996 AND events = 'walk' THEN 'home_run' ELSE events END AS events"
_WITH_CHANGED = f"WITH pitches AS (SELECT * REPLACE ({_CHANGED}) FROM ({duck(PITCHES)}))"


def _refreshed(spark, sf_dir, kind: str):
    """States of all seasons; then one season's facts are replaced, its states alone made anew, and all states folded."""
    rows, facts, path = pitches(spark, sf_dir), shared_path(spark), shared_path(spark)
    tables.write_dataset(rows, facts, "parquet", "season")
    states.write_states(spark.read.parquet(facts), kind, path)
    new = rows.filter("season = 1996").withColumns({"release_speed": F.col("release_speed") + 1, "pitch_type": F.when(F.col("pitch_type") == "FF", "SI").otherwise(F.col("pitch_type")), "events": F.when(F.col("events") == "walk", "home_run").otherwise(F.col("events"))})
    tables.write_dataset(new, facts, "parquet", "season")
    states.refresh(spark.read.parquet(facts), 1996, kind, path)
    return states.fold_states(spark, kind, path)


@register(LONG.replace(WITH, _WITH_CHANGED) + " SELECT * FROM long")
def refreshed_arsenal(spark, sf_dir):
    return _refreshed(spark, sf_dir, "arsenal")


@register(BATTING.replace(WITH, _WITH_CHANGED) + " SELECT * FROM batting")
def refreshed_batting(spark, sf_dir):
    return _refreshed(spark, sf_dir, "batting")


@register(PITCHING.replace(WITH, _WITH_CHANGED) + " SELECT * FROM pitching")
def refreshed_pitching(spark, sf_dir):
    return _refreshed(spark, sf_dir, "pitching")


@register(LONG + " SELECT * FROM long")
def bucketed_arsenal(spark, sf_dir):
    """A1 on facts that lie bucketed by pitcher and season: no exchange in its plan."""
    return arsenal.arsenal_long(tables.write_facts(pitches(spark, sf_dir), f"fungo_facts_{uuid4().hex}", shared_path(spark), 8))


_SPANS = "SELECT concat('window ', CAST(n_nationkey AS STRING)) AS season, DATE '1995-01-01' + CAST(n_nationkey * 90 AS INT) AS first_day, CASE WHEN n_nationkey % 6 < 5 THEN DATE '1995-01-01' + CAST(n_nationkey * 97 + 150 AS INT) END AS last_day FROM {nation}"


@register(f"{WITH}, w AS ({duck(_SPANS)}) SELECT w.season, count(*) AS n, CAST(min(game_date) AS VARCHAR) AS first_seen, CAST(max(game_date) AS VARCHAR) AS last_seen FROM pitches p JOIN w ON p.game_date BETWEEN w.first_day AND coalesce(w.last_day, DATE '9999-12-31') GROUP BY w.season")
def season_windows(spark, sf_dir):
    """Windows from a table: some overlap, some are open."""
    rows = tables.season_windows(pitches(spark, sf_dir).select("game_date"), "game_date", view(spark, sf_dir, _SPANS))
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.min("game_date").cast("string").alias("first_seen"), F.max("game_date").cast("string").alias("last_seen"))


def _mixed(spark, sf_dir):
    """Every source is a folder of two parts whose headers differ in order and columns; some lines are broken."""
    rows, folder = view(spark, sf_dir, sources._SOURCED), shared_path(spark)
    source = F.concat("prefix", F.lit("_pitches.csv")).alias("source")
    key, value = F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string")
    odd = F.col("c_custkey") % 2 == 1
    one = rows.filter(~odd).select(key.alias("c_custkey"), F.when(F.col("c_custkey") % 10 == 4, "n/a").otherwise(value).alias("c_acctbal"), source)
    two = rows.filter(odd).select(F.when(F.col("c_custkey") % 10 == 3, F.concat(value, F.lit(",stray"))).otherwise(value).alias("c_acctbal"), F.concat(F.lit("no. "), key).alias("note"), key.alias("c_custkey"), source)
    for part in (one, two):
        part.write.partitionBy("source").mode("append").option("header", True).option("quote", "").csv(folder)
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType())])
    return tables.combine_parts(spark, folder, "_pitches.csv", None, SOURCE_COUNTRIES, schema)


@register(f"WITH s AS ({duck(sources._SOURCED)}) SELECT c_custkey, CASE WHEN c_custkey % 10 <> 4 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN concat('no. ', CAST(c_custkey AS VARCHAR)) END AS note, {sources.case('prefix', {k: v[0] for k, v in SOURCE_COUNTRIES.items()}, 'NULL')} AS country FROM s WHERE prefix NOT IN ('narnia', 'oz') AND c_custkey % 10 <> 3")
def combine_mixed_parts(spark, sf_dir):
    return _mixed(spark, sf_dir)[0].select("c_custkey", "c_acctbal", "note", "country")


@register(f"WITH s AS ({duck(sources._SOURCED)}) SELECT concat(prefix, '_pitches.csv') AS source, CASE WHEN c_custkey % 10 = 3 THEN 'fields' ELSE 'type' END AS reason, count(*) AS n FROM s WHERE c_custkey % 10 IN (3, 4) GROUP BY 1, 2")
def rejected_rows(spark, sf_dir):
    rejected = _mixed(spark, sf_dir)[2]
    return rejected.groupBy(F.regexp_extract(F.url_decode("file"), r"source=([^/]*)", 1).alias("source"), "reason").agg(F.count("*").alias("n"))


@register(sql_of("roster_sections"))
def roster_files(spark, sf_dir):
    """Rosters written as text files, one a priority, and parsed from them."""
    path = shared_path(spark)
    view(spark, sf_dir, ROSTER_LINES).repartition("f").sortWithinPartitions("f", "pos").select("f", "line").write.partitionBy("f").text(path)
    return tables.parse_roster(spark, path, ROSTER_COUNTRIES, POOL_CITIES, TEAMS)


@register("SELECT 'customers' AS dataset, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders")
def write_all(spark, sf_dir):
    """Two datasets written in one run, read back by their paths."""
    data = {"customers": view(spark, sf_dir, "SELECT c_custkey AS k, c_name FROM {customer}"), "orders": view(spark, sf_dir, "SELECT o_orderkey AS k, o_orderstatus FROM {orders}")}
    paths = tables.write_all(data, shared_path(spark), "_v1")
    frames = [tables.read_table(spark, p, data[n].schema).agg(F.lit(n).alias("dataset"), F.count("*").alias("n"), F.sum("k").alias("keys")) for n, p in zip(sorted(data), paths)]
    return frames[0].unionAll(frames[1])


@register(f"{WITH} SELECT DISTINCT pitcher, country FROM pitches")
def distinct_rows(spark, sf_dir):
    return tables.distinct_rows(pitches(spark, sf_dir), "pitcher", "country")


@register("SELECT o_orderkey, o_totalprice, CAST(1996 AS INT) AS season FROM orders WHERE year(o_orderdate) = 1996")
def missing_season(spark, sf_dir):
    """One of two stored seasons is not there yet."""
    rows, path = view(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE year(o_orderdate) = 1996"), shared_path(spark)
    tables.write_dataset(rows, f"{path}/1996")
    return tables.read_seasons(spark, {1996: f"{path}/1996", 2031: f"{path}/2031"}, rows.schema)


_SHARES = [round(1 - (0.1 + 0.9 * i / 7), 9) for i in range(8)]


@register(
    sql_of("density").replace("SELECT ce.country,", "SELECT ce.country AS country,").replace("WITH pitches", "WITH d AS (WITH pitches", 1)
    + "), h AS (SELECT *, round(sum(density) OVER (PARTITION BY country ORDER BY density DESC, gx, gy ROWS UNBOUNDED PRECEDING) / sum(density) OVER (PARTITION BY country), 9) AS held FROM d) SELECT country, gx, gy, CAST("
    + " + ".join(f"CASE WHEN density >= max(density) FILTER (WHERE held >= {s}) OVER (PARTITION BY country) THEN 1 ELSE 0 END" for s in _SHARES)
    + " AS INT) AS level FROM h"
)
def density_levels(spark, sf_dir):
    points = spatial.spray_coordinates(pitches(spark, sf_dir))
    return spatial.density_levels(profiles.rounded(spatial.spray_density(points, "country"), 9), "country").drop("density")
