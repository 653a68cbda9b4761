"""Queries: coverage, distributions, maps and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.operators import spatial, stats
from fungo.plans.core import WITH, even
from fungo.plans.fixture import pitches
from fungo.plans.registry import register
from fungo.plans.schema import BAT_MEASURES


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` decimals: sums of squares and quantiles differ in the last bits between engines."""
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def union_lines(columns, line) -> str:
    return " UNION ALL ".join(line(c) for c in columns)


_ANY = " OR ".join(f"{c} IS NOT NULL" for c in BAT_MEASURES)


@register(f"{WITH}, r AS ({union_lines(BAT_MEASURES, lambda c: f'''SELECT '{c}' AS column_name, count({c}) AS n_present, count(*) AS a FROM pitches''')} UNION ALL SELECT 'any', count(*) FILTER (WHERE {_ANY}), count(*) FROM pitches) SELECT column_name, n_present, {even('CAST(n_present AS DOUBLE) / a * 100', 1)} AS pct_present FROM r")
def coverage(spark, sf_dir):
    return stats.coverage(pitches(spark, sf_dir), list(BAT_MEASURES))


_SPARSE = ("attack_direction", "pitch_type", "events", "launch_speed", "release_spin_rate", "pfx_z", "plate_x")


@register(f"{WITH}, r AS ({union_lines(_SPARSE, lambda c: f'''SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, count(*) AS a FROM pitches''')}) SELECT column_name, n_missing, {even('CAST(n_missing AS DOUBLE) / a * 100', 1)} AS pct_missing FROM r ORDER BY n_missing DESC, column_name LIMIT 5")
def missing_profile(spark, sf_dir):
    return stats.missing_profile(pitches(spark, sf_dir).select(*_SPARSE), 5)


_MEASURED = ("bat_speed", "swing_length", "launch_speed", "attack_direction")


@register(f"{WITH} " + union_lines(_MEASURED, lambda c: f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM pitches"))
def describe(spark, sf_dir):
    return rounded(stats.describe(pitches(spark, sf_dir), list(_MEASURED)))


@register(f"{WITH}, b AS (SELECT min(bat_speed) AS lo, max(bat_speed) AS hi FROM pitches) SELECT CAST(least(floor((bat_speed - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, round(lo + least(floor((bat_speed - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30), 6) AS lo, round(lo + (least(floor((bat_speed - lo) / ((hi - lo) / 30)), 29) + 1) * ((hi - lo) / 30), 6) AS hi, count(*) AS n FROM pitches, b WHERE bat_speed IS NOT NULL GROUP BY 1, 2, 3")
def histogram(spark, sf_dir):
    return rounded(stats.histogram(pitches(spark, sf_dir), "bat_speed", 30))


@register(f"{WITH}, q AS (SELECT pitch_type, quantile_cont(swing_length, 0.25) AS q1, quantile_cont(swing_length, 0.5) AS median, quantile_cont(swing_length, 0.75) AS q3 FROM pitches WHERE pitch_type IS NOT NULL AND swing_length IS NOT NULL GROUP BY 1) SELECT p.pitch_type, q1, median, q3, min(swing_length) FILTER (WHERE swing_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(swing_length) FILTER (WHERE swing_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (WHERE NOT swing_length BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers FROM pitches p JOIN q ON p.pitch_type = q.pitch_type WHERE swing_length IS NOT NULL GROUP BY p.pitch_type, q1, median, q3")
def box_stats(spark, sf_dir):
    return stats.box_stats(pitches(spark, sf_dir), "pitch_type", "swing_length")


@register(f"""{WITH}, b AS (SELECT min(launch_angle) AS xl, max(launch_angle) AS xh, min(launch_speed) AS yl, max(launch_speed) AS yh FROM pitches WHERE launch_angle IS NOT NULL AND launch_speed IS NOT NULL),
s AS (SELECT (launch_angle - xl) / ((xh - xl) / 50) AS u, (launch_speed - yl) / ((yh - yl) / 28) AS v FROM pitches, b WHERE launch_angle IS NOT NULL AND launch_speed IS NOT NULL),
c AS (SELECT u, v, round_even(u, 0) AS i1, round_even(v, 0) AS j1, floor(u) AS i2, floor(v) AS j2 FROM s),
d AS (SELECT *, (u - i1) * (u - i1) + 3.0 * (v - j1) * (v - j1) <= (u - i2 - 0.5) * (u - i2 - 0.5) + 3.0 * (v - j2 - 0.5) * (v - j2 - 0.5) AS near FROM c)
SELECT CAST(NOT near AS INT) AS lattice, CAST(CASE WHEN near THEN i1 ELSE i2 END AS INT) AS i, CAST(CASE WHEN near THEN j1 ELSE j2 END AS INT) AS j, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def hexbin(spark, sf_dir):
    return spatial.hexbin(pitches(spark, sf_dir), "launch_angle", "launch_speed", 50)


@register(f"""{WITH}, b AS (SELECT min(bat_speed) AS xl, max(bat_speed) AS xh, min(swing_length) AS yl, max(swing_length) AS yh FROM pitches WHERE bat_speed IS NOT NULL AND swing_length IS NOT NULL AND launch_speed IS NOT NULL)
SELECT CAST(greatest(least(ceil((bat_speed - xl) / ((xh - xl) / 20)) - 1, 19), 0) AS INT) AS x_bin, CAST(greatest(least(ceil((swing_length - yl) / ((yh - yl) / 20)) - 1, 19), 0) AS INT) AS y_bin, avg(launch_speed) AS mean_value, count(*) AS n
FROM pitches, b WHERE bat_speed IS NOT NULL AND swing_length IS NOT NULL AND launch_speed IS NOT NULL GROUP BY 1, 2""")
def binned_mean(spark, sf_dir):
    return stats.binned_mean(pitches(spark, sf_dir), "bat_speed", "swing_length", "launch_speed")


@register(f"{WITH} SELECT season, round(corr(bat_speed, launch_speed), 6) AS r, count(*) AS n FROM pitches WHERE bat_speed IS NOT NULL AND launch_speed IS NOT NULL GROUP BY season")
def correlation(spark, sf_dir):
    return rounded(stats.correlation(pitches(spark, sf_dir), "bat_speed", "launch_speed", "season"))


@register(f"{WITH} SELECT round(regr_slope(launch_speed, bat_speed), 6) AS slope, round(regr_intercept(launch_speed, bat_speed), 6) AS intercept, min(bat_speed) AS x_min, max(bat_speed) AS x_max, count(*) AS n FROM pitches WHERE bat_speed IS NOT NULL AND launch_speed IS NOT NULL")
def linear_fit(spark, sf_dir):
    return rounded(stats.linear_fit(pitches(spark, sf_dir), "bat_speed", "launch_speed"))


@register(f"""{WITH}, pt AS (SELECT country, 2.5 * (hc_x - 125.42) AS x, 2.5 * (198.27 - hc_y) AS y FROM pitches WHERE hc_x IS NOT NULL AND hc_y IS NOT NULL),
st AS (SELECT country, count(*) AS n, covar_samp(x, x) * pow(CAST(count(*) AS DOUBLE), -1.0 / 3) * 0.49 AS a, covar_samp(x, y) * pow(CAST(count(*) AS DOUBLE), -1.0 / 3) * 0.49 AS b, covar_samp(y, y) * pow(CAST(count(*) AS DOUBLE), -1.0 / 3) * 0.49 AS c FROM pt GROUP BY country),
ce AS (SELECT country, floor(x / 10) AS cx, floor(y / 10) AS cy, count(*) AS w FROM pt GROUP BY 1, 2, 3),
g AS (SELECT -350.0 + i * 50 AS gx, j * 50.0 AS gy FROM range(15) t(i), range(9) u(j))
SELECT ce.country, CAST(gx AS DOUBLE) AS gx, CAST(gy AS DOUBLE) AS gy, round(sum(w * exp(-(c * (gx - (cx + 0.5) * 10) * (gx - (cx + 0.5) * 10) - 2 * b * (gx - (cx + 0.5) * 10) * (gy - (cy + 0.5) * 10) + a * (gy - (cy + 0.5) * 10) * (gy - (cy + 0.5) * 10)) / (a * c - b * b) / 2)) / (any_value(n) * 2 * pi() * sqrt(any_value(a * c - b * b))), 9) AS density
FROM ce JOIN st ON ce.country = st.country, g GROUP BY ce.country, gx, gy""")
def density(spark, sf_dir):
    points = spatial.spray_coordinates(pitches(spark, sf_dir))
    return rounded(spatial.spray_density(points, "country"), 9)


@register(f"{WITH} " + union_lines(("launch_speed", "bat_speed", "attack_direction"), lambda c: f"SELECT '{c}' AS column_name, CAST(coalesce(sum({c}), 0) AS DOUBLE) AS total FROM pitches"))
def column_totals(spark, sf_dir):
    return stats.column_totals(pitches(spark, sf_dir), ["launch_speed", "bat_speed", "attack_direction"])


@register(f"{WITH} SELECT count(*) AS n_rows, count(bat_speed) AS n_covered, {even('count(*) * (187.0::DOUBLE / 7)', 0)} AS estimated_rows, {even('count(bat_speed) * (187.0::DOUBLE / 7)', 0)} AS estimated_covered FROM pitches WHERE game_date BETWEEN DATE '1996-04-01' AND DATE '1996-04-07'")
def extrapolate(spark, sf_dir):
    return stats.extrapolate(pitches(spark, sf_dir).filter("game_date between date '1996-04-01' and date '1996-04-07'"), 7, 187, "bat_speed")


@register(f"""{WITH}, t AS (SELECT pitcher FROM pitches WHERE country = 'NATION_3' AND pitcher IS NOT NULL GROUP BY pitcher ORDER BY count(*) DESC, pitcher LIMIT 1)
SELECT pitch_type, CAST(floor(plate_x / 0.5) AS INT) AS cell_x, CAST(floor(plate_z / 0.5) AS INT) AS cell_z, count(*) AS n, CAST(count(*) FILTER (WHERE abs(plate_x) <= 17.0 / 24 AND plate_z BETWEEN sz_bot AND sz_top) AS DOUBLE) / count(*) AS in_zone_share
FROM pitches WHERE country = 'NATION_3' AND pitcher IN (SELECT pitcher FROM t) AND pitch_type IS NOT NULL AND plate_x IS NOT NULL AND plate_z IS NOT NULL GROUP BY 1, 2, 3""")
def pitch_location(spark, sf_dir):
    return spatial.pitch_location(pitches(spark, sf_dir), "country", "NATION_3")


@register(f"{WITH}, g AS (SELECT country, pitch_type, count(*) AS n FROM pitches GROUP BY 1, 2) SELECT country, pitch_type, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY country) AS DOUBLE) AS share FROM g")
def share_of_total(spark, sf_dir):
    return stats.share_of_total(pitches(spark, sf_dir).groupBy("country", "pitch_type").agg(F.count("*").alias("n")), "country", "n")
