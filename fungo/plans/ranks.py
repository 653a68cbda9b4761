"""Queries: leaderboards, comparisons of seasons and previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fungo.operators import arsenal, leaderboards
from fungo.operators.summaries import batting_summary
from fungo.plans.core import BATTING, WITH
from fungo.plans.fixture import board, pitches, view
from fungo.plans.registry import register
from fungo.plans.scalars import BOARD_WITH
from fungo.plans.schema import LEADERBOARDS


@register(f"{BOARD_WITH} SELECT entity_name, year, exit_velo FROM board WHERE year = 1997 AND exit_velo IS NOT NULL ORDER BY exit_velo DESC, entity_name LIMIT 20")
def leaderboard_top(spark, sf_dir):
    return leaderboards.leaderboard(board(spark, sf_dir), 1997, "exit_velo", "entity_name").select("entity_name", "year", "exit_velo")


@register(f"{BOARD_WITH} SELECT entity_name, year, speed FROM board WHERE year = 1996 ORDER BY speed, entity_name LIMIT 15")
def leaderboard_bottom(spark, sf_dir):
    return leaderboards.leaderboard(board(spark, sf_dir), 1996, "speed", "entity_name", 15, True).select("entity_name", "year", "speed")


@register(f'{BATTING} SELECT player_name, mlbam_id, country, "PA", "OPS" FROM batting WHERE "PA" >= 100 AND "OPS" IS NOT NULL ORDER BY "OPS" DESC, player_name, mlbam_id, country LIMIT 20')
def qualified_top(spark, sf_dir):
    summary = batting_summary(pitches(spark, sf_dir)).withColumn("label", F.struct("player_name", "mlbam_id", "country"))
    return leaderboards.qualified_top(summary, "PA", 100, "OPS", "label").select("player_name", "mlbam_id", "country", "PA", "OPS")


_PARTS = ("speed", "bat", "exit_velo")


@register(f"{BOARD_WITH}, u AS (" + " UNION ALL ".join(f"SELECT entity_name, '{c}' AS component, {c} AS value FROM board WHERE year = 1997" for c in _PARTS) + "), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY value DESC, entity_name) AS INT) AS rank FROM u WHERE value IS NOT NULL) SELECT * FROM r WHERE rank <= 15")
def component_top_n(spark, sf_dir):
    return leaderboards.component_top_n(board(spark, sf_dir).filter("year = 1997"), list(_PARTS), "entity_name")


@register(f"{BOARD_WITH} SELECT a.player_id, a.speed AS speed_1996, b.speed AS speed_1997, a.exit_velo AS exit_velo_1996, b.exit_velo AS exit_velo_1997 FROM board a JOIN board b ON a.player_id = b.player_id WHERE a.year = 1996 AND b.year = 1997")
def year_over_year(spark, sf_dir):
    return leaderboards.year_over_year(board(spark, sf_dir), "player_id", "year", 1996, 1997, ["speed", "exit_velo"])


@register(f"{BOARD_WITH} SELECT a.player_id, a.exit_velo AS exit_velo_1996, b.exit_velo AS exit_velo_1997, b.exit_velo - a.exit_velo AS delta FROM board a JOIN board b ON a.player_id = b.player_id WHERE a.year = 1996 AND b.year = 1997 AND a.exit_velo IS NOT NULL AND b.exit_velo IS NOT NULL ORDER BY delta DESC, a.player_id LIMIT 15")
def yoy_delta(spark, sf_dir):
    return leaderboards.yoy_delta(board(spark, sf_dir), "player_id", "year", 1996, 1997, "exit_velo")


_QUALITY = "SELECT p_partkey, p_name AS name, p_size * 10 AS ip, p_retailprice AS stuff_plus, CAST(p_size AS STRING) AS stuff_fa, CASE WHEN p_size % 4 = 0 THEN '-' ELSE CAST(p_size + 1 AS STRING) END AS stuff_sl FROM {part}"


@register("SELECT name, stuff_plus, TRY_CAST(stuff_fa AS DOUBLE) AS \"4-Seam FB\", TRY_CAST(stuff_sl AS DOUBLE) AS \"Slider\" FROM (" + _QUALITY.replace("{part}", "part").replace("p_name AS name", "concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name") + ") WHERE ip >= 100 ORDER BY stuff_plus DESC, name LIMIT 15")
def component_matrix(spark, sf_dir):
    rows = view(spark, sf_dir, _QUALITY.replace("p_name AS name", "concat(p_name, ' ', CAST(p_partkey AS STRING)) AS name"))
    return arsenal.component_matrix(rows, {"stuff_fa": "4-Seam FB", "stuff_sl": "Slider", "stuff_xx": "None"})


@register(f"{WITH}, t AS (SELECT country FROM pitches WHERE events = 'home_run' AND country IS NOT NULL GROUP BY country ORDER BY count(*) DESC, country LIMIT 5) SELECT country, pitch_type, count(*) AS n FROM pitches WHERE country IN (SELECT country FROM t) GROUP BY 1, 2")
def restrict_to_top(spark, sf_dir):
    from fungo.operators.stats import count_by

    rows = pitches(spark, sf_dir)
    return leaderboards.restrict_to(rows, count_by(rows, ("home_run",), "country", 5).select("country")).groupBy("country", "pitch_type").agg(F.count("*").alias("n"))


@register(f"{WITH} SELECT CAST(game_date AS VARCHAR) AS day, pitcher, bat_speed, launch_speed FROM pitches WHERE bat_speed IS NOT NULL AND launch_speed IS NOT NULL ORDER BY 1, 2, 3, 4 LIMIT 20")
def preview(spark, sf_dir):
    return leaderboards.preview(pitches(spark, sf_dir).withColumn("day", F.col("game_date").cast("string")), ["day", "pitcher", "bat_speed", "launch_speed"], ["bat_speed", "launch_speed"])


#: What each configured metric is read from on the board-shaped table.
_AS = {m: ("speed", "bat", "exit_velo", "n")[i % 4] for i, m in enumerate(dict.fromkeys(m for _, m, *_ in LEADERBOARDS))}


@register(f"{BOARD_WITH} " + " UNION ALL ".join(f"(SELECT '{b}_{m}_{'bottom' if asc else 'top'}' AS board, entity_name, CAST({_AS[m]} AS DOUBLE) AS value FROM board WHERE year = 1997 AND {_AS[m]} IS NOT NULL ORDER BY {_AS[m]} {'ASC' if asc else 'DESC'}, entity_name LIMIT {n})" for b, m, asc, n, _ in LEADERBOARDS))
def configured_boards(spark, sf_dir):
    """All configured leaderboards of a season, one below the other."""
    rows = board(spark, sf_dir)
    frames = {b: rows.select("entity_name", F.col("year").alias(season), *(F.col(_AS[m]).alias(m) for bb, m in dict.fromkeys((x[0], x[1]) for x in LEADERBOARDS) if bb == b)) for b, _, _, _, season in LEADERBOARDS}
    found = leaderboards.leaderboards(frames, 1997, dict.fromkeys(frames, "entity_name"))
    metric = {f"{b}_{m}_{'bottom' if asc else 'top'}": m for b, m, asc, *_ in LEADERBOARDS}
    return reduce(lambda a, b: a.unionAll(b), [df.select(F.lit(name).alias("board"), "entity_name", F.col(metric[name]).cast("double").alias("value")) for name, df in found.items()])


@register(f"{BOARD_WITH}, d AS (SELECT b.exit_velo - a.exit_velo AS delta FROM board a JOIN board b ON a.player_id = b.player_id WHERE a.year = 1996 AND b.year = 1997 AND a.exit_velo IS NOT NULL AND b.exit_velo IS NOT NULL), e AS (SELECT min(delta) AS lo, max(delta) AS hi FROM d) SELECT CAST(least(floor((delta - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n, 'delta_1996_1997' AS measure FROM d, e GROUP BY 1")
def year_to_year(spark, sf_dir):
    """Changes between seasons in bins: the newer pair of seasons is not in the table, so the older one is taken."""
    changes = leaderboards.yoy_delta(board(spark, sf_dir), "player_id", "year", 1996, 1997, "exit_velo", n=None).withColumnRenamed("delta", "delta_1996_1997")
    return leaderboards.change_histogram(changes, ["delta_1997_1998", "delta_1996_1997"]).select("bin", "n", "measure")
