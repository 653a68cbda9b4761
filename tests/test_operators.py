import math

import pytest
from pyspark.sql import functions as F

from fungo.operators import arsenal, clean, leaderboards, spatial, stats, summaries
from fungo.plans.schema import ARSENAL_METRICS, PITCH_TYPES, PITCHES

EVENTS = "batter long, pitcher long, country string, player_name string, pitch_type string, events string, estimated_woba_using_speedangle double, launch_speed double, launch_angle double, release_speed double, release_spin_rate double"


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def arsenal_frame(spark, n_first, n_second):
    data = [(1, 2024, "FF", "swinging_strike" if i % 2 else "called_strike", 90.0 + i % 2, 2000.0, 0.5, None) for i in range(n_first)]
    data += [(2, 2024, "SL", "ball", None, None, None, None)] * n_second
    return spark.createDataFrame([*data, (None, 2024, "FF", "ball", 1.0, 1.0, 1.0, 1.0), (1, 2024, None, "ball", 1.0, 1.0, 1.0, 1.0)], "pitcher long, season int, pitch_type string, description string, release_speed double, release_spin_rate double, pfx_x double, pfx_z double")


def test_arsenal_threshold_nulls_and_zero_denominator(spark):
    got = rows(arsenal.arsenal_long(arsenal_frame(spark, 99, 100)), "pitcher", "n_pitches", "usage_pct", "whiff_rate", "avg_speed")
    assert got == [(2, 100, 100.0, None, None)]
    got = rows(arsenal.arsenal_long(arsenal_frame(spark, 100, 99)), "pitcher", "usage_pct", "whiff_rate", "avg_speed", "avg_pfx_z")
    assert got == [(1, 100.0, 0.5, 90.5, None)]
    assert rows(arsenal.arsenal_long(arsenal_frame(spark, 100, 99), denominator="swings"), "whiff_rate") == [(1.0,)]


def test_arsenal_wide_shape_and_names(spark):
    wide = arsenal.arsenal_wide(arsenal.arsenal_long(arsenal_frame(spark, 100, 100)))
    assert len(wide.columns) == 2 + len(PITCH_TYPES) * len(ARSENAL_METRICS)
    named = arsenal.enrich_names(wide, spark.createDataFrame([(1, "A", "B"), (1, "A", "B")], "id long, name_first string, name_last string"))
    assert len(named.columns) == 111
    assert sorted(rows(named, "player_id", "player_name", "FF_usage_pct", "SL_usage_pct")) == [(1, "A B", 100.0, None), (2, None, None, 100.0)]


def events(spark, *data):
    return spark.createDataFrame([(7, 9, "JPN", "X, Y", "FF", *d) if len(d) == 6 else d for d in data], EVENTS)


def test_batting_summary_by_hand(spark):
    e = [(x, None, None, None, None, None) for x in ("single", "home_run", "strikeout_double_play", "walk", "intent_walk", "hit_by_pitch", "catcher_interf", "pickoff_1b", None)]
    r = summaries.batting_summary(events(spark, *e)).first()
    assert (r.PA, r.AB, r.H, r["1B"], r.HR, r.BB, r.HBP, r.K, r.TB) == (7, 3, 2, 1, 1, 2, 1, 1, 5)
    assert (r.AVG, r.OBP, r.SLG, r.OPS, r.xwOBA) == (0.667, 0.714, 1.667, 2.381, None)
    r = summaries.batting_summary(events(spark, ("walk", None, None, None, None, None))).first()
    assert (r.AB, r.AVG, r.OBP, r.OPS) == (0, None, 1.0, None)
    assert summaries.batting_summary(events(spark, (None, 1, "JPN", "n", "FF", "single", 1.0, 1.0, 1.0, 1.0, 1.0))).count() == 0


def test_pitching_summary_primary_pitch(spark):
    e = [(7, 9, "JPN", "X", t, "strikeout", None, None, None, 95.0, None) for t in ("SL", "FF", "SL", "FF", None)]
    r = summaries.pitching_summary(events(spark, *e)).first()
    assert (r.total_pitches, r.K, r.pitch_type_count, r.primary_pitch, r.avg_velo, r.avg_spin_rate) == (5, 5, 2, "FF", 95.0, None)
    r = summaries.pitching_summary(events(spark, (7, 9, "JPN", "X", None, None, None, None, None, None, None))).first()
    assert (r.pitch_type_count, r.primary_pitch, r.opp_AVG) == (0, None, None)


def test_modes_and_counts(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), (None, "x"), ("b", None)], "k string, v string")
    assert rows(summaries.mode_by(df, "k", "v"), "k", "mode_value") == [("a", "x")]
    assert rows(stats.value_counts(df, "v"), "v", "n") == [("x", 2), ("y", 1)]
    assert rows(stats.usage_share(df, "v", 40), "v", "pct") == [("x", 66.7)]


def test_coerce_numeric_is_strict(spark):
    df = spark.createDataFrame([("1", "1", None), (" 2 ", "x", None), ("x", "2", None), (None, "x", None)], "most string, half string, nothing string")
    got = clean.coerce_numeric(df)
    assert dict(got.dtypes) == {"most": "double", "half": "string", "nothing": "string"}
    assert [r[0] for r in got.select("most").collect()] == [1.0, 2.0, None, None]


def test_hits_and_outs_cover_all(spark):
    df = spark.createDataFrame([("single",), ("field_out",), (None,)], "events string")
    hits, outs = clean.split_hits_outs(df)
    assert hits.count() == 1 and outs.count() == 2


@pytest.mark.parametrize("values, bins", [([0.0, 1.0, 2.0, 10.0], 5), ([3.0, 3.0], 4), ([], 3)])
def test_histogram_counts_every_value(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = rows(stats.histogram(df, "x", bins), "bin", "n")
    assert sum(n for _, n in got) == len(values)
    if len(set(values)) == 1:
        assert got == [(0, 2)]
    if values == [0.0, 1.0, 2.0, 10.0]:
        assert sorted(got) == [(0, 2), (1, 1), (4, 1)]


def test_binned_mean_is_right_closed(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 3.0), (2.0, 0.0, 5.0)], "x double, y double, v double")
    assert sorted(rows(stats.binned_mean(df, "x", "y", "v", 2), "x_bin", "y_bin", "mean_value")) == [(0, 0, 2.0), (1, 0, 5.0)]


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double")
    assert rows(stats.box_stats(df, "k", "v", ["a"]), "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers") == [(2.0, 3.0, 4.0, 1.0, 4.0, 1)]


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, 1.0)], "a double, b double")
    assert rows(stats.coverage(df, ["a", "b"]), "column_name", "n_present", "pct_present") == [("a", 2, 66.7), ("b", 1, 33.3), ("any", 2, 66.7)]
    assert rows(stats.missing_profile(df, 1), "column_name", "n_missing") == [("b", 2)]
    r = stats.describe(df, ["a"]).first()
    assert (r.n, r.mean, r.min, r.p50, r.max) == (2, 2.0, 1.0, 2.0, 3.0)
    assert math.isclose(r.std, math.sqrt(2))


def test_fits(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)] + [(9.0, None)], "x double, y double")
    r = stats.linear_fit(df, "x", "y").first()
    assert math.isclose(r.slope, 2) and math.isclose(r.intercept, 1) and (r.x_max, r.n) == (4.0, 5)
    assert math.isclose(stats.correlation(df, "x", "y").first().r, 1)


def test_hexbin_keeps_every_point(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5)) for i in range(70)] + [(None, 1.0)], "x double, y double")
    assert spatial.hexbin(df, "x", "y", 10).agg(F.sum("n")).first()[0] == 70


def test_density_sums_to_one(spark):
    df = spark.createDataFrame([("a", float(i % 9) * 10, 150.0 + (i * 7 % 11) * 10) for i in range(200)] + [("one", 1.0, 1.0)], "g string, x double, y double")
    got = spatial.spray_density(df, "g", step=10.0)
    assert abs(got.filter("g = 'a'").agg(F.sum("density") * 100).first()[0] - 1) < 0.01
    assert got.filter("g = 'one'").count() == 0


def test_zone(spark):
    df = spark.createDataFrame([(17 / 24, 2.0), (-0.8, 2.0), (0.0, 3.6), (None, 2.0)], "plate_x double, plate_z double").withColumns({"sz_bot": F.lit(1.5), "sz_top": F.lit(3.5)})
    assert [r.in_zone for r in spatial.with_in_zone(df).collect()] == [True, False, False, None]


def test_leaderboard_ties_nulls_and_seasons(spark):
    df = spark.createDataFrame([("b", 2024, 5.0), ("a", 2024, 5.0), ("c", 2024, None), ("d", 2023, 9.0), ("e", 2024, 1.0)], "name string, year int, m double")
    assert rows(leaderboards.leaderboard(df, 2024, "m", "name", 2), "name") == [("a",), ("b",)]
    assert rows(leaderboards.leaderboard(df, 2024, "m", "name", 1, True), "name") == [("e",)]
    assert list(leaderboards.leaderboards({"home_runs": df.withColumnRenamed("m", "no_doubters")}, 2024, {"home_runs": "name"})) == ["home_runs_no_doubters_top"]


def test_year_over_year_needs_both_years(spark):
    df = spark.createDataFrame([(1, 2023, 1.0), (1, 2024, 4.0), (2, 2024, 9.0), (3, 2023, None), (3, 2024, 1.0)], "id long, year int, m double")
    assert sorted(rows(leaderboards.year_over_year(df, "id", "year", 2023, 2024, ["m"]), "id", "m_2023", "m_2024")) == [(1, 1.0, 4.0), (3, None, 1.0)]
    assert rows(leaderboards.yoy_delta(df, "id", "year", 2023, 2024, "m"), "id", "delta") == [(1, 3.0)]


def test_component_top_n(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0)], "name string, x double, y double")
    assert sorted(rows(leaderboards.component_top_n(df, ["x", "y"], "name", 1), "component", "name", "rank")) == [("x", "b", 1), ("y", "b", 1)]


def test_pitch_schema_has_the_measures():
    assert {"bat_speed", "plate_x", "events", "season"} <= set(PITCHES.names)


def test_absent_columns_and_approximate_quartiles(spark):
    pitches = spark.createDataFrame([(1, "A", "N", "single"), (1, "A", "N", None)], "batter long, country string, player_name string, events string")
    r = summaries.batting_summary(pitches).first()
    assert (r["PA"], r["H"], r["xwOBA"], r["avg_exit_velo"], r["avg_launch_angle"]) == (1, 1, None, None, None)
    board = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "name string, stuff_fa double")
    assert [tuple(x) for x in arsenal.component_matrix(board, {"stuff_fa": "4-Seam FB"}).collect()] == [("a", 2.0), ("b", 1.0)]
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 102)] + [("a", 900.0)], "k string, v double")
    exact, near = (stats.box_stats(df, "k", "v", accuracy=a).first() for a in (None, 10_000))
    assert abs(exact["median"] - near["median"]) <= 1 and exact["n_outliers"] == near["n_outliers"] == 1
    assert abs(stats.describe(df, ["v"], accuracy=10_000).first()["p50"] - 51.5) <= 1
    assert leaderboards.change_histogram(board, ["delta"]).collect() == []
    assert {x["measure"] for x in leaderboards.change_histogram(board, ["delta", "stuff_fa"]).collect()} == {"stuff_fa"}


def test_pitch_location_without_a_zone(spark):
    df = spark.createDataFrame([("A", 1, "FF", 0.1, 2.0)], "country string, pitcher long, pitch_type string, plate_x double, plate_z double")
    assert [tuple(x) for x in spatial.pitch_location(df, "country", "A").collect()] == [("FF", 0, 4, 1, None)]
