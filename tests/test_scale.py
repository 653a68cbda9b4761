"""States, bucketed facts, range joins, mixed parts, carries over chunks, density tiles and published order."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.operators import arsenal, leaderboards, spatial, states, summaries
from fungo.plans.core import BATTING, LONG, PITCHING
from fungo.plans.fixture import pitches
from fungo.plans.schema import POOL_CITIES, ROSTER_COUNTRIES, SOURCE_COUNTRIES, TEAMS
from fungo.sources import tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_refresh_scans_one_season_and_replaces_it(spark, tmp_path):
    facts, path = str(tmp_path / "facts"), str(tmp_path / "states")
    tables.write_dataset(pitches(spark, SF), facts, "parquet", "season")
    states.write_states(spark.read.parquet(facts), "arsenal", path)
    before = {f.name for f in (tmp_path / "states" / "season=1995").iterdir()}
    season = spark.read.parquet(facts).filter(F.col("season") == 1996)
    assert "PartitionFilters: [isnotnull(season" in plan_of(arsenal.arsenal_states(season))
    states.refresh(spark.read.parquet(facts), 1996, "arsenal", path)
    assert {f.name for f in (tmp_path / "states" / "season=1995").iterdir()} == before
    assert rows(states.fold_states(spark, "arsenal", path)) == rows(arsenal.arsenal_long(pitches(spark, SF)))


def test_states_of_halves_fold_to_the_whole(spark):
    df = pitches(spark, SF)
    half = [df.filter(f"batter % 2 = {i}") for i in (0, 1)]
    two = lambda f: f(half[0]).unionByName(f(half[1]))
    assert rows(arsenal.fold_arsenal(two(arsenal.arsenal_states))) == rows(arsenal.arsenal_long(df))
    assert rows(summaries.fold_batting(two(summaries.batting_states))) == rows(summaries.batting_summary(df))
    assert rows(summaries.fold_pitching(two(summaries.pitching_states))) == rows(summaries.pitching_summary(df))


def test_merged_sketches_do_not_depend_on_the_split(spark):
    df = spark.range(40_000).select((F.col("id") % 7).alias("season"), (F.col("id") % 3).alias("other"), (F.col("id") * 7 % 30_011).alias("v"))
    by = {k: states.merged_distincts(states.distinct_states(df, ["v"], k)).first().n_distinct for k in ("season", "other")}
    assert by["season"] == by["other"] and abs(by["season"] - 30_011) < 4 * 0.0163 * 30_011
    q = states.merged_quantiles(states.quantile_states(df, ["v"]), [0.1, 0.5, 0.9]).first()
    exact = sorted(i * 7 % 30_011 for i in range(40_000))
    ranks = [sum(x < v for x in exact) / 40_000 for v in q.q]
    assert q.n == 40_000 and all(abs(r - f) < 0.02 for r, f in zip(ranks, (0.1, 0.5, 0.9)))
    null = spark.createDataFrame([(1, None), (2, None)], "season int, v double")
    assert states.merged_distincts(states.distinct_states(null, ["v"])).first().n_distinct == 0


def test_bucketed_facts_need_no_exchange(spark, tmp_path):
    df = pitches(spark, SF)
    facts = tables.write_facts(df, "fungo_test_facts", str(tmp_path / "facts"), 4)
    try:
        out = arsenal.arsenal_long(facts)
        assert "Exchange" not in plan_of(out)
        assert rows(out) == rows(arsenal.arsenal_long(df))
    finally:
        spark.sql("drop table fungo_test_facts")


def test_year_over_year_exchanges_once(spark):
    df = spark.range(100).select((F.col("id") % 30).alias("k"), (F.lit(1996) + F.col("id") % 3).cast("int").alias("year"), F.col("id").cast("double").alias("m"))
    out = leaderboards.year_over_year(df, "k", "year", 1996, 1997, ["m"])
    assert plan_of(out).count("Exchange hash") == 1


def test_season_windows_overlap_and_stay_open(spark):
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-06-01", 2), ("2025-01-01", 3), (None, 4), ("2019-12-31", 5)], "day string, x int")
    windows = spark.createDataFrame([("a", "2024-01-01", "2024-06-01"), ("b", "2024-05-31", None), ("c", "2025-01-01", "2024-01-01"), (None, "2024-01-01", None), ("d", None, None), ("e", "2030-01-01", None)], "season string, first_day string, last_day string")
    for days_a_bucket in (1, 32):
        out = tables.season_windows(days, "day", windows, bucket_days=days_a_bucket)
        assert rows(out, "season", "x") == [("a", 1), ("a", 2), ("b", 2), ("b", 3)]
        assert out.columns == ["day", "x", "season"]
    assert "NestedLoop" not in plan_of(tables.season_windows(days, "day", windows))


def test_parts_with_swapped_columns_and_broken_lines(spark, tmp_path):
    part = tmp_path / "japan_statcast.csv"
    part.mkdir()
    (part / "part-0.csv").write_text("a,b\n10,20\n11,x\n12\n\n13,\"2,5\"\n")
    (part / "part-1.csv").write_text("b,a,c\n200,100,note\n201,101,q,r\n")
    (tmp_path / "usa_statcast.csv").write_text("a,b\n")
    (tmp_path / "empty_statcast.csv").write_text("")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    combined, skipped, rejected = tables.combine_parts(spark, str(tmp_path), "_statcast.csv", None, SOURCE_COUNTRIES, schema)
    assert rows(combined, "a", "b", "c", "country") == [(10, 20.0, None, "JPN"), (100, 200.0, "note", "JPN"), (11, None, None, "JPN"), (13, None, None, "JPN")]
    assert skipped.count() == 0
    assert [(f.rsplit("/", 1)[1], line, why) for f, line, why in rows(rejected, "file", "line", "reason")] == [("part-0.csv", "11,x", "type"), ("part-0.csv", "12", "fields"), ("part-0.csv", '13,"2,5"', "type"), ("part-1.csv", "201,101,q,r", "fields")]


def test_carries_cross_any_number_of_chunks(spark):
    data = [("f", i, "h%d" % i if i in (3, 40, 41) else None) for i in range(60)] + [("g", i, None) for i in range(5)] + [("g", 5, "x"), ("g", 30, None)]
    df = spark.createDataFrame(data, "f string, pos int, v string")
    want = [(f, p, next((v for g, q, v in reversed(data) if g == f and q <= p and v), None)) for f, p, _ in data]
    for size in (1, 7, 1000):
        out = tables.carry_down(df.withColumn("chunk", F.floor(F.col("pos") / size)).repartition(5), ["f"], "chunk", "pos", "v", "now")
        assert rows(out, "f", "pos", "now") == sorted(want, key=str)


def test_one_huge_roster_file_in_many_blocks(spark, tmp_path):
    lines = []
    for i in range(400):
        lines += [f"{'Japan' if i % 2 else 'Cuba'}（x） — プールC（東京ドーム） — 30"] + [f"Player {i} {j},RHP,Club,YES" for j in range(i % 9)]
    (tmp_path / "rosters.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        parsed = tables.parse_roster(spark, str(tmp_path / "rosters.csv"), ROSTER_COUNTRIES, POOL_CITIES, TEAMS)
        assert spark.read.text(str(tmp_path / "rosters.csv")).rdd.getNumPartitions() > 4
        got = rows(parsed, "name", "country")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((f"Player {i} {j}", "JPN" if i % 2 else "CUB") for i in range(400) for j in range(i % 9))


def test_missing_seasons_and_distinct_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.StringType())])
    tables.write_dataset(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], schema), str(tmp_path / "a"))
    got = tables.read_seasons(spark, {2024: str(tmp_path / "a"), 2025: str(tmp_path / "b")}, schema)
    assert rows(got, "id", "season") == [(1, 2024), (1, 2024), (None, 2024)]
    assert rows(tables.distinct_rows(got, "id")) == [(1,), (None,)]
    assert tables.read_seasons(spark, {2025: str(tmp_path / "b")}, schema).columns == ["id", "x", "season"]
    with pytest.raises(ValueError):
        tables.union_seasons({2025: None})


def test_tiles_on_a_fine_grid_stay_within_the_bound(spark):
    pts = [(g, 10.0 * (i * 7 % 23) - 100 + j, 9.0 * (i * 5 % 19) + 40 + j) for g in "ab" for i in range(40) for j in range(3)]
    df = spark.createDataFrame(pts, "g string, x double, y double")
    fine = dict(step=3.5, x_range=(-350, 346.5), y_range=(0, 696.5))
    full, cut = (spatial.spray_density(df, "g", tolerance=t, **fine) for t in (1e-300, 1e-4))
    assert "NestedLoop" not in plan_of(cut)
    a, b = ({(r.g, r.gx, r.gy): r.density for r in d.collect()} for d in (full, cut))
    assert len(a) == len(b) == 2 * 200 * 200
    peak = max(a.values())
    assert max(abs(a[k] - b[k]) for k in a) < 1e-4 * 40 * 3 * peak
    assert all(b[k] <= a[k] + 1e-15 for k in a) and min(b.values()) == 0


def test_density_levels_hold_shares_of_mass(spark):
    df = spark.createDataFrame([("a", float(i), 0.0, float(w)) for i, w in enumerate([8, 4, 2, 1, 1, 0])], "g string, gx double, gy double, density double")
    got = {r.gx: r.level for r in spatial.density_levels(df, "g", 3, 0.1).collect()}
    # shares 0.1, 0.55, 1: densities above which 90 %, 45 % and nothing of the mass lie: 1, 8, 8
    assert got == {0.0: 3, 1.0: 1, 2.0: 1, 3.0: 1, 4.0: 1, 5.0: 0}


@pytest.mark.parametrize("name, sql, job, order", [
    ("long", LONG, lambda p: summaries.presented(arsenal.arsenal_long(p), "pitcher", "season", "pitch_type"), "pitcher, season, pitch_type"),
    ("batting", BATTING, lambda p: summaries.presented(summaries.batting_summary(p)), "country, player_name, mlbam_id"),
    ("pitching", PITCHING, lambda p: summaries.presented(summaries.pitching_summary(p)), "country, player_name, mlbam_id"),
])
def test_published_order(spark, name, sql, job, order):
    con = duckdb.connect()
    for t in ("lineitem", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    keys = order.split(", ")
    want = con.sql(f"{sql} SELECT {order} FROM {name} ORDER BY {order}").fetchall()
    got = [tuple(r) for r in job(pitches(spark, SF)).select(*keys).collect()]
    assert got == want and not any(math.isnan(x) for r in got for x in r if isinstance(x, float))
