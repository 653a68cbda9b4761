from pyspark.sql import types as T

from fungo.plans.schema import POOL_CITIES, ROSTER_COUNTRIES, SOURCE_COUNTRIES, TEAMS
from fungo.sources import tables


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_combine_sources(spark, tmp_path):
    (tmp_path / "japan_statcast.csv").write_text("pitcher,release_speed\n1,90.5\n2,NaN\n")
    (tmp_path / "usa_statcast.csv").write_text("release_speed,pitcher,bat_speed\n95.0,3,70\n")
    (tmp_path / "usa_pitchers_statcast.csv").write_text("pitcher\n9\n")
    (tmp_path / "narnia_statcast.csv").write_text("pitcher,release_speed\n7,1\n8,2\n")
    schema = T.StructType([T.StructField("pitcher", T.LongType()), T.StructField("release_speed", T.DoubleType()), T.StructField("bat_speed", T.DoubleType())])
    combined, skipped = tables.combine_sources(spark, str(tmp_path), "_statcast.csv", "_pitchers_statcast", SOURCE_COUNTRIES, schema)
    assert rows(combined, "pitcher", "release_speed", "bat_speed", "country") == [(1, 90.5, None, "JPN"), (2, None, None, "JPN"), (3, 95.0, 70.0, "USA")]
    assert rows(skipped, "prefix", "n_rows") == [("narnia", 2)]


def test_union_seasons_keeps_an_existing_column(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, 1999)], "x int, season int")
    assert rows(tables.union_seasons({2024: a, 2025: b}), "x", "season") == [(1, 2024), (2, 1999)]


def test_season_window(spark):
    df = spark.createDataFrame([("2024-03-28",), ("2024-10-01",), ("2025-01-01",), (None,)], "day string")
    assert rows(tables.season_window(df, "day", [(2024, "2024-03-28", "2024-09-30")]), "day", "season") == [("2024-03-28", 2024)]


def test_roster_sections(spark, tmp_path):
    text = """WBC 2026 Rosters
出典: somewhere
Japan（日本） — プールC（東京ドーム） — 30
選手名,ポジション,チーム,40
大谷 / Shohei Ohtani,RHP,ドジャース,YES
Plain,C,FA（前ヤンキース）,NO

Atlantis（x） — プールA（マイアミ） — 3
Nobody,C,Club,YES
Cuba（x） — プールA（Havana） — 3
short,line
Name（y）,LHP,引退復帰
"""
    (tmp_path / "rosters.csv").write_text(text)
    got = tables.parse_roster(spark, str(tmp_path / "rosters.csv"), ROSTER_COUNTRIES, POOL_CITIES, TEAMS)
    assert rows(got, "name", "country", "pool", "position", "team", "on_40_man", "role") == [
        ("Name", "CUB", "A (Havana)", "LHP", "Returning from retirement", False, "pitcher"),
        ("Plain", "JPN", "C (Tokyo)", "C", "FA (former Yankees)", False, "batter"),
        ("Shohei Ohtani", "JPN", "C (Tokyo)", "RHP", "Dodgers", True, "pitcher"),
    ]


def test_write_read_and_refresh(spark, tmp_path):
    df = spark.createDataFrame([(1, 2024, float("nan")), (2, 2025, 1.5)], "id long, season int, v double")
    tables.write_all({"facts": df}, str(tmp_path), "_v1")
    assert rows(tables.read_table(spark, str(tmp_path / "facts_v1"), df.schema), "id", "v") == [(1, None), (2, 1.5)]
    path = str(tmp_path / "pq")
    tables.write_dataset(df, path, "parquet", "season")
    tables.write_dataset(spark.createDataFrame([(9, 2025, 2.0)], df.schema), path, "parquet", "season")
    assert rows(tables.read_table(spark, path, fmt="parquet"), "id", "season") == [(1, 2024), (9, 2025)]


def test_drop_index_column(spark):
    assert tables.drop_index_column(spark.createDataFrame([(0, 1)], "`Unnamed: 0` int, x int")).columns == ["x"]
