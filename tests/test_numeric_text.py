import pytest
from pyspark.sql import functions as F

from fungo.functions import numeric, text


def one(spark, column, value, kind="double"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("x, digits, even, up", [(0.5, 0, 0.0, 1.0), (1.5, 0, 2.0, 2.0), (2.5, 0, 2.0, 3.0), (-2.5, 0, -2.0, -3.0), (1.25, 1, 1.2, 1.3), (None, 2, None, None)])
def test_rounding(spark, x, digits, even, up):
    assert one(spark, numeric.round_half_even("x", digits), x) == even
    assert one(spark, numeric.round_half_up("x", digits), x) == up


def test_safe_ratio_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in df.limit(3).select(numeric.safe_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]
    assert [r["a"] for r in numeric.nan_to_null(df).collect()] == [1.0, 1.0, 1.0, None]


def test_row_sum_and_any(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = df.select(numeric.row_sum("a", "b").alias("s"), numeric.any_present("a", "b").alias("p")).collect()
    assert [tuple(r) for r in got] == [(1.0, True), (0.0, False)]


@pytest.mark.parametrize(
    "team, label",
    [("ヤンキース", "Yankees"), ("FA（前ヤンキース）", "FA (former Yankees)"), ("FA(前Foo)", "FA (former Foo)"), ("FA", "Free Agent"), ("引退復帰", "Returning from retirement"), ("引退復帰（前ヤンキース）", "Returning from retirement (former Yankees)"), ("Club", "Club"), (None, None)],
)
def test_translate_team(spark, team, label):
    assert one(spark, text.translate_team(F.col("x"), {"ヤンキース": "Yankees"}), team, "string") == label


@pytest.mark.parametrize("name, english", [("大谷 / Ohtani / S", "Ohtani / S"), ("Name（x）", "Name"), ("Plain", "Plain")])
def test_english_name(spark, name, english):
    assert one(spark, text.english_name(F.col("x")), name, "string") == english


def test_surname_and_search(spark):
    assert one(spark, text.surname(F.col("x")), "Judge, Aaron, Jr", "string") == "Judge"
    assert one(spark, text.surname(F.col("x")), "Ichiro", "string") == "Ichiro"
    assert one(spark, text.matches_name(F.col("x"), "DG.E"), "Judge", "string") is False
