"""Rank selection against numpy, and statistics from profiles against those from rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fungo.operators import profile, quantiles, stats


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def measured(spark):
    r = random.Random(1)
    rows = [("hot", r.choice((1.5, 2.5, r.gauss(0, 1e6)))) for _ in range(3000)]
    rows += [("one", 7.0)] * 5 + [("pair", 1.0), ("pair", 2.0), ("null", None), (None, 3.0), ("nan", math.nan), ("nan", 4.0)]
    rows += [("huge", x) for x in (-1.7e308, 1.7e308, 5e-324, 0.0, -0.0, 1e-300, math.inf, -math.inf, 1.0, 1.0)] + [("inf", math.inf)] * 3 + [("inf", -math.inf)]
    rows += [("steps", 2.0**-i) for i in range(60)]
    return spark.createDataFrame(rows, "k string, v double").repartition(5), rows


def wanted(rows, fractions):
    groups = {}
    for k, v in rows:
        if k is not None and v is not None and not math.isnan(v):
            groups.setdefault(k, []).append(v)
    out = {}
    for k, vs in groups.items():
        vs.sort()
        out[k] = []
        for f in fractions:
            h = (len(vs) - 1) * f
            a, b = vs[math.floor(h)], vs[math.ceil(h)]
            out[k].append(a if a == b else (1 - (h - math.floor(h))) * a + (h - math.floor(h)) * b)
    return out


@pytest.mark.parametrize("bins", [2, 512])
def test_quantiles_are_exact(measured, bins):
    df, rows = measured
    if bins == 2:
        rows = [x for x in rows if x[0] not in ("hot", "steps")]
        df = df.filter("k is null or k not in ('hot', 'steps')")
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, ["k"], "v", at, bins=bins).collect()}
    want = wanted(rows, at)
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[k], q)), (k, got[k], q)


def test_equal_to_percentile_and_weights(spark, measured):
    df = measured[0].filter("k in ('hot', 'one', 'pair')")
    got = {r.k: r.q for r in quantiles.exact_quantiles(df.groupBy("k", "v").count(), ["k"], "v", [0.25, 0.5], "count").collect()}
    want = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()}
    assert all(np.allclose(got[k], want[k], rtol=1e-12) for k in want) and got.keys() == want.keys()


def test_default_paths_hold_no_percentile(measured):
    df = measured[0].filter("k in ('hot', 'one')")
    for out in (stats.median_by(df, "k", "v"), stats.describe(df, ["v"]), stats.box_stats(df, "k", "v")):
        assert "percentile" not in plan_of(out)


def test_no_values(spark):
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert quantiles.exact_quantiles(empty, ["k"], "v", [0.5]).count() == 0
    r = stats.describe(empty, ["v"]).first()
    assert (r.column_name, r.n, r.p50) == ("v", 0, None)


def test_profiles_answer_as_rows_do(spark):
    r = random.Random(2)
    rows = [(r.randrange(3), r.choice("abc"), r.choice((None, r.randrange(40) / 4)), r.randrange(9) * 1.0) for _ in range(500)]
    df = spark.createDataFrame(rows, "season int, k string, v double, w double")
    parts = [profile.value_profile(df.filter(F.col("season") == s), ["v", "w"], "k") for s in range(3)]
    whole = profile.merge_profiles(*parts)
    key = lambda x: tuple(x)
    assert sorted(map(key, whole.collect())) == sorted(map(key, profile.value_profile(df, ["v", "w"], "k").collect()))
    same = lambda a, b: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in a.collect()) == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in b.collect())
    assert same(profile.profile_median(whole, "v"), stats.median_by(df, "k", "v"))
    assert same(profile.profile_describe(whole, ["v", "w"]), stats.describe(df, ["v", "w"]))
    assert same(profile.profile_histogram(whole, "v", 7), stats.histogram(df, "v", 7))
    assert same(profile.profile_box_stats(whole, "v"), stats.box_stats(df, "k", "v"))
