"""Exact quantiles of large groups by rank selection: counted brackets, narrowed until each rank is one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.sources.shared import join_keys, written

#: Brackets fall into this many bins of equal width a round.
BINS = 512


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of `v` within [lo, hi]; the ends never share one, and infinite values have bins of their own.

    Halves are subtracted, as the range may exceed the largest double.
    """
    width = hi / 2 - lo / 2
    inside = F.least(F.floor((v / 2 - lo / 2) / F.when(width > 0, width) * bins), F.lit(bins - 1))
    inside = F.when(v == hi, F.lit(bins - 1)).when(v == lo, F.lit(0)).otherwise(F.coalesce(inside, F.lit(0)))
    return F.when(v < lo, F.lit(-1)).when(v > hi, F.lit(bins)).otherwise(inside).cast("int")


def _live(rows: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    """Keys as _k0, _k1 and so on, value as _v, weight as _w; without null keys, null values and NaN."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    out = rows.select(*named, F.col(value).cast("double").alias("_v"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_w"))
    return out.filter(" and ".join(f"{c} is not null" for c in out.columns[:-1]) + " and not isnan(_v)")


def _spans(live: DataFrame, ks: list[str]) -> DataFrame:
    """Each group's size and its least and largest finite value (0 where there is none: any bracket parts infinities), as a table."""
    finite = F.when(F.abs("_v") != F.lit(float("inf")), F.col("_v"))
    zero = F.lit(0.0)
    return written(live.groupBy(*ks).agg(F.coalesce(F.min(finite), zero).alias("lo"), F.coalesce(F.max(finite), zero).alias("hi"), F.sum("_w").alias("size")))


def _select(left: DataFrame, ks: list[str], spans: DataFrame, wanted: DataFrame, bins: int) -> DataFrame:
    """(ks, rank, value) of the wanted ranks (ks, rank); see rank_values."""
    targets = wanted.join(spans, ks).filter((F.col("rank") >= 0) & (F.col("rank") < F.col("size"))).withColumn("below", F.lit(0).cast("long"))
    done, first = [], True
    while first or not targets.isEmpty():
        if first:
            brackets = spans.select(*ks, F.struct("lo", "hi", F.lit(0).cast("long").alias("below")).alias("in"), "size")
            placed = join_keys(left, brackets, ks, "size")
        else:
            brackets = targets.groupBy(*ks).agg(F.collect_set(F.struct("lo", "hi", "below")).alias("b"), F.sum("size").alias("size"))  # as many as the group has ranks at most
            held = F.get(F.filter("b", lambda x: F.col("_v").between(x["lo"], x["hi"])), F.lit(0))
            placed = join_keys(left, brackets, ks, "size").withColumn("in", held).filter("in is not null").drop("b")
            left = written(placed.groupBy(*ks, "in", "_v").agg(F.sum("_w").alias("_w")))
            placed, left = left, left.drop("in")
        placed = placed.withColumn("bin", _bin(F.col("_v"), F.col("in.lo"), F.col("in.hi"), bins))
        counted = placed.groupBy(*ks, F.col("in.below").alias("below"), "bin").agg(F.sum("_w").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*ks, "below").orderBy("bin"))  # over the bins of one bracket
        parts = counted.withColumn("end", F.col("below") + upto).withColumn("start", F.col("end") - F.col("n"))
        here = targets.drop("lo", "hi").join(parts, [*ks, "below"]).filter((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
        narrower = written(here.select(*ks, "rank", "lo", "hi", F.col("start").alias("below"), F.col("n").alias("size")))
        done.append(narrower.filter("lo = hi").select(*ks, "rank", F.col("lo").alias("value")))
        targets, first = narrower.filter("lo < hi"), False
    found = done[0]
    for d in done[1:]:
        found = found.unionAll(d)
    return found


def rank_values(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame, weight: str | None = None, bins: int = BINS) -> DataFrame:
    """(keys, rank, value): the values at given ranks (keys, rank long from 0) of each group in ascending order.

    A group's wanted ranks each lie in a bracket of values, at first the whole range.  A round
    counts the rows of every bracket by bin (grouped sums with map-side partials, so a hot
    group is spread over all tasks), keeps the bin that holds the rank, with its least and
    largest value as the next bracket, and leaves out all rows outside brackets.  A bracket of
    one value is done.  Tasks hold bins, never a group's values.  Null keys, null values and
    NaN do not count; `weight` says how often a row counts; ranks beyond a group are absent.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    live = _live(rows, keys, value, weight)
    wanted = ranks.select(*(F.col(k).alias(n) for k, n in zip(keys, ks)), "rank").distinct()
    return _select(live, ks, _spans(live, ks), wanted, bins).select(*(F.col(n).alias(k) for k, n in zip(keys, ks)), "rank", "value")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, fractions: list[float], weight: str | None = None, bins: int = BINS) -> DataFrame:
    """(keys, q array<double>): quantiles of each group, between two values by linear interpolation, as `percentile` gives them.

    See rank_values.  Groups without a value are absent.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    live = _live(rows, keys, value, weight)
    spans = _spans(live, ks)
    place = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(f)) * (F.col("size") - 1)).alias("h")) for i, f in enumerate(fractions))))
    places = spans.select(*ks, place.alias("p")).select(*ks, F.col("p.i").alias("i"), F.col("p.h").alias("h"))
    low, high = F.floor("h"), F.ceil("h")
    values = _select(live, ks, spans, places.select(*ks, F.explode(F.array(low, high)).alias("rank")).distinct(), bins)
    # each place meets its one or two ranks; between two, each counts by its nearness, as `percentile` does it
    met = places.withColumn("rank", F.explode(F.array_distinct(F.array(low, high)))).join(values, [*ks, "rank"])
    part = F.col("h") - low
    both = met.groupBy(*ks, "i", "h").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b"))
    lists = both.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("i", between.alias("q")))).alias("q"))
    return lists.select(*(F.col(n).alias(k) for k, n in zip(keys, ks)), F.transform("q", lambda x: x["q"]).alias("q"))
