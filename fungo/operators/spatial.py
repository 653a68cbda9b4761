"""Positions on the field and in the strike zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fungo.operators.clean import with_absent
from fungo.functions.numeric import count_where, safe_ratio
from fungo.operators.stats import bounds

#: Diagram pixel of home plate and feet per pixel, of the public spray-chart convention; parameters below.
HOME_X, HOME_Y, FEET = 125.42, 198.27, 2.5
#: Half the width of home plate in feet (17 inches).
HALF_PLATE = 17 / 24


def spray_coordinates(df: DataFrame, x0: float = HOME_X, y0: float = HOME_Y, scale: float = FEET) -> DataFrame:
    """P10: feet from home plate (x to the right, y to centre field) from diagram pixels."""
    return df.withColumns({"x": F.lit(scale) * (F.col("hc_x") - F.lit(x0)), "y": F.lit(scale) * (F.lit(y0) - F.col("hc_y"))})


def with_in_zone(df: DataFrame) -> DataFrame:
    """Whether the pitch crosses the plate between the batter's zone limits; null if a measure is missing."""
    return df.withColumn("in_zone", (F.abs(F.col("plate_x")) <= F.lit(HALF_PLATE)) & (F.col("plate_z") >= F.col("sz_bot")) & (F.col("plate_z") <= F.col("sz_top")))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 50) -> DataFrame:
    """Counts in hexagons: two rectangular lattices, one shifted by half a cell, the nearer centre wins (the unshifted one in a tie); empty cells are absent."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ny = max(1, int(gridsize / 3**0.5))
    keyed = rows.crossJoin(F.broadcast(bounds(rows, x, y)))

    def scaled(c: str, i: int, n: int):
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        return F.coalesce((F.col(c) - lo) / F.when(hi > lo, (hi - lo) / n), F.lit(0.0))

    keyed = keyed.select(scaled(x, 0, gridsize).alias("u"), scaled(y, 1, ny).alias("v"))
    i1, j1, i2, j2 = F.rint("u"), F.rint("v"), F.floor("u").cast("double"), F.floor("v").cast("double")
    d1 = (F.col("u") - i1) * (F.col("u") - i1) + F.lit(3.0) * (F.col("v") - j1) * (F.col("v") - j1)
    du, dv = F.col("u") - i2 - F.lit(0.5), F.col("v") - j2 - F.lit(0.5)
    near = d1 <= du * du + F.lit(3.0) * dv * dv
    cells = keyed.select((~near).cast("int").alias("lattice"), F.when(near, i1).otherwise(i2).cast("int").alias("i"), F.when(near, j1).otherwise(j2).cast("int").alias("j"))
    return cells.groupBy("lattice", "i", "j").agg(F.count("*").alias("n"))


def spray_density(df: DataFrame, group: str, cell: float = 10.0, step: float = 50.0, x_range: tuple[float, float] = (-350, 350), y_range: tuple[float, float] = (0, 400), bw_adjust: float = 0.7, tolerance: float = 1e-9) -> DataFrame:
    """Gaussian density of batted balls per group on a grid of `step` feet.

    Bandwidth is Scott's factor n^(-1/6) times `bw_adjust` on the group's own covariance.
    Points are first counted in cells of `cell` feet: their number is bounded by the field,
    not by the rows.  Each cell then gives to the grid points within its reach, where the
    kernel is at least `tolerance` of its peak, and the shares are one grouped sum; so a
    fine grid costs what lies near, not cells times points.  A point's density falls short
    of the full sum by less than `tolerance` / (2 pi sqrt(det)), det being the bandwidth
    matrix's determinant.  Points that nothing reaches have density 0.
    """
    points = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(group).isNotNull())
    stats = points.groupBy(group).agg(F.count("*").alias("n"), F.covar_samp("x", "x").alias("sxx"), F.covar_samp("x", "y").alias("sxy"), F.covar_samp("y", "y").alias("syy"))
    f2 = F.pow(F.col("n").cast("double"), F.lit(-1 / 3)) * F.lit(bw_adjust**2)
    stats = stats.select(group, "n", (F.col("sxx") * f2).alias("a"), (F.col("sxy") * f2).alias("b"), (F.col("syy") * f2).alias("c")).withColumn("det", F.col("a") * F.col("c") - F.col("b") * F.col("b")).filter("det > 0")
    cells = points.groupBy(group, F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count("*").alias("w"))
    sides = [int((hi - lo) / step) for lo, hi in (x_range, y_range)]
    placed = cells.join(stats, group).withColumns({"px": (F.col("cx") + 0.5) * cell, "py": (F.col("cy") + 0.5) * cell})
    reach = -2 * F.log(F.lit(float(tolerance)))

    def near(p: str, spread: str, lo: float, last: int):
        r = F.sqrt(reach * F.col(spread))
        first, to = F.ceil((F.col(p) - r - lo) / step), F.floor((F.col(p) + r - lo) / step)
        first, to = F.greatest(first, F.lit(0)), F.least(to, F.lit(last))
        return F.explode(F.when(first <= to, F.sequence(first, to)).otherwise(F.array().cast("array<bigint>")))

    met = placed.withColumn("i", near("px", "a", x_range[0], sides[0])).withColumn("j", near("py", "c", y_range[0], sides[1]))
    dx, dy = F.col("i") * step + float(x_range[0]) - F.col("px"), F.col("j") * step + float(y_range[0]) - F.col("py")
    q = (F.col("c") * dx * dx - 2 * F.col("b") * dx * dy + F.col("a") * dy * dy) / F.col("det")
    sums = met.withColumn("q", q).filter(F.col("q") <= reach).groupBy(group, "i", "j").agg(F.sum(F.col("w") * F.exp(-F.col("q") / 2)).alias("k"))
    i, j = (F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n).cast("bigint"))) for n in sides)
    grid = stats.withColumn("i", i).withColumn("j", j)
    peak = F.col("n") * 2 * F.lit(3.141592653589793) * F.sqrt("det")
    out = grid.join(sums, [group, "i", "j"], "left")
    return out.select(group, (F.col("i") * step + float(x_range[0])).alias("gx"), (F.col("j") * step + float(y_range[0])).alias("gy"), (F.coalesce("k", F.lit(0.0)) / peak).alias("density"))


def density_levels(density: DataFrame, group: str, levels: int = 8, threshold: float = 0.1) -> DataFrame:
    """The contour band of every grid point: (group, gx, gy, density, level).

    Contours are shares of mass, as density maps draw them: `levels` shares from `threshold`
    to 1, evenly spaced.  The contour of a share p lies at the density above which the points
    hold 1 - p of the group's mass; `level` is how many contours a point's density reaches (0:
    outside the lowest).  The running mass is a window over a group's grid points, whose
    number the grid fixes.  Shares are rounded to 9 decimals, so summation order tips none.
    """
    shares = [threshold + (1 - threshold) * i / (levels - 1) for i in range(levels)] if levels > 1 else [threshold]
    down = Window.partitionBy(group).orderBy(F.desc("density"), "gx", "gy").rowsBetween(Window.unboundedPreceding, 0)
    held = density.withColumn("_held", F.round(F.sum("density").over(down) / F.sum("density").over(Window.partitionBy(group)), 9))
    whole = Window.partitionBy(group)
    at = [F.max(F.when(F.col("_held") >= round(1 - p, 9), F.col("density"))).over(whole) for p in shares]
    reached = [F.when(F.col("density") >= t, 1).otherwise(0) for t in at]
    level = reached[0]
    for r in reached[1:]:
        level = level + r
    return held.withColumn("level", level.cast("int")).drop("_held")


def pitch_location(df: DataFrame, group: str, value: str, cell: float = 0.5) -> DataFrame:
    """For the busiest pitcher of a group: pitches per type and location cell, and the share inside the zone (null where the table has no zone)."""
    df = with_absent(df, "plate_x", "plate_z", "sz_top", "sz_bot")
    rows = df.filter(F.col(group) == value)
    top = rows.filter("pitcher is not null").groupBy("pitcher").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "pitcher").limit(1).select("pitcher")
    mine = with_in_zone(rows.join(F.broadcast(top), "pitcher", "left_semi").filter("pitch_type is not null and plate_x is not null and plate_z is not null"))
    return mine.groupBy("pitch_type", F.floor(F.col("plate_x") / cell).cast("int").alias("cell_x"), F.floor(F.col("plate_z") / cell).cast("int").alias("cell_z")).agg(F.count("*").alias("n"), safe_ratio(count_where(F.col("in_zone")), F.count("in_zone")).alias("in_zone_share"))
