"""Connected components by alternating star steps, on DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_share


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of `edges` (u long, v long).

    Large-star and small-star steps by turns: each node's larger (then smaller) neighbours
    are tied to the smallest one, until every edge points at its root.  Links stay in
    DataFrames; each step is one grouped minimum with map-side partials and one join on the
    node, in which the few nodes that meet most links are joined by broadcast (see
    join_by_share).  Every round's edges lie in the shared folder.  Rounds grow with the
    logarithm of the longest path; beyond `max_rounds` an error is raised, never a part.
    An empty table gives no rows; self-links and repeated links do no harm.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    pairs = cut_lineage(pairs)
    before, n = None, pairs.count()
    for _ in range(max_rounds):
        pairs = cut_lineage(_small_star(cut_lineage(_large_star(pairs, n)), n))
        n, total = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = n, total
    else:
        raise RuntimeError(f"components not found within {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def _large_star(pairs: DataFrame, n: int) -> DataFrame:
    """pairs have u > v; ties each node's larger neighbours to the least of it and its neighbours."""
    both = pairs.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(pairs.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"), F.count_if(F.col("o") > F.col("n")).alias("rows")).filter("rows > 0")
    out = join_by_share(pairs.select(F.col("v").alias("n"), F.col("u").alias("o")), least, "n", "rows", n)
    return out.select(F.col("o").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(pairs: DataFrame, n: int) -> DataFrame:
    """Ties each node and its smaller neighbours to the least of these."""
    least = pairs.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    tied = join_by_share(pairs.select(F.col("u").alias("n"), F.col("v").alias("o")), least, "n", "rows", n)
    out = tied.select(F.col("o").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.filter("u != v").distinct()
