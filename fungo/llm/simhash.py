"""SimHash near-duplicates: block keys gather buckets, pivot tables search them, exact distance verifies."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_share, map_text
from .graph import connected_components

#: Fingerprints and pivots have this many bits.
BITS = 64


def fingerprints_of(texts: list, shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of each text (UTF-8 bytes or None), as unsigned words.

    A-Z are lower-cased; words are runs without ASCII white space; shingles of `shingle`
    words, repeats included, joined by a space (all words, if fewer; none: fingerprint 0)
    are hashed by XXH64 with seed 42; a bit is set where over half the hashes set it.
    """
    from xxhash import xxh64_intdigest as h

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for d, t in enumerate(texts):
        ws = t.lower().split() if t else []
        if not ws:
            continue
        flat = b" ".join(ws)
        if len(ws) <= shingle:
            hashes.append(h(flat, 42))
            counts[d] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = len(ws) - shingle + 1
        hashes += [h(flat[a:b], 42) for a, b in zip(starts[:k].tolist(), ends[shingle - 1 :].tolist())]
        counts[d] = k
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">u8")[:, 0]
    return out


def pivots(n: int = 16) -> list[int]:
    """`n` reference fingerprints, at distance 32 from each other: rows of the 64-bit Walsh matrix, by parity of i & j."""
    return [sum((bin(i & j).count("1") & 1) << j for j in range(BITS)) for i in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(n_docs: int, distance: int) -> list[int]:
    """Masks of which every pair within `distance` bits agrees on one at least (pigeonhole).

    The 64 bits fall into `distance` + r blocks; differing bits spoil `distance` blocks at
    most, so some r blocks agree.  r grows with the number of fingerprints, so that a key
    holds at least two bits more than there are fingerprints to tell apart: buckets stay
    small at any size.  All choices find the same pairs.
    """
    for r in (2, 3, 4):
        n = distance + r
        edges = [round(i * BITS / n) for i in range(n + 1)]
        blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(blocks, r)]
        if min(bin(m).count("1") for m in masks) >= n_docs.bit_length() + 2:
            break
    return masks


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every reference fingerprint."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int16)


def search_groups(group: np.ndarray, fp: np.ndarray, refs: np.ndarray, distance: int, step: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v), as a spanning forest, among fingerprints of the same group.

    Rows are sorted by group and first pivot distance, so a fingerprint meets only those of
    its group in a window of `distance` behind it; a pair whose distances to any other
    pivot differ by more than `distance` cannot link (triangle inequality) and is
    discarded, coordinate by coordinate; survivors are verified.  Pairs are made about
    `step` at a time.
    """
    table = pivot_table(fp, refs)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    place = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))) * (2 * BITS) + table[:, 0]
    last = np.searchsorted(place, place + distance, "right")  # the window's end
    n_pairs = last - np.arange(len(fp)) - 1
    total = np.concatenate(([0], np.cumsum(n_pairs)))
    us, vs, at = [], [], 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(total, total[at] + step, "right")) - 1)
        i = np.repeat(np.arange(at, to), n_pairs[at:to])
        j = np.arange(len(i)) - np.repeat(total[at:to] - total[at], n_pairs[at:to]) + i + 1
        for c in range(1, table.shape[1]):
            near = np.abs(table[i, c] - table[j, c]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        us.append(i[near])
        vs.append(j[near])
        at = to
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    label = np.arange(len(fp))
    while len(i):
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == old).all():
            break
    far = np.flatnonzero(label != np.arange(len(fp)))
    signed = fp.view(np.int64)
    return signed[far], signed[label[far]]


def _windows(fp: Column, refs: list[int], distance: int, depth: Column) -> Column:
    """Numbers of the pivot windows that a fingerprint lies in, on its first `depth` coordinates.

    Windows are 2 * (distance + 1) wide and begin at every (distance + 1), so a value lies in
    two, and two values no more than `distance` apart share one: links share a window of all
    coordinates.
    """
    cells = [F.floor(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))) / (distance + 1)) for p in refs]
    choices = F.sequence(F.lit(0), F.pow(F.lit(2), depth).cast("int") - 1)
    return F.transform(choices, lambda x: F.xxhash64(*(F.when(F.lit(c) < depth, cell - F.shiftright(x, c).bitwiseAND(1)) for c, cell in enumerate(cells))))


def find_links(nodes: DataFrame, n_nodes: int, distance: int = 4, chunk: int = 512, n_pivots: int = 16) -> DataFrame:
    """Edges (u, v) that connect exactly what links within `distance` bits connect; `nodes` has distinct `fp` (long).

    Each fingerprint enters one bucket per mask of block_masks, as a pair of words; buckets
    of one are left out by their exact count.  Buckets up to `chunk` are searched as they
    are (search_groups).  In a larger one, all that lie within `distance` of its hub (the
    fingerprint of most rows, column `n` where `nodes` has it) are linked to the hub and so
    need not meet each other; it is parted into pivot windows of as many coordinates as its
    size calls for, and windows that hold nothing but the hub's neighbours are done.  What is
    left meets in pieces: each piece of those far from the hub meets each piece of its
    window, so no task gathers more than about 2 * `chunk` of a window, and a hundred
    thousand near copies of one text cost one comparison each, not all their pairs.
    """
    refs = pivots(n_pivots)
    masks = block_masks(n_nodes, distance)
    weight = F.col("n") if "n" in nodes.columns else F.lit(1)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)))
    spread = nodes.select("fp", weight.cast("long").alias("w"), F.explode(keys).alias("g"))
    full = cut_lineage(spread.groupBy("g").agg(F.count("*").alias("size"), F.max(F.struct("w", "fp"))["fp"].alias("hub")).filter("size > 1"))
    met = cut_lineage(join_by_share(spread.drop("w"), full.withColumn("rows", F.col("size")), "g", "rows", n_nodes * len(masks)))
    small, big = met.filter(F.col("size") <= chunk).select("g", "fp"), met.filter(F.col("size") > chunk)
    parts, hubs = [small], []
    if not big.isEmpty():
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= distance
        depth = F.least(F.ceil(F.log2(F.col("size") / chunk)) + 1, F.lit(6)).cast("int")
        parted = big.select("g", "fp", near.alias("near"), F.explode(_windows(F.col("fp"), refs[:6], distance, depth)).alias("w"))
        parted = cut_lineage(parted.select(F.xxhash64("g", "w").alias("g"), "fp", "near"))
        sizes = cut_lineage(parted.groupBy("g").agg(F.count("*").alias("size"), F.count_if(~F.col("near")).alias("far")).filter("size > 1 and far > 0"))
        held = join_by_share(parted, sizes.withColumn("rows", F.col("size")), "g", "rows", parted.count())
        whole = held.filter(F.col("size") <= 2 * chunk).select("g", "fp")
        n_all, n_far = F.ceil(F.col("size") / chunk).cast("int"), F.ceil(F.col("far") / chunk).cast("int")
        mine = F.xxhash64("fp")
        as_one = F.transform(F.sequence(F.lit(0), n_far - 1), lambda x: F.struct(x.alias("x"), F.pmod(mine, n_all).cast("int").alias("y")))
        as_far = F.transform(F.sequence(F.lit(0), n_all - 1), lambda y: F.struct(F.pmod(mine, n_far).cast("int").alias("x"), y.alias("y")))
        meetings = F.when(F.col("near"), as_one).otherwise(F.array_union(as_one, as_far))
        pieces = held.filter(F.col("size") > 2 * chunk).select("g", "fp", F.explode(meetings).alias("_p")).select(F.xxhash64("g", "_p.x", "_p.y").alias("g"), "fp")
        parts += [whole, pieces]
        hubs = [big.filter(near & (F.col("fp") != F.col("hub"))).select(F.col("fp").alias("u"), F.col("hub").alias("v"))]
    gathered = parts[0]
    for p in parts[1:]:
        gathered = gathered.unionAll(p)
    dealt = gathered.repartition("g").sortWithinPartitions("g")

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the group that the last batch ended in, and what stands before it
        ref = np.array(refs, np.uint64)

        def found(g, fp):
            u, v = search_groups(g, fp.view(np.uint64), ref, distance)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            g, fp = (np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate(held))
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0  # words of a group stand together, in order
            held = g[cut:], fp[cut:]
            if cut:
                yield found(g[:cut], fp[:cut])
        if len(held[0]):
            yield found(*held)

    edges = dealt.mapInArrow(run, "u long, v long")
    for h in hubs:
        edges = edges.unionAll(h)
    return edges


def hex_of(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _components(docs: DataFrame, key: str, text: str, distance: int, shingle: int) -> DataFrame:
    """Per row of `docs`: k, h (hash of the text), fp, root (a component's smallest fingerprint) and component_id."""
    from_text = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))

    def make():
        def f(ids, texts):
            return [pa.array(ids, pa.int64()), pa.array(fingerprints_of(texts, shingle).view(np.int64))]

        return f

    marked = cut_lineage(map_text(from_text, "k", "t", "k long, fp long", make, 1_000_000, ("h",)).select("k", F.col("_c0").alias("h"), "fp"))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("k").alias("least"), F.count("*").alias("n")))
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    edges = find_links(nodes.select("fp", "n"), n_nodes, distance)
    roots = cut_lineage(connected_components(edges))
    joined = cut_lineage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    named = cut_lineage(join_by_share(joined.select("fp", "n", "root"), least, "root", "rows", n_nodes))
    return join_by_share(marked, named, "fp", "n", n_rows)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """(key, fp long, component_id): one row per input row with the smallest key it reaches over links of `distance` bits or fewer.

    Texts are read once, whole, where they are, about a megabyte at a time; what follows
    works on distinct fingerprints, so a group of copies is one node whatever its size, and
    links of different fingerprints are kept as a spanning forest.  Components come from
    star steps on DataFrames; fingerprints and components that many rows share are joined by
    broadcast, the others by shuffle (join_by_share).

    Null text and text without words have fingerprint 0, which links like any other; an
    empty table gives no rows; repeated rows are all returned; a null key never names a
    component (it is null where only null keys are reached); extra columns are ignored.
    """
    return _components(docs, key, text, distance, shingle).select(F.col("k").alias(key), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one whose key names the component.

    Rows are told apart by key and text, so a key may stand beside several texts: each
    group keeps one row, whatever its keys do in other groups.  Of several texts of a group
    under its least key, the one with the least hash stays; of equal rows one.  Null keys
    are no smaller than others: such a row stays only where its group has no other key.
    What goes is an anti join on narrow rows, which Spark broadcasts while they are below
    its threshold.  An empty table stays empty; texts are whole, of any length; columns of any
    name stay as they are.
    """
    found = cut_lineage(_components(docs, key, text, distance, shingle))
    own = found.filter(F.col("k").eqNullSafe(F.col("component_id")))
    chosen = cut_lineage(own.groupBy("root").agg(F.min("h").alias("h"), F.first("component_id").alias("k")))
    stays = chosen.select(F.col("root").alias("_root"), F.col("h").alias("_h"), F.col("k").alias("_k"))
    # the chosen rows, by key and text; all others go
    others = found.join(stays, (F.col("h") == F.col("_h")) & F.col("k").eqNullSafe(F.col("_k")) & (F.col("root") == F.col("_root")), "left_anti")
    gone = others.select(F.col("h").alias("_h"), F.col("k").alias("_k")).distinct()
    # by position, so that no column of `docs` meets these names
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    named = docs.toDF(*names.values()).withColumns({"_row_k": F.col(names[key]).cast("long"), "_row_h": F.xxhash64(F.col(names[text]))})
    same = [F.col("_row_h") == F.col("_h"), F.col("_row_k").eqNullSafe(F.col("_k"))]
    left = named.join(gone, same, "left_anti")
    twice = cut_lineage(found.join(stays, (F.col("h") == F.col("_h")) & F.col("k").eqNullSafe(F.col("_k")), "left_semi").groupBy("h", "k").count().filter("count > 1").select(F.col("h").alias("_h"), F.col("k").alias("_k")))
    if not twice.isEmpty():
        left = left.join(twice, same, "left_anti").unionAll(left.join(twice, same, "left_semi").dropDuplicates(["_row_k", "_row_h"]))
    return left.select(*(F.col(d).alias(c) for c, d in names.items()))
