"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on whole shingle sets, grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_share, map_text
from .graph import connected_components

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list, shingle: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of each text's shingles, sorted by text and hash: (text number, hash).

    A-Z are lower-cased; words are runs without ASCII white space; with fewer than
    `shingle` words the whole sequence is the one shingle; without words there is none.
    """
    from xxhash import xxh3_64_intdigest as h

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for d, t in enumerate(texts):
        ws = t.lower().split() if t else []
        if not ws:
            continue
        flat = b" ".join(ws)
        if len(ws) <= shingle:
            hashes.append(h(flat))
            counts[d] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = len(ws) - shingle + 1
        hashes += [h(flat[a:b]) for a, b in zip(starts[:k].tolist(), ends[shingle - 1 :].tolist())]
        counts[d] = k
    of, h64 = np.repeat(np.arange(len(texts)), counts), np.array(hashes, np.uint64)
    order = np.lexsort((h64, of))
    of, h64 = of[order], h64[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (h64[1:] != h64[:-1])
    return of[new], h64[new]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_minhash(of: np.ndarray, hashes: np.ndarray, n_sets: int, slots: int = 128) -> np.ndarray:
    """SuperMinHash signatures, one row of `slots` words a set.

    Every element draws one random permutation of the slots (Fisher-Yates, from its own
    hash); the j-th slot of it takes the value j plus a fraction if that is less than what
    stands there.  All elements take their j-th step together.  A set whose slots all hold
    ranks up to j is done, since later ranks are larger: long sets stop after a few steps.
    A set without elements keeps the largest word everywhere.
    """
    sig = np.full((n_sets, slots), np.uint64(2**64 - 1))
    perm = np.tile(np.arange(slots, dtype=np.uint16), (len(hashes), 1))
    live = np.arange(len(hashes))
    low = np.uint64(0xFFFFFFFF)
    for j in range(slots):
        x = _mix(hashes[live] + np.array([j + 1], np.uint64) * _GOLDEN)
        k = j + (((x & low) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        slot = perm[live, k]
        perm[live, k] = perm[live, j]
        perm[live, j] = slot
        np.minimum.at(sig.reshape(-1), of[live] * slots + slot, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        done = (sig.max(1) >> np.uint64(32)) <= np.uint64(j)
        live = live[~done[of[live]]]
        if not len(live):
            break
    return sig


#: Slots of a signature and those of a band.  A pair at similarity 0.8 misses all 32 bands with
#: probability (1 - 0.8^4)^32, 5 in 100 million; pairs above it more rarely.
SLOTS, BAND = 128, 4
#: Standard deviations below the expected agreement at which a pair of signatures is discarded.
SIGMAS = 5.5
_NIBBLES = np.uint64(0x1111111111111111)


def bands_of(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each run of `band` slots; equal runs of different places have different keys."""
    parts = sig.reshape(len(sig), -1, band)
    keys = np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _GOLDEN
    for i in range(band):
        keys = _mix(keys ^ parts[:, :, i])
    return keys


def sketch_of(sig: np.ndarray) -> np.ndarray:
    """Four bits of every slot, sixteen slots a word."""
    nibbles = (_mix(sig) & np.uint64(15)).reshape(len(sig), -1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def most_differing(percent: int, slots: int = SLOTS, sigmas: float = SIGMAS) -> int:
    """Differing slots of two sketches beyond which a pair is no link at `percent`: `sigmas` deviations above their mean."""
    p = 1 - (percent / 100 + (1 - percent / 100) / 16)
    return int(slots * p + sigmas * (slots * p * (1 - p)) ** 0.5)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of slots in which rows of two sketches differ."""
    d = x ^ y
    d |= (d >> np.uint64(1)) | (d >> np.uint64(2)) | (d >> np.uint64(3))
    return np.bitwise_count(d & _NIBBLES).sum(-1, dtype=np.int64)


def _differing(x: Column, y: Column, words: int) -> Column:
    """The same of two array columns."""

    def of(i: int) -> Column:
        d = x[i].bitwiseXOR(y[i])
        for shift in (1, 2, 3):
            d = d.bitwiseOR(F.shiftrightunsigned(x[i].bitwiseXOR(y[i]), shift))
        return F.bit_count(d.bitwiseAND(F.lit(int(_NIBBLES))))

    return sum((of(i) for i in range(words)), F.lit(0))


def sign_documents(docs: DataFrame, key: str, text: str, shingle: int, slots: int = SLOTS) -> DataFrame:
    """(row, k, text, d1, d2, n_shingles, bands, sketch): every text with its set's digest and signature, written once, so that `row` names it from then on."""
    from_text = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def make():
        def f(ids, texts):
            import xxhash

            of, hashes = shingle_hashes(texts, shingle)
            counts = np.bincount(of, minlength=len(texts))
            digest = np.array([xxhash.xxh3_128_intdigest(x.tobytes()) for x in np.split(hashes, np.cumsum(counts)[:-1])], object)
            d1, d2 = (np.array([int(x) >> s & (2**64 - 1) for x in digest], np.uint64).view(np.int64) for s in (64, 0))
            sig = super_minhash(of, hashes, len(texts), slots)
            words = [pa.FixedSizeListArray.from_arrays(pa.array(x.view(np.int64).ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (bands_of(sig), sketch_of(sig))]
            return [pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(d1), pa.array(d2), pa.array(counts, pa.int64()), *words]

        return f

    signed = map_text(from_text, "k", "t", "k long, text string, d1 long, d2 long, n_shingles long, bands array<long>, sketch array<long>", make, 1_000_000)
    return cut_lineage(signed.withColumn("row", F.monotonically_increasing_id()), "zstd")


def beside(rows: DataFrame, on: str, table: DataFrame, key: str, small: int = 2_000_000) -> DataFrame:
    """rows JOIN table on rows.`on` = table.`key` (unique row numbers), where few rows of a wide table are wanted.

    The wanted numbers, up to `small` of them as counted (8 bytes each), are broadcast and the
    table's other rows are left where they are; so only what is wanted is shuffled.
    """
    wanted = cut_lineage(rows.select(F.col(on).alias(key)).distinct())
    few = table.join(F.broadcast(wanted), key, "left_semi") if wanted.count() <= small else table
    return rows.join(few.withColumnRenamed(key, on), on)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, leaves: int = 256, small: int = 200_000) -> DataFrame:
    """Those of distinct pairs (c, x) whose whole sets meet 100 * intersection >= percent * union, as links (u, v).

    Pairs of one center c meet in groups, at most about `leaves` a group, so that its text
    travels once a group and a task holds one such set at a time.  Only centers of more
    pairs, few, need their number looked up.  `texts` has `row` and `text`.
    """
    crowded = cut_lineage(pairs.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > leaves))
    n, total = crowded.agg(F.count("*"), F.sum("n")).first()
    parts = F.pmod(F.xxhash64("x"), F.ceil(F.col("n") / leaves)).cast("int")
    if n <= small:
        stars = pairs.join(F.broadcast(crowded), "c", "left").select("c", F.coalesce(parts, F.lit(0)).alias("p"), "x")
    else:
        stars = join_by_share(pairs, crowded.withColumn("rows", F.col("n")), "c", "rows", total).select("c", parts.alias("p"), "x")
        stars = stars.unionAll(pairs.join(crowded, "c", "left_anti").select("c", F.lit(0).alias("p"), "x"))
    stars = cut_lineage(stars)
    rows = stars.unionAll(stars.select("c", "p", F.col("c").alias("x")).distinct())
    told = beside(rows, "x", texts.select("row", "text"), "row").select("c", "p", "x", (F.col("x") != F.col("c")).alias("leaf"), "text")
    dealt = told.repartition("c", "p").sortWithinPartitions("c", "p", "leaf")

    def run(batches):
        held = np.zeros(0, np.uint64)
        for batch in batches:
            cs, xs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            blobs = batch.column(4).cast(pa.binary())
            us, vs = [], []
            for i, (c, x) in enumerate(zip(cs, xs)):
                own = shingle_hashes([blobs[i].as_py()], shingle)[1]
                if c == x:
                    held = own
                    continue
                both = np.concatenate((held, own))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (len(both) - inter):
                    us.append(c)
                    vs.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return cut_lineage(dealt.mapInArrow(run, "u long, v long"))


def _open_members(met: DataFrame, nodes: DataFrame, roots: DataFrame, chunk: int, chunk_shingles: int) -> DataFrame:
    """(g, node, root, far) of the buckets that hold several components, cut into pieces; far: outside the bucket's largest component.

    Only rows outside their bucket's largest component have to meet the others.  Buckets of
    about `chunk` members and `chunk_shingles` shingles stay as they are; larger ones become
    pieces of that size: each piece of far rows stands together with each piece of all.
    """
    placed = cut_lineage(met.join(roots, "node", "left").join(nodes.select("node", "n_shingles"), "node").select("g", "node", "n_shingles", F.coalesce("root", "node").alias("root")))
    shares = placed.groupBy("g", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = lambda n, s: F.greatest(F.ceil(F.col(n) / chunk), F.ceil(F.col(s) / chunk_shingles)).cast("int")
    sums = shares.groupBy("g").agg(F.sum("n").alias("rows"), F.sum("s").alias("s"), F.max(F.struct("n", "root", "s")).alias("main")).filter(F.col("main.n") < F.col("rows"))
    sums = sums.select("g", "rows", "s", F.col("main.root").alias("main"), (F.col("rows") - F.col("main.n")).alias("n_far"), (F.col("s") - F.col("main.s")).alias("s_far"))
    buckets = cut_lineage(sums.select("g", "rows", "main", parts("rows", "s").alias("n_all"), parts("n_far", "s_far").alias("n_far")))
    total = buckets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    held = join_by_share(placed, buckets, "g", "rows", total).withColumn("far", F.col("root") != F.col("main"))
    mine = F.xxhash64("node")
    as_one = F.transform(F.sequence(F.lit(0), F.col("n_far") - 1), lambda x: F.struct(x.alias("x"), F.pmod(mine, F.col("n_all")).cast("int").alias("y")))
    as_far = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda y: F.struct(F.pmod(mine, F.col("n_far")).cast("int").alias("x"), y.alias("y")))
    met = held.select("g", "node", "root", "far", F.explode(F.when(F.col("far"), F.array_union(as_one, as_far)).otherwise(as_one)).alias("m"))
    return met.select(F.xxhash64("g", "m.x", "m.y").alias("g"), "node", "root", "far")


def by_group(batches, columns):
    """The columns (functions of a batch that give arrays) of each run of equal first column, across batches."""
    kept = None
    for batch in batches:
        cols = [f(batch) for f in columns]
        if kept is not None:
            cols = [np.concatenate(z) for z in zip(kept, cols)]
        g = cols[0]
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(edges[:-2], edges[1:-1]):
            yield [c[a:b] for c in cols]
        kept = [c[edges[-2] :] for c in cols]
    if kept is not None and len(kept[0]):
        yield kept


def _array(i: int):
    return lambda batch: batch.column(i).to_numpy(zero_copy_only=False)


def _matrix(i: int):
    return lambda batch: batch.column(i).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)


def _worth_meeting(members: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """Of _open_members those (g, node, root, far) that have a partner in another component whose sketch does not rule it out, in the first of the bands they share.

    Rows are marked, never paired, so what comes out is no more than what went in.
    """
    rows = beside(members, "node", nodes.select("node", "sketch", "bands"), "node").select("g", "node", "root", "far", "sketch", "bands")
    dealt = rows.repartition("g").sortWithinPartitions("g")

    def run(batches):
        for g, node, root, far, sketch, bands in by_group(batches, [*map(_array, range(4)), _matrix(4), _matrix(5)]):
            wanted, outside = np.zeros(len(g), bool), np.flatnonzero(far)
            shared = _shared_band(bands)
            for a in range(0, len(outside), 32):
                i = outside[a : a + 32]
                x, y = np.nonzero((differing(sketch[i][:, None, :], sketch[None, :, :]) <= limit) & (root[i][:, None] != root[None, :]))
                first = (bands[i[x]] == bands[y]).argmax(1) == shared
                wanted[i[x][first]] = wanted[y[first]] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[wanted]) for c in (g, node, root, far)], names=["g", "node", "root", "far"])

    return dealt.mapInArrow(run, "g long, node long, root long, far boolean")


def _shared_band(bands: np.ndarray) -> int:
    """The place of the band that all rows of a bucket share (of several the first)."""
    return int((bands == bands[0]).all(0).argmax())


def links_across(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) of `percent` between members of a group in different components, by whole sets; `members` has g, node, root, far.

    A task gathers the sets of one group (see _open_members) and counts, for each far row,
    what it shares with all others at once; of its links into one component one is told.
    """
    rows = beside(members, "node", texts.select("row", "text"), "row").select("g", "node", "root", "far", "text")
    dealt = rows.repartition("g").sortWithinPartitions("g")

    def run(batches):
        for _, node, root, far, texts in by_group(batches, [*map(_array, range(4)), lambda b: np.array([x.as_py() for x in b.column(4).cast(pa.binary())], object)]):
            of, hashes = shingle_hashes(texts.tolist(), shingle)
            ids = np.unique(hashes, return_inverse=True)[1]
            sizes = np.bincount(of, minlength=len(node))
            starts = np.cumsum(sizes) - sizes
            mark = np.zeros(len(hashes) + 1, np.int64)
            us, vs = [], []
            for i in np.flatnonzero(far).tolist():
                own = ids[starts[i] : starts[i] + sizes[i]]
                mark[own] = 1
                inter = np.add.reduceat(mark[ids], starts)  # no set is empty
                mark[own] = 0
                linked = np.flatnonzero((100 * inter >= percent * (sizes + sizes[i] - inter)) & (root != root[i]))
                linked = linked[np.unique(root[linked], return_index=True)[1]]
                us += [node[i]] * len(linked)
                vs += node[linked].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return cut_lineage(dealt.mapInArrow(run, "u long, v long"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links: every node of them, and the smallest node of its component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        while (parent[parent] != parent).any():  # every node at its root
            parent = parent[parent]
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        i, j = i[open_], j[open_]


def grouped(links: DataFrame, in_one: int = 1_000_000) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of `links` (u, v).

    Tasks first run union-find over the links that they hold, which leaves a forest of each.
    Forests of up to `in_one` links, as counted, are united by one more union-find, in one
    task of that bounded size; larger ones by star steps (connected_components).
    """

    def run(batches):
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
        u, v = np.concatenate(us), np.concatenate(vs)
        node, root = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "root"])

    trees = cut_lineage(links.mapInArrow(run, "node long, root long"))
    as_links = trees.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if as_links.count() <= in_one:
        return cut_lineage(as_links.coalesce(1).mapInArrow(run, "node long, root long"))
    return cut_lineage(connected_components(as_links))


def set_components(nodes: DataFrame, texts: DataFrame, shingle: int, percent: int, chunk: int = 512, chunk_shingles: int = 2_000_000) -> DataFrame:
    """(node, root) of every node with a link of `percent` or more; `nodes` has node, n, n_shingles, bands, sketch.

    Nodes meet in the buckets of their bands.  First everyone meets the hub of its bucket (a
    node of most rows); pairs that the sketches do not rule out are verified on whole sets,
    and components are formed.  Buckets that lie in one component are done, so copies of one
    text cost one comparison each.  In the others, rows outside the largest component meet
    all others of their bucket where the sets lie together: pairs are compared there and
    never written, and every pair across components that shares a bucket is decided.
    """
    limit = most_differing(percent)
    spread = nodes.select("node", "n", F.explode("bands").alias("g"))
    last = (1 << 57) - 1  # row numbers stay below
    rank = F.shiftleft(F.least(F.floor(F.log2("n")), F.lit(62)).cast("long"), 57) + (F.lit(last) - F.col("node"))
    full = spread.groupBy("g").agg(F.count("*").alias("rows"), F.max(rank).alias("hub")).filter("rows > 1")
    full = cut_lineage(full.select("g", (F.lit(last) - F.col("hub").bitwiseAND(F.lit(last))).alias("hub"), "rows"))
    total = full.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = cut_lineage(join_by_share(spread.select("g", "node"), full, "g", "rows", total))
    pairs = met.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("c"), F.col("node").alias("x")).distinct()
    sketches = nodes.select("node", "sketch")
    told = pairs.join(sketches.toDF("x", "sx"), "x").join(sketches.toDF("c", "sc"), "c")
    stars = cut_lineage(told.filter(_differing(F.col("sx"), F.col("sc"), SLOTS // 16) <= limit).select("c", "x"))
    edges = verified(stars, texts, shingle, percent)
    roots = grouped(edges)
    members = cut_lineage(_open_members(met.select("g", "node"), nodes, roots, chunk, chunk_shingles))
    across = links_across(cut_lineage(_worth_meeting(members, nodes, limit)), texts, shingle, percent)
    return roots if across.isEmpty() else grouped(edges.unionAll(across))


def near_duplicate_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept): one row per input row, grouped by links of Jaccard similarity.

    A document's set is its distinct word shingles (see shingle_hashes).  Documents whose sets
    meet 100 * intersection >= percent * union are linked; a component's id is the smallest
    key in it, and `kept` marks the rows of that key.  Signatures propose pairs, whole sets
    confirm them.  Documents of equal sets are one node, whatever their number.  A link is
    missed only if all bands or the sketches miss it (see BAND, SIGMAS: below one in ten
    million for a pair just at the threshold); shingles are told apart by 64-bit hashes, sets
    by 128-bit digests.

    Null text and text without words have an empty set, linked with nothing: component_id is
    their own key.  Null keys never name a component; where only null keys are reached it is
    null and the rows are kept.  Repeated rows are all returned; an empty table gives no
    rows; texts are whole, of any length; extra columns of any name are ignored.
    """
    signed = sign_documents(docs, key, text, shingle)
    rows = signed.select("k", "d1", "d2", "n_shingles")
    filled = signed.filter("n_shingles > 0")
    nodes = cut_lineage(filled.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("k").alias("least"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    n_nodes, n_rows = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    roots = set_components(nodes.select("node", "n", "n_shingles", "bands", "sketch"), signed.select("row", "text"), shingle, percent)
    joined = cut_lineage(nodes.join(roots, "node", "left").select("d1", "d2", "least", "n", F.coalesce("root", "node").alias("root")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows"))
    named = cut_lineage(join_by_share(joined.select("d1", "d2", "n", "root"), least, "root", "rows", n_nodes))
    grouped = join_by_share(rows.filter("n_shingles > 0"), named.select("d1", "d2", "n", "component_id"), ["d1", "d2"], "n", n_rows).select("k", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("k", "n_shingles", F.col("k").alias("component_id"))
    return grouped.unionAll(alone).select(F.col("k").alias(key), "n_shingles", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
