import random

import numpy as np
import xxhash

from fungo.llm import simhash as S
from fungo.llm.graph import connected_components

from .helpers import ODD, documents


def fingerprint(t):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()]
    grams = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((1 << b) for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(fps, ids, distance):
    label = list(range(len(fps)))
    changed = True
    near = [[j for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= distance] for i in range(len(fps))]
    while changed:
        new = [min(label[j] for j in near[i]) for i in range(len(fps))]
        changed, label = new != label, new
    least = {}
    for c, i in zip(label, ids):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in label]


def corpus():
    r = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    pairs, base = [], " ".join(r.choice(words) for _ in range(200))
    for i in range(60):
        pairs.append((i, " ".join(r.choice(words) for _ in range(r.randint(1, 120)))))
    for i in range(60):
        ws = base.split()
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(len(ws))] = r.choice(words)
        pairs.append((100 + i, " ".join(ws).upper() if i % 5 == 0 else " ".join(ws)))
    return pairs + [(200 + i, base) for i in range(20)] + ODD


def test_against_brute_force(spark):
    pairs = corpus()
    got = S.near_duplicates(documents(spark, pairs)).withColumn("hex", S.hex_of("fp")).collect()
    fps = [fingerprint(t) for _, t in pairs]
    want = list(zip([i for i, _ in pairs], [f"{x:016x}" for x in fps], components(fps, [i for i, _ in pairs], 4)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.hex, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_links_of_close_fingerprints_in_small_chunks(spark):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:10]:
        for _ in range(25):
            x = f
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for size, chunk in ((len(fps), 16), (len(fps), 3), (1 << 23, 2), (1 << 40, 2)):
        edges = S.find_links(nodes, size, chunk=chunk)
        roots = {x.node: x.root for x in connected_components(edges).collect()}
        got = [roots.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps]
        want = components(fps, fps, 4)
        assert len(set(got)) == len(set(want))
        assert len(set(zip(got, want))) == len(set(want))


def test_masks_cover_every_pattern():
    for n in (10, 1 << 23, 1 << 40):
        masks = S.block_masks(n, 4)
        r = random.Random(n)
        for _ in range(2000):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(m & diff == 0 for m in masks)


def test_pivots_are_far_apart_and_bound_distance():
    p = S.pivots(16)
    assert {bin(a ^ b).count("1") for a in p for b in p if a != b} == {32}
    x = np.random.default_rng(0).integers(0, 2**63, 40, dtype=np.uint64)
    table = np.bitwise_count(x[:, None] ^ np.array(p, np.uint64)[None, :]).astype(int)
    real = np.bitwise_count(x[:, None] ^ x[None, :])
    assert (np.abs(table[:, None] - table[None]).max(2) <= real).all()


def test_one_row_of_each_group_stays(spark):
    pairs = corpus()
    left = S.drop_near_duplicates(documents(spark, pairs))
    want = {c for (i, _), c in zip(pairs, components([fingerprint(t) for _, t in pairs], [i for i, _ in pairs], 4)) if c is not None}
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert left.columns == documents(spark, []).columns


def test_empty_table_and_components(spark):
    assert S.near_duplicates(documents(spark, [])).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 7)], "u long, v long")
    assert {r.root for r in connected_components(chain).collect()} == {0}


def test_repeated_keys_with_different_texts_lose_no_group(spark):
    r = random.Random(9)
    a, b, c = (" ".join(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(60)) for _ in range(3))
    pairs = [(1, a), (5, a), (5, b), (7, b), (5, c), (5, c), (9, c), (5, c + " "), (None, b), (None, "only here " * 30), (None, "only here " * 30)]
    left = [(x.doc_id, x.text.strip()) for x in S.drop_near_duplicates(documents(spark, pairs)).collect()]
    assert sorted(left, key=str) == sorted([(1, a), (5, b), (5, c), (None, ("only here " * 30).strip())], key=str)


def test_windows_meet_wherever_fingerprints_are_close(spark):
    """Every close pair shares a pivot window at any depth, and the search of one group finds just the close pairs."""
    r = random.Random(3)
    refs = S.pivots(16)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 9))) for _ in range(120)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    for depth in (1, 3, 6):
        wins = {x.fp: set(x.w) for x in rows.select("fp", S._windows(F.col("fp"), refs[:6], 4, F.lit(depth)).alias("w")).collect()}
        assert all(wins[x] & wins[y] for x, a in zip(signed, fps) for y, b in zip(signed, fps) if bin(a ^ b).count("1") <= 4)
    u, v = S.search_groups(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), np.array(refs, np.uint64), 4, step=50)
    label = {f: f for f in signed}

    def root(x):
        return x if label[x] == x else root(label[x])

    for x, y in zip(u.tolist(), v.tolist()):
        label[root(x)] = root(y)
    want = components(fps, fps, 4)
    assert len({(root(x), w) for x, w in zip(signed, want)}) == len({root(x) for x in signed}) == len(set(want))
