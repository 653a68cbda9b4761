import random

import numpy as np

from fungo.llm import minhash as M

from .helpers import ODD, documents


def shingles(t, k):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
    return {b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(pairs, k, percent=80):
    sets = [shingles(t, k) for _, t in pairs]
    label = list(range(len(pairs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(pairs):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(s), least.get(root(i)) if s else key) for i, ((key, _), s) in enumerate(zip(pairs, sets))]


def corpus(seed=2):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out, base = [], [r.choice(words) for _ in range(150)]
    for i in range(50):
        out.append((i, " ".join(r.choice(words) for _ in range(r.randint(1, 90)))))
    for i in range(120):  # near copies, some of them linked with each other only through others
        ws = list(base)
        for _ in range(r.randint(0, 9)):
            ws[r.randrange(len(ws))] = r.choice(words)
        out.append((100 + i, " ".join(ws).title() if i % 7 == 0 else " ".join(ws)))
    chain = [r.choice(words) for _ in range(100)]
    for i in range(25):
        chain = chain[3:] + [r.choice(words) for _ in range(3)]
        out.append((300 + i, " ".join(chain)))
    return out + [(400 + i, " ".join(base)) for i in range(30)] + [(500, "a b c"), (501, "A b  c"), (502, "a b c d")] + ODD


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    pairs = corpus()
    found = M.near_duplicate_sets(documents(spark, pairs))
    assert rows(found) == sorted(brute(pairs, 5), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_crowded_buckets_in_pieces(spark):
    """Components do not depend on the size of pieces."""
    pairs = [p for p in corpus(7) if p[0] is not None and p[0] < 500]
    signed = M.sign_documents(documents(spark, pairs), "doc_id", "text", 4)
    nodes = signed.filter("n_shingles > 0").selectExpr("row node", "1L n", "n_shingles", "bands", "sketch")
    keys = {r.row: r.k for r in signed.select("row", "k").collect()}
    want = {key: c for key, _, c in brute(pairs, 4)}
    roots = {r.node: r.root for r in M.set_components(nodes, signed.select("row", "text"), 4, 80, 7, 700).collect()}
    least = {}
    for row, k in keys.items():
        least[roots.get(row, row)] = min(least.get(roots.get(row, row), k), k)
    assert {k: least[roots.get(row, row)] for row, k in keys.items()} == want


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    errors = []
    for share in (0.95, 0.8, 0.5):
        for _ in range(30):
            a = r.integers(0, 2**63, 300, dtype=np.uint64)
            b = np.concatenate((a[: int(300 * share)], r.integers(0, 2**63, 300 - int(300 * share), dtype=np.uint64)))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            sig = M.super_minhash(np.repeat([0, 1], 300), np.concatenate((a, b)), 2)
            errors.append((sig[0] == sig[1]).mean() - j)
            s = M.sketch_of(sig)
            assert M.differing(s[0], s[1]) <= (sig[0] != sig[1]).sum()
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def slow_super_minhash(hashes, slots):
    """Element by element, without early stopping."""
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    best = [mask] * slots
    for h in hashes:
        perm = list(range(slots))
        for j in range(slots):
            x = mix((h + (j + 1) * 0x9E3779B97F4A7C15) & mask)
            k = j + ((x & 0xFFFFFFFF) * (slots - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            best[perm[j]] = min(best[perm[j]], j << 32 | x >> 32)
    return best


def test_early_stopping_changes_nothing():
    r = random.Random(1)
    sets = [[r.getrandbits(64) for _ in range(n)] for n in (1, 3, 40, 700)]
    of = np.repeat(range(4), list(map(len, sets)))
    sig = M.super_minhash(of, np.array(sum(sets, []), np.uint64), 4, 16)
    assert sig.tolist() == [slow_super_minhash(s, 16) for s in sets]


def test_verification_beyond_the_broadcast_bounds(spark, monkeypatch):
    """Crowded centers and wanted texts by joins give the same links as by broadcast."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(30):
        ws = list(base)
        for _ in range(r.randint(0, 2)):
            ws[r.randrange(60)] = f"x{r.randrange(99)}"
        texts.append((i, " ".join(ws)))
    pairs = sorted({(c, x) for c in (0, 1, 2) for x in range(3, 30)} | {(5, 6), (7, 8)})
    df, t = spark.createDataFrame(pairs, "c long, x long"), spark.createDataFrame(texts, "row long, text string")
    sets = [shingles(x, 4) for _, x in texts]
    want = {(c, x) for c, x in pairs if 100 * len(sets[c] & sets[x]) >= 80 * len(sets[c] | sets[x])}
    assert 0 < len(want) < len(pairs)
    monkeypatch.setattr(M.beside, "__defaults__", (0,))
    for leaves, small in ((256, 10), (4, 10), (4, 0)):
        assert {tuple(e) for e in M.verified(df, t, 4, 80, leaves, small).collect()} == want


def test_grouping_by_forests_and_by_stars(spark):
    r = random.Random(8)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(links, "u long, v long").repartition(6)
    label = {x: x for e in links for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        label[b] = a
    for in_one in (0, 1000):
        got = {x.node: x.root for x in M.grouped(df, in_one).collect()}
        assert all(got.get(x, x) == root(x) for x in label)


def test_empty_table(spark):
    assert M.near_duplicate_sets(documents(spark, [])).count() == 0
