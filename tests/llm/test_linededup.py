import random

import numpy as np
import pytest

from fungo.llm import linededup as L

from .helpers import ODD, documents

HOT = "This line is long enough to be a boilerplate line, é."


def brute(pairs, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    held = {}
    for n, (i, t) in enumerate(pairs):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), {})[n] = i
    out = []
    for i, t in pairs:
        kept = []
        lines = (t or "").split("\n")
        for line in lines:
            rows = held.get(key(line), {})
            ids = [x for x in rows.values() if x is not None]
            if not (len(set(rows.values())) >= min_docs and ids and max(ids) != i):
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def corpus():
    r = random.Random(5)
    common = [f"common line number {i} with enough characters in it" for i in range(12)]
    pairs = [(i, "\n".join(r.choice([r.choice(common), r.choice(common).upper() + "\t", f"own line {i} {r.random()} and some more words here", "short"]) for _ in range(r.randint(1, 9)))) for i in range(80)]
    few = "held by five rows, but of three documents only"
    repeated = [(600, few), (600, few + "\nand more"), (601, few), (601, few + "\nmore"), (602, few), (None, few + "\nno key"), (None, HOT + "\nno key")]
    return pairs + [(500 + i, f"{HOT}\n{HOT.lower()}  \nown {i}") for i in range(4)] + ODD + [(504, HOT)] + repeated + [(700, "one long line " * 20_000 + "\n" + HOT)]


def same(df, pairs):
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key) == sorted(brute(pairs), key=key)


def test_against_brute_force(spark):
    same(L.dedup_lines(documents(spark, corpus())), corpus())


@pytest.mark.parametrize("hot_share", [1, 10, 1000])
def test_index_beyond_the_bound_gives_the_same(spark, monkeypatch, hot_share):
    monkeypatch.setattr(L, "SHARD_KEYS", 3)
    monkeypatch.setattr(L, "HOT_SHARE", hot_share)
    same(L.dedup_lines(documents(spark, corpus()), max_index_mb=-1), corpus())


def test_carried_columns_and_empty_table(spark):
    assert L.dedup_lines(documents(spark, [])).count() == 0
    row = L.dedup_lines(documents(spark, [(1, "a")]), carry=("size", "t")).first()
    assert (row["_c0"], row["_c1"], row["text"]) == ("own", 5, "a")


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    h = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.arange(n, dtype=np.uint64) % np.uint64(2)
    h = np.unique(h)
    assert sorted(L.mph_slots(h, L.build_mph(h), len(h))) == list(range(len(h)))
