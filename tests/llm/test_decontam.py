import random

from fungo.llm import decontam as D

from .helpers import ODD, documents


def brute(docs, items, window=13):
    rows = []
    its = [(str(i), D.words_of(t.encode() if t else None)) for i, t in items]
    for i, t in docs:
        ws = D.words_of(t.encode() if t else None)
        hit, found = set(), set()
        for k, iw in its:
            n = min(window, len(iw))
            grams = {tuple(iw[s : s + n]) for s in range(len(iw) - n + 1)} if n else set()
            for s in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    found.add(k)
        rows.append((i, len(ws), len(hit), sorted(found)))
    return rows


def corpus():
    r = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["é", "中"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 40)))) for i in range(30)] + [(30, None), (31, "..."), (32, "Zz"), (33, "w1 w1 w1 w1"), (2, "again one two three")]
    docs = []
    for i in range(120):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(1, 50)))]
        if i % 3 == 0:
            ws = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(ws) - 1))
            parts.append("-".join(ws[a:]).upper())
        docs.append((i, ", ".join(parts)))
    return docs + ODD + [(400, "zz"), (401, "w1 " * 60)], items


def compare(spark, **more):
    docs, items = corpus()
    out = D.find_contamination(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **more)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(brute(docs, items), key=key)
    assert all(sum(b - a for a, b in r.spans) == r.n_hit for r in got)


def test_against_brute_force(spark):
    compare(spark)


def test_many_shards_give_the_same(spark):
    compare(spark, shard_bytes=300)
    compare(spark, shard_bytes=300, max_index_mb=0)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(documents(spark, []), items).count() == 0
    assert D.find_contamination(documents(spark, [(1, "a b")]), items, carry=("size",)).first()["_c0"] == "own"


def test_without_spans():
    text = "Keep this, drop THESE words! and keep.".encode()
    assert D.without_spans(text, [(2, 5)]) == b"Keep this, ! and keep."


def test_removal_by_both_limits(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    own = " ".join(f"mine{i}" for i in range(400))
    docs = [(1, item), (2, f"{own}. {item.upper()}! {own}"), (3, own), (4, f"{own} {item[:20]} {own}"), (5, None), (None, ""), (3, own), (6, own * 30 + " " + item)]
    items = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    df = documents(spark, docs)
    out = D.decontaminate(df, items, length="n_chars")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    kept = [(i, t, len(t) if t is not None else None) for i, t in docs if i not in (1, 2, 6)]
    kept += [(2, f"{own}. ! {own}", len(own) * 2 + 4), (6, own * 30 + " ", len(own) * 30 + 1)]
    assert got == sorted(kept, key=str)
    assert D.decontaminate(documents(spark, []), items).count() == 0
    assert D.decontaminate(df, items.limit(0)).count() == len(docs)
