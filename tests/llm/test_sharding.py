import hashlib
import random

import pytest

from fungo.llm import queries as Q
from fungo.llm.sharding import histogram_shards, write_shards

from .helpers import ODD, crc, documents


def shards(spark, pairs, n=4, **more):
    return histogram_shards(documents(spark, pairs), n, **more).collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_balanced_gapless_and_complete(spark, parts):
    r = random.Random(3)
    pairs = [(i, "word " * r.randint(0, 60)) for i in range(600)] + [(1000 + i, "the same hot text " * 3) for i in range(300)] + ODD
    got = shards(spark, pairs, parts_per_shard=parts)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size, x.text_crc32) for x in got) == sorted((i is None, i or 0, len((t or "").encode()) + 1, crc(t)) for i, t in pairs)
    assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}
    total, largest = sum(x.size for x in got), max(x.size for x in got)
    for s in range(4):
        mine = [x for x in got if x.shard == s]
        assert sorted(x.slot for x in mine) == list(range(len(mine)))
        assert abs(sum(x.size for x in mine) - total / 4) <= largest + 0.001 * total


def brute(pairs, n):
    """Rows by (MD5, key) and place; each boundary next to its share of the bytes, the lower of two as near."""
    rows = sorted(((hashlib.md5((t or "").encode()).hexdigest()[:15], -(1 << 62) if i is None else i, place, i, t) for place, (i, t) in enumerate(pairs)), key=lambda r: r[:3])
    sizes = [len((t or "").encode()) + 1 for *_, t in rows]
    total, below, cuts = sum(sizes), 0, []
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    for j in range(1, n):
        cuts.append(min(range(len(ends)), key=lambda e: (abs(ends[e] * n - total * j), e)))
    out, slots = [], [0] * n
    for p, (*_, i, t) in enumerate(rows):
        shard = sum(c <= p for c in cuts)
        out.append((i, crc(t), shard, slots[shard]))
        slots[shard] += 1
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_shards_and_slots_against_brute_force(spark, parts):
    r = random.Random(8)
    pairs = [(i, f"w{i} " * r.randint(0, 40)) for i in range(300)] + [(400 + i, "hot " * 9) for i in range(150)] + [x for x in ODD if x[0] not in (None, 904)] + [(950, "one very long text " * 4000)]
    for n in (2, 4, 7):
        got = [(x.doc_id, x.text_crc32, x.shard, x.slot) for x in shards(spark, pairs, n, parts_per_shard=parts)]
        assert sorted(got) == sorted(brute(pairs, n))


def test_equal_texts_are_neighbours(spark):
    pairs = [(i, f"text {i % 7}") for i in range(210)]
    order = sorted(shards(spark, pairs), key=lambda x: (x.shard, x.slot))
    seen = [x.text_crc32 for x in order]
    assert sum(a != b for a, b in zip(seen, seen[1:])) == 6
    assert len({x.shard for x in order}) == 4


def test_one_text_repeated_with_one_key(spark):
    got = shards(spark, [(1, "same")] * 40)
    assert sorted((x.shard, x.slot) for x in got) == [(s, i) for s in range(4) for i in range(10)]


def test_empty_table(spark):
    assert shards(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = histogram_shards(documents(spark, [(1, "a"), (2, "b")]), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_documents_lie_whole_in_files_by_shard(spark, tmp_path):
    pairs = [(i, f"text {i} " * (i % 9)) for i in range(200)] + [(500 + i, "the same hot text") for i in range(100)] + ODD
    docs = documents(spark, pairs)
    out = write_shards(docs.drop("shard"), f"{tmp_path}/out", 4, parts_per_shard=2)
    assert sorted(map(repr, out.select(docs.drop("shard").columns).collect())) == sorted(map(repr, docs.drop("shard").collect()))
    want = {(x.doc_id, x.text_crc32, x.shard, x.slot) for x in histogram_shards(docs, 4, parts_per_shard=2).collect() if x.doc_id not in (None, 904)}
    assert {(x.doc_id, crc(x.text), x.shard, x.slot) for x in out.collect() if x.doc_id not in (None, 904)} == want
    for s in range(4):
        for f in (tmp_path / "out" / f"shard={s}").glob("*.parquet"):
            slots = [x.slot for x in spark.read.parquet(str(f)).collect()]
            assert slots == list(range(slots[0], slots[0] + len(slots)))
    clash = write_shards(docs, f"{tmp_path}/clash", 4)
    assert {"shard", "shard_", "slot"} <= set(clash.columns) and all(r.shard_ == 0.5 and 0 <= r.shard < 4 for r in clash.collect())


def test_query_moves_texts(spark):
    docs = Q.read_table(spark, "/root/testdata/sf0.001", "documents")
    (folder,) = {f.rsplit("/shard=", 1)[0] for f in Q.op1_sharding(spark, "/root/testdata/sf0.001").inputFiles()}
    held = spark.read.parquet(folder).select(docs.columns)
    assert held.exceptAll(docs).count() == docs.exceptAll(held).count() == 0


def test_empty_table_in_files(spark, tmp_path):
    assert write_shards(documents(spark, []).drop("shard"), f"{tmp_path}/none").count() == 0
