"""Every operator and stage beside columns of awkward names: none crashes, and values that come out are those that went in."""

import corpus_pipeline as C
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fungo.llm import align, decontam, html_extract, langid, linededup, minhash, queries, secrets, sharding, simhash, spelling, spm, urlfilter
from fungo.llm.common import read_table, shared_path
from fungo.llm.quality import judge_quality

from .helpers import documents

SF = "/root/testdata/sf0.001"
NAMES = ["x.y", "slot", "shard", "_h", "_k", "_row_k", "_row_h", "_key", "_c0", "_c1", "_d0", "row", "k", "t", "n", "items", "spans", "kept", "fp", "root", "word", "a`b", "with blank"]


@pytest.fixture(scope="module")
def docs(spark):
    df = read_table(spark, SF, "documents").limit(60)
    own = lambda i, c: F.concat(F.lit(f"{i} of "), F.col("doc_id").cast("string")).alias(c)
    return df.select("*", *(own(i, c) for i, c in enumerate(NAMES)), F.struct(F.col("doc_id").alias("a field"), F.lit(1).alias("b.c")).alias("nested")).cache()


@pytest.fixture(scope="module")
def pages(spark):
    df = read_table(spark, SF, "pages").limit(20)
    return df.select("*", *(F.lit(1).alias(c) for c in NAMES)).cache()


BENCH = lambda spark: read_table(spark, SF, "benchmark").withColumns({c: F.lit(1) for c in NAMES})
OPERATORS = {
    1: lambda s, d, p: sharding.write_shards(d, shared_path(s)),
    2: lambda s, d, p: html_extract.extract_main_text(p),
    3: lambda s, d, p: judge_quality(d, queries.PIECE_MODEL, queries.BPE_RANKS, queries.BPE_PATTERN),
    4: lambda s, d, p: simhash.near_duplicates(d),
    5: lambda s, d, p: langid.identify(d),
    6: lambda s, d, p: linededup.dedup_lines(d),
    7: lambda s, d, p: urlfilter.filter_urls(p, queries.URL_RULES),
    8: lambda s, d, p: spm.encode_documents(d, queries.PIECE_MODEL),
    9: lambda s, d, p: secrets.find_secrets(d),
    10: lambda s, d, p: decontam.find_contamination(d, BENCH(s)),
    11: lambda s, d, p: minhash.near_duplicate_sets(d),
    12: lambda s, d, p: align.align_documents(d, public_tokenizers.path("byte_bpe_50k.json"), queries.PIECE_MODEL),
    13: lambda s, d, p: spelling.group_variants(d),
}


@pytest.mark.parametrize("n", sorted(OPERATORS))
def test_operators(spark, docs, pages, n):
    out = OPERATORS[n](spark, docs, pages)
    rows = out.collect()
    if n != 13:
        assert len(rows) == (20 if n in (2, 7) else 60)
    if n == 1:
        for i, c in enumerate(NAMES):
            assert all(r[c + "_" if c in ("slot", "shard") else c] == f"{i} of {r['doc_id']}" for r in rows)
        assert all(r["nested"][0] == r["doc_id"] and 0 <= r["shard"] < 16 for r in rows)


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert rows
    if name != C.STAGES[-1][0]:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        for i, c in enumerate(NAMES):
            assert all(r[c] == f"{i} of {r['doc_id']}" for r in rows)
        assert all(r["nested"][0] == r["doc_id"] and r["nested"][1] == 1 for r in rows)


def test_texts_that_travel_are_sent_once(spark):
    """A stage that carries the text beside its results sends one copy of it to the workers."""
    docs = documents(spark, [(1, "some words " * 30), (2, None)])
    out = judge_quality(docs, queries.PIECE_MODEL, queries.BPE_RANKS, queries.BPE_PATTERN, carry=("source", "text", "lang", "text"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan[plan.index("MapInArrow") :].splitlines() if "Project" in line)
    assert sent.count("text#") == 1
    rows = out.select("doc_id", "_c0", "_c1", "_c2", "_c3").collect()
    assert sorted(map(tuple, rows)) == [(1, "src", "some words " * 30, "en", "some words " * 30), (2, "src", None, "en", None)]
