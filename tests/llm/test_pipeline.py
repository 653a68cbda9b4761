"""The pipeline against its stages' brute-force versions, on the smallest tables."""

import os

import corpus_pipeline as C
import duckdb

from fungo.llm import queries as Q
from fungo.llm.common import cut_lineage, shared_dir

from . import test_decontam, test_linededup, test_quality, test_simhash
from .helpers import ODD, documents

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = Q.read_table(spark, SF, "documents")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert set(got) <= {i for i, t in rows.items() if not test_quality.brute(t)[5]}
            want = {i: rows[i] for i in got}
        elif name == "line_dedup":
            want = {i: t for i, t, *_ in test_linededup.brute(sorted(rows.items()))}
        elif name == "near_dedup":
            ids = sorted(rows)
            comp = test_simhash.components([test_simhash.fingerprint(rows[i]) for i in ids], ids, 4)
            want = {i: rows[i] for i, c in zip(ids, comp) if i == c}
        else:
            items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
            found = test_decontam.brute(sorted(rows.items()), items)
            want = {i: rows[i] for i, n, hit, _ in found if not (hit > 0 and 20 * hit >= n)}
            some = {i for i, _, hit, _ in found if hit}
            assert all(got[i] == t or (i in some and len(got[i]) < len(t)) for i, t in want.items())
            got, want = set(got), set(want)
        assert got == want
        rows = {r.doc_id: r.text for r in docs.collect()}
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(rows) and all(r.round_trip for r in last)


def test_odd_rows_in_every_stage(spark):
    """Nulls, empty and long texts, repeated rows, no rows at all, and columns with names that stages use inside."""
    long_one = " ".join(f"word{i % 997} and{i % 1009}" for i in range(15_000))
    pairs = ODD + [(910, long_one), (911, long_one), (None, None), (912, None), (912, None)]
    for docs in (documents(spark, pairs), documents(spark, [])):
        docs = docs.toDF(*({"size": "k", "k": "h", "t": "items", "shard": "_c0"}.get(c, c) for c in docs.columns))
        n = docs.count()
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            rows = out.collect()
            assert all(r["k"] == r["h"] == "own" and r["items"] == 5 and r["_c0"] == 0.5 for r in rows)
            if name in ("line_dedup", "decontamination"):
                assert len(rows) == n
            if name == "near_dedup":
                assert len({r["doc_id"] for r in rows}) == len(rows) and (not n or 910 in {r["doc_id"] for r in rows})
            if name == "quality_rules":
                assert all(r["text"] for r in rows)
        assert C.sentencepiece(spark, docs, SF).count() == n


def test_run_and_lengths(spark):
    before = set(os.listdir(shared_dir(spark)))
    out = C.run(spark, SF)
    assert len([x for x in set(os.listdir(shared_dir(spark))) - before if not x.endswith(".crc")]) <= 2
    assert out.count() > 0 and "token_ids" in out.columns
    docs = C.line_dedup(spark, Q.read_table(spark, SF, "documents"), SF)
    assert docs.filter("n_chars != char_length(text)").count() == Q.read_table(spark, SF, "documents").filter("n_chars != char_length(text)").count()
