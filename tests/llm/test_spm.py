import random

import pytest
import sentencepiece

from fungo.llm import queries as Q
from fungo.llm import spm

from .helpers import ODD, documents


@pytest.fixture(scope="module")
def model():
    with open(Q.PIECE_MODEL, "rb") as f:
        return spm.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_MODEL)


def by_chunks(model, text, size):
    s = model.escape(text)
    edges = spm._cuts(len(s), size)
    chunks = []
    for c, (a, b) in enumerate(zip(edges, edges[1:])):
        x, y = max(0, a - 2 * model.longest), min(len(s), b + 2 * model.longest)
        chunks.append((s[x:y], a - x, b - x, c == 0, c == len(edges) - 2))
    states = spm.resolve([spm.transfer(model, *c) for c in chunks])
    return [i for c, (x, y) in zip(chunks, states) for i in spm.backtrace(model, c[0], c[1], c[2], x, y, c[3])]


TEXTS = ["the quick brown foxes " * 20, "a" * 300, " " * 200, "-" * 201, "中文字" * 60 + "x y\n\n z", "é" * 150 + "ab  " * 20, "\n" * 90, "ab " * 70 + "\n\t" * 9, "\U0001d518x" * 60] + ["".join(random.Random(i).choice("aehnrstth_-=#1") for _ in range(300)) for i in range(12)]


@pytest.mark.parametrize("text", TEXTS)
def test_scan_equals_the_library(model, library, text):
    want = library.encode(text)
    assert model.encode_escaped([model.escape(text)])[0] == want
    assert [by_chunks(model, text, size) for size in (64, 77, 130)] == [want] * 3
    assert model.decode(want).decode() == text


def test_documents_short_and_giant(spark, library):
    r = random.Random(3)
    pairs = [(i, "".join(r.choice(["word ", "\n", "xyz", "  ", "中", "=="]) for _ in range(r.randint(0, 300)))) for i in range(40)] + ODD
    docs = documents(spark, pairs)
    want = sorted(((i is None, i or 0, None if t is None else library.encode(t)) for i, t in pairs), key=str)
    for size in (100_000, 100):
        got = spm.encode_documents(docs, Q.PIECE_MODEL, chunk_chars=size)
        rows = got.collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0, r.token_ids) for r in rows), key=str) == want
        assert all(r.round_trip in (True, None) for r in rows)
    back = spm.decode_documents(got, Q.PIECE_MODEL)
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(str(t) for _, t in pairs)


def test_every_row_of_a_table_equals_the_library(spark, library):
    """The given documents, among which many have several chunks, and one of 300,000 characters."""
    docs = Q.read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts[-1] = "".join(random.Random(5).choice(["lorem ", "ipsum", "\n", "  ", "é", "中文", "=-=", "The "]) for _ in range(90_000))
    docs = docs.unionAll(spark.createDataFrame([(-1, texts[-1])], "doc_id long, text string"))
    rows = spm.encode_documents(docs, Q.PIECE_MODEL, chunk_chars=8_000).collect()
    assert {r.doc_id: r.token_ids for r in rows} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r.round_trip for r in rows) and all((r.n_chunks > 1) == (len(texts[r.doc_id]) > 8_000) for r in rows)
    assert sum(r.n_chunks > 1 for r in rows) > 20


def test_units_equal_the_library(model, library):
    words = list({u for t in TEXTS for u in model.units.findall(model.escape(t))})
    assert [model.unit_ids(u) for u in words] == model.processor.encode(words)


def test_units_that_lead_the_longest_tokens_astray(model, library):
    r = random.Random(3)
    drawn = ("".join(r.choice("abcdefghilmnoprstuyéß\u2581漢🙂0") for _ in range(r.randint(1, 40))) for _ in range(5_000))
    words = list({u for t in drawn for u in model.units.findall(t)})
    back, plain = 0, model.longest_token

    def counted(s, p, limit):
        nonlocal back
        back += limit < len(s)
        return plain(s, p, limit)

    model.longest_token = counted
    try:
        assert [model.unit_ids(u) for u in words] == model.processor.encode(words)
    finally:
        del model.longest_token
    assert back > 1_000


def test_texts_of_chunks_are_shuffled_once(spark):
    docs = documents(spark, [(i, "river stone " * 2_000) for i in range(3)]).coalesce(1)
    plan = spm.encode_documents(docs, Q.PIECE_MODEL)._jdf.queryExecution().executedPlan().toString()
    behind = plan[plan.index("ShuffledHashJoin") :]  # the join and what feeds it
    chunks = behind[: behind.index("FileScan parquet")]
    assert "Bucketed: true" in plan and "Exchange" not in chunks  # texts of chunks stay where their bucket lies
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fungo_") and not t.isTemporary and len(t.name) == 38]


def test_empty_table_and_space_mark(spark):
    assert spm.encode_documents(documents(spark, []), Q.PIECE_MODEL).count() == 0
    assert spm.encode_documents(documents(spark, [(1, "a\u2581b")]), Q.PIECE_MODEL).first().round_trip is False


def test_max_plus_product_is_associative():
    import numpy as np

    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random((4, 4)) < 0.5, -np.inf, r.integers(-5, 5, (4, 4))) for _ in range(3))
    assert (spm.compose(spm.compose(a, b), c) == spm.compose(a, spm.compose(b, c))).all()


def test_units_of_chunks_are_scanned_together(model, library, monkeypatch):
    """Words that no cache holds take no walk of their own, but for long ones and runs of spaces."""
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("aeiourstlnmxyzéß漢") for _ in range(r.randint(1, 14))) for _ in range(80)) + "\n" for _ in range(20)]
    monkeypatch.setattr(model, "unit_ids", None)
    assert [by_chunks(model, t, 130) for t in texts] == [library.encode(t) for t in texts]


def test_scan_of_many_units(model):
    r = random.Random(12)
    drawn = ("".join(r.choice("abcdeinorst▁▁▁\n漢🙂é0=-\x00") for _ in range(r.randint(1, 90))) for _ in range(3_000))
    units = list({u for t in drawn for u in model.units.findall(t)}) + ["▁" * n for n in range(1, 40)] + ["x" * 300]
    assert [memoryview(x).cast("H").tolist() for x in model.trace(units)] == model.processor.encode(units)
    assert model.trace([]) == []


def test_parts_are_the_units(model):
    r = random.Random(13)
    for _ in range(3_000):
        s = "".join(r.choice("ab▁▁\n\n\t\x00" if r.random() < 0.01 else "ab▁▁\n\n\t") for _ in range(r.randint(0, 30)))
        assert [p for p in model.parts(s) if p] == model.units.findall(s)


def test_units_that_their_ids_do_not_spell(library):
    with open(Q.PIECE_MODEL, "rb") as f:
        own = spm.Model(f.read())
    own.out[library.piece_to_id("▁the")] = b" teh"
    assert own.encode_packed([own.escape(t) for t in ("over the top", "a river", "", "so the end")])[1] == [False, True, True, False]
    assert own.encode_packed([own.escape("on the way"), own.escape("a way")])[1] == [False, True]


def test_matrices_of_documents_are_combined_in_batches(spark, library):
    """No Python group a document; documents of one row key, of none and of many chunks keep their own edges."""
    pairs = [(i % 5 or None, " ".join(f"river{i}stone" * (j % 4) + "ab" for j in range(20 + i))) for i in range(50)]
    got = spm.encode_documents(documents(spark, pairs), Q.PIECE_MODEL, chunk_chars=90)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.token_ids) for r in rows) == sorted((k or 0, library.encode(t)) for k, t in pairs)
    assert all(r.round_trip and r.n_chunks > 1 for r in rows)


def test_scan_asks_of_few_pairs_whether_they_fit(model, monkeypatch):
    r = random.Random(14)
    units = ["▁" + "".join(r.choice("aeiourstlnmdcp") for _ in range(r.randint(3, 12))) for _ in range(4_000)]
    asked, plain = [], model.steps.fit
    monkeypatch.setattr(model.steps, "fit", lambda a, b: asked.append(len(a)) or plain(a, b))
    assert [memoryview(x).cast("H").tolist() for x in model.trace(units)] == model.processor.encode(units)
    assert sum(asked) < sum(map(len, units))


def test_table_of_numbers():
    import numpy as np

    r = np.random.default_rng(2)
    keys = np.unique(np.concatenate((r.integers(0, 1 << 42, 5_000), np.arange(5_000) << 21, [(1 << 42) - 1])))
    values = r.integers(0, 1 << 20, len(keys))
    table = spm.Numbers(keys, values)
    assert (table.get(keys) == values).all()
    other = np.setdiff1d(r.integers(0, 1 << 42, 5_000), keys)
    assert (table.get(other) == -1).all() and len(table.get(keys[:0])) == 0
    with pytest.raises(ValueError):
        spm.Numbers(np.array([1 << 42]), np.array([0]))


def test_each_unit_spells_itself():
    """What all units spell together is not enough."""
    with open(Q.PIECE_MODEL, "rb") as f:
        own = spm.Model(f.read())
    import numpy as np

    ids = [own.ids["a"], own.ids["b"]]
    own._spells(["ab", "", "c", "ba"], np.array([*ids, own.ids["c"], *ids[::-1]]), np.array([2, 0, 1, 2]))
    assert not own.flawed
    own._spells(["a", "bc"], np.array([*ids, own.ids["c"]]), np.array([2, 1]))
    assert own.flawed == {"a", "bc"}
