import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fungo.llm import align as L

from .helpers import ODD, documents

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
STRANGE = ["a  b   c ", " lead", "tail  ", "tab\t x \n y\r\n  z", "it's we'll 's", "<|endoftext|> <s> </s> <unk>", "nb sp 　 wide", "aaaa" * 60, "日本語のテキスト です。", "😀 😀😀", "mark ▁ here", "x▁", "a\x00b \x01", "  line", "1234567 89 3.14", " \n", "\n \n", "़क ा", "ﬁ ligature Ａ", "​ zero"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(text, libraries):
    """Groups [(A ids, B ids)] straight from the libraries."""
    if not text:
        return []
    a, b = libraries
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
    of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, start = [], 0
    for e in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, x in zip(ids_a, ends_a) if start < x <= e], [i for i, x in zip(ids_b, ends_b) if start < x <= e]))
        start = e
    return out


def facts(texts, libraries):
    groups = [brute(t, libraries) for t in texts]
    links = [Counter((x, y) for p, q in g for x in p for y in q) for g in groups]
    docs = Counter(k for c in links for k in c)
    top = {}
    for (x, _), n in docs.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for g, c in zip(groups, links):
        sha = hashlib.sha256(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g).encode()).hexdigest() if g else ""
        out.append((sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()), sum(n for k, n in c.items() if docs[k] == top[k[0]]), sum(n * docs[k] for k, n in c.items()), sha))
    return out


def corpus():
    r = random.Random(3)
    words = "the of naïve tokenization Straße schön über 2024 foo_bar http://x.y/z don't über-alles ... !!! größer été".split()
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(40)]
    made += ["".join(r.choice("ab \n\t é😀1'") for _ in range(r.randint(1, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(made + STRANGE)] + ODD


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def test_against_the_libraries(spark, libraries):
    pairs = corpus()
    want = sorted(((k, *f) for (k, _), f in zip(pairs, facts([t for _, t in pairs], libraries))), key=str)
    assert rows(L.align_documents(documents(spark, pairs), A, B)) == want
    assert rows(L.align_documents(documents(spark, pairs), A, B, max_pairs=0)) == want


def test_pairs_and_links(spark, libraries):
    got = L.align_documents(documents(spark, [(1, "unhappiness unhappiness")]), A, B).first()
    want = Counter((x, y) for p, q in brute("unhappiness unhappiness", libraries) for x in p for y in q)
    assert {divmod(p, 32000): n for p, n in zip(got.pairs, got.links)} == want
    assert max(got.n_a, got.n_b) <= got.n_overlaps <= got.n_links


def test_products_equal_dense_ones():
    r = np.random.default_rng(1)
    for step in (1, 7, 1000):
        x, y = r.integers(0, 3, (9, 6)), r.integers(0, 3, (6, 8))
        rows = [L.from_triples(*np.nonzero(m), m[np.nonzero(m)], len(m)) for m in (x, y)]
        p = L.product(*rows, step)
        dense = np.zeros((9, 8), int)
        dense[np.repeat(np.arange(9), np.diff(p.indptr)), p.indices] = p.data
        assert (dense == x @ y).all()


def test_parts_do_not_depend_on_their_surroundings(libraries):
    r = random.Random(9)
    a, b = libraries
    for _ in range(400):
        s = " " + "".join(r.choice("ab  \n\t 　é1'.") for _ in range(r.randint(1, 40)))
        parts = L.units_of(s)
        assert "".join(parts) == s
        assert sum((a.encode(p, add_special_tokens=False).ids for p in parts), []) == a.encode(s, add_special_tokens=False).ids


def test_giant_texts(libraries):
    pair = L.Pair(open(A, "rb").read(), open(B, "rb").read())
    r = random.Random(4)
    for t in ("a" * 300_000, " " * 100_000, "\n" * 100_000, "".join(r.choice("abcdefgh") for _ in range(200_000)), "é" * 50_000):
        got = L.align_texts([t.encode()], pair)
        assert got[0][0].as_py() > 0 and sum(got[6][0].as_py()) >= got[3][0].as_py()


def test_empty_table(spark):
    assert L.align_documents(documents(spark, []), A, B).count() == 0
