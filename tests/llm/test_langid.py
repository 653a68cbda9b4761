import random
import zlib

import pytest

from fungo.llm import langid

from .helpers import DOC_SCHEMA

SYLLABLES = {"en": ["th", "ing", "ed", "er", "on"], "de": ["sch", "ung", "keit", "ß", "ein"], "fr": ["eau", "ment", "é", "oi", "tion"]}


def table(spark, n=240):
    r = random.Random(1)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(r.randint(3, 40))), lang, "s", 1, "x", "x", 1, 0.5))
    return rows


def test_held_out_accuracy_and_columns(spark):
    rows = table(spark)
    got = langid.identify(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(spark):
    rows = [*table(spark), (900, None, "en", "s", 0, "x", "x", 1, 0.5), (901, "123 !!\n", "en", "s", 0, "x", "x", 1, 0.5), (902, "", None, "s", 0, "x", "x", 1, 0.5), (None, "the thing", None, "s", 0, "x", "x", 1, 0.5), (903, "UNG" * 9999, None, "s", 0, "x", "x", 1, 0.5)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "de" and got[None].held_out is False


def test_language_is_no_input(spark):
    rows = table(spark)
    other = [(*r[:2], "xx" if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], "zz", *r[4:]) for r in rows]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, DOC_SCHEMA)).collect())) for x in (rows, other))
    assert a == b


def test_empty_and_unlabelled(spark):
    assert langid.identify(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None, "s", 1, "x", "x", 1, 0.5)], DOC_SCHEMA)).first().lang_pred == "und"


def brute(rows, taught):
    """Naive Bayes with dictionaries: counts of bucketed n-grams by language, logs, sums."""
    import math
    from collections import Counter

    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def buckets(t):
        t = (t or "").lower().replace("\n", " ")
        chars, before = "", False
        for c in t:
            if c.isalpha():
                chars += c
            elif before:
                chars += " "
            before = c.isalpha()
        chars += " "
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                gram = chars[i : i + n]
                if gram.strip():
                    h = n
                    for c in gram:
                        h = ((h ^ ord(c)) * mix) & mask
                    yield h >> 49

    counts = {}
    for i, t, lang in rows:
        if taught(i) and lang is not None:
            counts.setdefault(lang, Counter()).update(buckets(t))
    total = {lang: sum(c.values()) + 0.5 * langid.BUCKETS for lang, c in counts.items()}
    out = {}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out[i] = ("und", 0.0)
            continue
        bs = list(buckets(t))
        score = {lang: sum(math.log((c[b] + 0.5) / total[lang]) for b in bs) for lang, c in counts.items()}
        best = max(sorted(score), key=score.get)
        out[i] = (best, 1 / sum(math.exp(s - score[best]) for s in score.values()))
    return out


def test_against_brute_force_bayes(spark):
    rows = [r for r in table(spark, 150)] + [(900, None, "en"), (901, "12 !", "de"), (902, "a", None), (903, "Ünge\u00a0ß  th\n\nEAU", None), (904, "e", "xx"), (905, "word " * 9000, "en")]
    rows = [(*r[:3], "s", 1, "x", "x", 1, 0.5) for r in rows]
    want = brute([r[:3] for r in rows], lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-3 for i in want)


def test_many_languages_are_all_learnt(spark):
    rows = [(i, f"{chr(0x4E00 + i % 203)}{chr(0x4E00 + i % 203)} {chr(0x4E00 + i % 203)}", f"l{i % 203:03}", "s", 1, "x", "x", 1, 0.5) for i in range(1218)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    names, _ = langid.train(docs)
    assert len(names) == 203
    got = langid.predict(docs, *langid.train(docs)).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 203:03}" for r in got)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, max_matrix_mb=16)


def test_grams_do_not_cross_texts():
    g = langid.Grams()
    whole = g.of([b"ab", b"cd"])
    parts = [sorted(g.of([x])[0].tolist()) for x in (b"ab", b"cd")]
    assert [sorted(whole[0][whole[1] == i].tolist()) for i in (0, 1)] == parts
