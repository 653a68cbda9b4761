import random
import re
import zlib
from collections import Counter

from fungo.llm import spelling as S

from .helpers import ODD, documents


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(pairs, typo_every=None):
    n = Counter()
    for i, t in pairs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if typo_every and h % typo_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    form, out = {}, []
    for w, k in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * k else None
        out.append([w, form[w], None, k, len(close), words[best] if form[w] else None])
    for row in out:
        row[2] = row[0]
        while form[row[2]]:
            row[2] = form[row[2]]
    return sorted(map(tuple, out), key=str)


def corpus():
    r = random.Random(5)
    base = ["banana", "bananna", "bannana", "letter", "lettre", "aaaaaa", "aaaaaaa", "aaaaaaaaa", "étéété", "Étéété", "mississippi", "misissippi"]
    base += ["".join(r.choice("abc") for _ in range(r.randint(6, 8))) for _ in range(120)]
    long = "".join(r.choice("abcd") for _ in range(300))
    base += [long, long[:100] + "x" + long[101:], long[:250] + long[251:], long[:70] + "b" + long[70:], "z" * 200, "z" * 199]
    texts = []
    for i in range(60):
        words = [w for w in base if r.random() < 0.6 for _ in range(r.choice((1, 1, 2, 30)) if w < "bc" else 1)]
        texts.append((i, " ".join(w.title() if r.random() < 0.2 else w for w in words) + ", × ÷ one1two"))
    return texts + [(7, texts[7][1])] + ODD


def rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    assert rows(S.group_variants(documents(spark, corpus()))) == brute(corpus())


def test_planted_typos(spark):
    assert rows(S.group_variants(documents(spark, corpus()), typo_every=7)) == brute(corpus(), 7)


def test_chains_lead_to_their_last_form(spark):
    texts = [(1, "worded " * 5 + "wordes " * 30 + "wordas " * 200 + "wardas " * 2000)]
    assert {r[0]: r[2] for r in rows(S.group_variants(documents(spark, texts)))} == dict.fromkeys(("worded", "wordes", "wordas", "wardas"), "wardas")


def test_rotations_name_long_words_as_short_ones(monkeypatch):
    """Fingerprints meet exactly where written rotations do."""
    r = random.Random(6)
    words = ["".join(r.choice("ab") for _ in range(r.randint(6, 9))) for _ in range(60)]
    plain = [S.rotations(w) for w in words]
    monkeypatch.setattr(S, "LONG_WORD", 3)
    named = [S.rotations(w) for w in words]
    flat = [k for p in plain for part in p[:2] for k in part], [k for p in named for part in p[:2] for k in part]
    assert len(set(zip(*flat))) == len(set(flat[0])) == len(set(flat[1]))


def test_empty_table(spark):
    assert S.group_variants(documents(spark, [])).count() == 0
