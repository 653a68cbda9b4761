"""Quality rules: word counts and tokeniser fertility against bands per script."""

from __future__ import annotations

import base64
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_text

#: Bands (low, high) by script: characters a token in either vocabulary, share of byte-fallback
#: tokens, and bits of token entropy (collision entropy, which one overused token lowers at once).
#: A document outside a band is rejected.  Characters a token below the band mean noise the
#: vocabularies do not know (or shouting, which they split); above it, endless runs of one symbol.
#: Low ends lie between plain prose and the same letters shuffled or drawn at random, as measured
#: on a few hundred words in each script; of scripts that the vocabularies spell letter by letter
#: only the byte share and the second vocabulary tell much.  A text's script is that of most of
#: its letters; scripts without a band of their own are `other`.
BANDS = {
    "latin": {"chars_piece": (1.55, 7.0), "chars_bpe": (1.79, 8.0), "byte_share": (0.0, 0.12), "entropy": (4.8, 99.0)},
    "cyrillic": {"chars_piece": (1.4, 7.0), "chars_bpe": (1.5, 8.0), "byte_share": (0.0, 0.12), "entropy": (4.4, 99.0)},
    "greek": {"chars_piece": (0.6, 7.0), "chars_bpe": (1.35, 8.0), "byte_share": (0.0, 0.12), "entropy": (3.4, 99.0)},
    "arabic": {"chars_piece": (0.6, 7.0), "chars_bpe": (1.35, 8.0), "byte_share": (0.0, 0.15), "entropy": (3.4, 99.0)},
    "hebrew": {"chars_piece": (0.6, 7.0), "chars_bpe": (1.28, 8.0), "byte_share": (0.0, 0.15), "entropy": (3.2, 99.0)},
    "devanagari": {"chars_piece": (0.55, 7.0), "chars_bpe": (0.66, 8.0), "byte_share": (0.0, 0.35), "entropy": (3.2, 99.0)},
    "thai": {"chars_piece": (0.7, 7.0), "chars_bpe": (0.8, 8.0), "byte_share": (0.0, 0.3), "entropy": (3.4, 99.0)},
    "cjk": {"chars_piece": (0.5, 7.0), "chars_bpe": (0.6, 8.0), "byte_share": (0.0, 0.6), "entropy": (3.4, 99.0)},
    "hangul": {"chars_piece": (0.45, 7.0), "chars_bpe": (0.68, 8.0), "byte_share": (0.0, 0.5), "entropy": (3.0, 99.0)},
    "other": {"chars_piece": (0.25, 7.0), "chars_bpe": (0.25, 8.0), "byte_share": (0.0, 0.95), "entropy": (3.0, 99.0)},
}
#: First words of the Unicode names of letters: the script they count for.
SCRIPTS = {"CYRILLIC": "cyrillic", "GREEK": "greek", "ARABIC": "arabic", "HEBREW": "hebrew", "DEVANAGARI": "devanagari", "THAI": "thai", "CJK": "cjk", "HIRAGANA": "cjk", "KATAKANA": "cjk", "HANGUL": "hangul"}
#: Characters counted by the symbol rule.
SYMBOLS = b"#*$%&|<>"
#: Words beyond this many bytes are not worth keeping.
LONG_WORD = 96
#: Piece ids as the cache keeps them: a few bytes a word, no Python objects.
KEPT_ID = np.dtype("<u4")
_NAMES = (*dict.fromkeys(SCRIPTS.values()), "other")
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def script_of(letters: list[str]) -> int:
    """Place in _NAMES of the script that most of some letters beyond the Latin ones belong to."""
    found = Counter(SCRIPTS.get(unicodedata.name(c, "?").split()[0], "other") for c in letters)
    return _NAMES.index(max(found, key=lambda n: (found[n], n)))


class Vocabularies:
    """Pieces of both public vocabularies for single words, with a cache of words up to LONG_WORD bytes, about `cache_bytes` in all."""

    def __init__(self, piece_model: bytes, bpe_ranks: bytes, pattern: str, cache_bytes: int = 1_200_000):
        import sentencepiece
        import tiktoken

        self.piece = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.piece.get_piece_size())])
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe_ranks.splitlines())}
        self.bpe = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[bytes, tuple] = {}
        self.cache_bytes, self.held = cache_bytes, 0

    def word_facts(self, words: list[bytes]) -> list[tuple]:
        """By word: code points, symbols, Latin letters, other letters, piece ids (as bytes of KEPT_ID), number of bpe tokens, script of the other letters."""
        cache = self.cache
        if self.held > self.cache_bytes:
            cache.clear()
            self.held = 0
        new = [w for w in words if w not in cache]
        if new:
            texts = [w.decode() for w in new]
            ids = self.piece.encode(texts)
            bpe = [len(self.bpe.encode_ordinary(" " + t)) for t in texts]
            for w, t, i, n in zip(new, texts, ids, bpe):
                letters = latin = len(w) - len(w.translate(None, _LETTERS))
                script = len(_NAMES) - 1
                if len(t) != len(w):
                    letters = latin = sum(map(str.isalpha, t))
                    if max(t) >= "\u0250" and (beyond := [c for c in t if c.isalpha() and c >= "\u0250" and not "\u1e00" <= c < "\u1f00"]):
                        latin, script = letters - len(beyond), script_of(beyond)
                cache[w] = (len(t), len(w) - len(w.translate(None, SYMBOLS)), latin, letters - latin, np.array(i, KEPT_ID).tobytes(), n, script)
        out = [cache[w] for w in words]
        for w in new:
            if len(w) > LONG_WORD:
                del cache[w]
            else:
                self.held += len(w)
        return out


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars_piece double, chars_bpe double, byte_share double, entropy double, script string"


def _segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[ends] - total[np.concatenate(([0], ends[:-1]))]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: words inside 3-word windows that occur twice or more in it, the first occurrence included."""
    out = np.zeros(n_docs, np.int64)
    if len(ids) < 3:
        return out
    v = int(ids.max()) + 1
    inside = np.flatnonzero(doc[2:] == doc[:-2])
    if not len(inside):
        return out
    pair = ids[inside] * v + ids[inside + 1]
    if v >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    code = np.unique(pair * v + ids[inside + 2], return_inverse=True)[1]
    key = doc[inside] * (int(code.max()) + 1) + code
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    at = inside[n[back] > 1]
    marked = np.zeros(len(ids), bool)
    marked[at] = marked[at + 1] = marked[at + 2] = True
    np.add.at(out, doc[marked], 1)
    return out


def features_of(texts: list, vocab: Vocabularies) -> dict[str, np.ndarray]:
    """The columns of FEATURES for texts as UTF-8 bytes (None: no words)."""
    index: dict[bytes, int] = {}
    words = [t.split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    for w in dict.fromkeys(chain.from_iterable(words)):
        index[w] = len(index)
    ids = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
    doc = np.repeat(np.arange(len(texts)), n)
    ends = np.cumsum(n)
    facts = vocab.word_facts(list(index))
    chars, symbols, latin, other, n_bpe, code = (np.array([f[i] for f in facts], np.int64) for i in (0, 1, 2, 3, 5, 6))
    pieces = [f[4] for f in facts]
    n_piece = np.array(list(map(len, pieces)), np.int64) // KEPT_ID.itemsize
    flat = np.frombuffer(b"".join(pieces), KEPT_ID).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n_piece)))
    bytes_in = _segments(vocab.is_byte[flat].astype(np.int64), first[1:]) if len(facts) else n_piece

    def per_doc(x):
        return _segments(x[ids], ends) if len(ids) else np.zeros(len(texts), np.int64)

    tokens = per_doc(n_piece)
    # token histogram of every document: the pieces of its words, gathered flat
    sizes = n_piece[ids]
    place = np.repeat(first[:-1][ids] - np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(ids) else np.zeros(0, np.int64), sizes) + np.arange(int(sizes.sum()))
    key, count = np.unique(np.repeat(doc, sizes) * len(vocab.is_byte) + flat[place], return_counts=True)
    owner = key // len(vocab.is_byte)
    share = count / tokens[owner]
    alike = np.bincount(owner, share * share, minlength=len(texts)) if len(key) else np.zeros(len(texts))
    word_chars = per_doc(chars)
    # letters by script, Latin first: of equals the first counts
    letters = np.stack([per_doc(latin), *(per_doc(np.where(code == i, other, 0)) if (code == i).any() and other.any() else np.zeros(len(texts), np.int64) for i in range(len(_NAMES)))])
    script = np.array(("latin", *_NAMES))[letters.argmax(0)]
    dup = np.zeros(len(texts), np.int64)
    for d, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()] if t else []
        dup[d] = len(lines) - len(set(lines))
    some = np.maximum(tokens, 1)
    return {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": per_doc(symbols),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(ids, doc, len(texts)),
        "chars_piece": word_chars / some,
        "chars_bpe": word_chars / np.maximum(per_doc(n_bpe), 1),
        "byte_share": per_doc(bytes_in) / some,
        "entropy": -np.log2(np.where(alike > 0, alike, 1.0)) + 0.0,
        "script": script,
    }


def verdicts(f: dict[str, np.ndarray], bands: dict = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    base_failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    good = np.ones(len(base_failed), bool)
    for script, limits in bands.items():
        inside = np.ones(len(base_failed), bool)
        for name, (low, high) in limits.items():
            inside &= (f[name] >= low) & (f[name] <= high)
        good &= inside | (f["script"] != script)
    return base_failed, good & ~base_failed


def judge_quality(docs: DataFrame, piece_path: str, bpe_path: str, bpe_pattern: str, key: str = "doc_id", text: str = "text", bands: dict = BANDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: key, FEATURES, base_failed, kept.

    Base rules: at least 50 words, and no more than half the words inside repeated 3-word
    windows.  Then the fertility of two public vocabularies (files at the given paths,
    broadcast, of fixed size) must lie in the bands of the text's script.  Every text is
    judged whole, by itself and in place: no shuffle, no corpus-wide state, so a document
    gets one verdict whatever stands beside it.  Both ends of a band belong to it; a text
    with as many letters of two scripts counts for the one that BANDS names first.

    Null and empty texts have no words and fail; an empty table gives no rows; repeated rows
    and null keys stay; extra columns are ignored but for those in `carry` (see map_text).
    """
    with open(piece_path, "rb") as a, open(bpe_path, "rb") as b:
        sent = docs.sparkSession.sparkContext.broadcast((a.read(), b.read(), bpe_pattern))

    def make():
        vocab = Vocabularies(*sent.value)

        def f(ids, texts):
            got = features_of(texts, vocab)
            base_failed, kept = verdicts(got, bands)
            return [pa.array(ids, pa.int64()), *(pa.array(x) for x in got.values()), pa.array(base_failed), pa.array(kept)]

        return f

    return map_text(docs, key, text, f"k long, {FEATURES}, base_failed boolean, kept boolean", make, 1_000_000, carry).withColumnRenamed("k", key)
