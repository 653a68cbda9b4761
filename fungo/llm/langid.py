"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: n-gram lengths and buckets of the hashed feature space.
GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Bucket numbers of all n-grams of a list of texts, and the text each belongs to."""

    def __init__(self):
        self.letters = _letters()

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, text numbers, letters of each text); letters are lower-cased, runs of anything else become one space."""
        flat = "".join((t or b"").decode().lower().replace("\n", " ") + "\n" for t in texts)
        c = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        ends = c == 10
        letter = self.letters[c]
        owner = np.cumsum(ends)
        owner[ends] -= 1
        n_letters = np.bincount(owner[letter], minlength=len(texts)) if len(c) else np.zeros(len(texts), np.int64)
        keep = letter | ends
        keep[1:] |= letter[:-1]  # the first of a run of others stays as the space after a word
        c, owner, letter = c[keep], owner[keep], letter[keep]
        c = np.where(letter, c, 32).astype(np.uint64)
        buckets, docs = [], []
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            inside = owner[n - 1 :] == owner[: len(c) - n + 1]
            some = np.zeros(len(h), bool)
            for i in range(n):
                h = (h ^ c[i : i + len(h)]) * _MIX
                some |= letter[i : i + len(h)]
            use = inside & some
            buckets.append((h[use] >> np.uint64(64 - 15)).astype(np.int64))
            docs.append(owner[: len(h)][use])
        if not buckets:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n_letters
        return np.concatenate(buckets), np.concatenate(docs), n_letters


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 4000, smoothing: float = 0.5, max_matrix_mb: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (language x bucket), from the labelled rows of `docs`.

    A bounded sample teaches it: about `max_docs` whole texts a language, drawn by a hash of
    the key at a rate that follows from the language's count (all, where there are fewer).
    Counts are summed on Spark; what reaches the driver is one number per language and
    bucket, whatever the input's size.  Every language is learnt; should there be so many
    that the matrix outgrows `max_matrix_mb` (some 2,000), an error says so.
    """
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sizes = labelled.groupBy("l").count()
    most = (max_matrix_mb << 20) // (4 * BUCKETS)
    sizes = sizes.limit(most + 1).collect()
    if not sizes:
        return [], np.zeros((0, BUCKETS))
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: their matrix would exceed {max_matrix_mb} MB; raise max_matrix_mb")
    names = sorted(r["l"] for r in sizes)
    rate = {r["l"]: min(1.0, max_docs / r["count"]) for r in sizes}
    rates = F.create_map(*(x for n in names for x in (F.lit(n), F.lit(rate[n]))))
    place = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i).cast("long"))))
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = labelled.filter(draw < F.element_at(rates, F.col("l"))).select(F.element_at(place, F.col("l")).alias("n"), "t")

    def counted(batches):
        grams, total = Grams(), np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                where = np.array(part.column(0).to_pylist(), np.int64)
                b, d, _ = grams.of(part.column(1).cast(pa.binary()).to_pylist())
                total += np.bincount(where[d] * BUCKETS + b, minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["n", "bucket", "c"])

    sums = drawn.mapInArrow(counted, "n int, bucket int, c long").groupBy("n", "bucket").agg(F.sum("c").alias("c")).toArrow()
    counts = np.full((len(names), BUCKETS), smoothing)
    counts[sums["n"].to_numpy(), sums["bucket"].to_numpy()] += sums["c"].to_numpy()
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], log_p: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the likeliest language of every whole text and its posterior under equal priors.

    The posterior takes n-grams for independent, so that it is near 1 for all but short or
    mixed texts: it ranks doubtful texts, it is no measured share of right answers.

    The matrix (128 kB a language) is broadcast; a slice's n-grams are looked up sparsely and
    summed by text.  Null text and text without a letter give `und` with score 0, as does a
    model without languages; ties go to the name that sorts first.
    """
    sent = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(log_p.T)))

    def make():
        known, table = sent.value
        grams = Grams()
        labels = np.array([*known, "und"], object)

        def f(ids, texts):
            b, d, letters = grams.of(texts)
            out, score = np.full(len(texts), len(known)), np.zeros(len(texts))
            if known and len(b):
                total = np.stack([np.bincount(d, table[b, i], minlength=len(texts)) for i in range(len(known))], 1)
                best = total.argmax(1)
                post = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                out, score = np.where(letters > 0, best, out), np.where(letters > 0, post, 0.0)
            return [pa.array(ids, pa.int64()), pa.array(labels[out].tolist(), pa.string()), pa.array(score)]

        return f

    return map_text(docs, key, text, "k long, lang_pred string, score double", make, 1_000_000).withColumnRenamed("k", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_out_mod: int = 3, held_out: int = 1) -> DataFrame:
    """(key, held_out, lang_pred, score), learnt from rows whose crc32(key as text) mod `held_out_mod` is not `held_out`.

    The language column is read for teaching only.  Null keys count as taught rows (their
    remainder is null); an empty table gives no rows; repeated rows stay.
    """
    out = F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % held_out_mod == held_out, F.lit(False))
    names, log_p = train(docs.filter(~out), key, text, lang)
    found = predict(docs, names, log_p, key, text)
    return found.select(key, out.alias("held_out"), "lang_pred", "score")
