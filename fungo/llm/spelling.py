"""Spelling variants: sorted permuterm rotations, whose prefix ranges skip one edited character."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_text

#: Words of the contract: Latin letters, of which only A-Z have their case folded.
LETTERS = "A-Za-zÀ-ÿ"
#: Stands behind a word's last letter; no word holds it.
END = "$"
#: Rotations of longer words are named by their beginning and a fingerprint, as all of them written out would take the square of the word's length.
LONG_WORD = 64
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1F123BB97F4A7C15F39CC06 % ((1 << 127) - 1)


def words_of(ids: list, texts: list, min_chars: int, typo_every: int | None) -> Counter:
    """Occurrences of words of at least `min_chars` code points in texts (UTF-8 bytes or None).

    With `typo_every`, a run whose crc32 of `<id>:<run>` it divides loses one code point (see count_words).
    """
    run = re.compile(f"[{LETTERS}]{{{min_chars},}}")
    fold = {c: c + 32 for c in range(65, 91)}
    found: Counter = Counter()
    for i, t in zip(ids, texts):
        if not t:
            continue
        own = Counter(run.findall(t.decode().translate(fold)))
        if typo_every:
            start = zlib.crc32(f"{'' if i is None else i}:".encode())
            for w, n in list(own.items()):
                h = zlib.crc32(w.encode(), start)
                if h % typo_every == 0:
                    del own[w]
                    at = h % len(w)
                    if len(w) > min_chars:
                        found[w[:at] + w[at + 1 :]] += n
        found.update(own)
    return found


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 6, min_n: int = 5, typo_every: int | None = None, held: int = 200_000) -> DataFrame:
    """(word, n): words of at least `min_chars` code points that occur `min_n` times or more in all texts.

    Words are the longest runs of Latin letters, A-Z in lower case.  `typo_every` plants typos
    for measuring: a run whose crc32 h of UTF-8 `<key>:<run>` (unsigned) it divides loses the
    code point h % length; all occurrences of a run in a document share that fate.  Tasks
    count up to about `held` distinct words before they hand them on; the exchange is of
    counts, so a frequent word is one row a task.
    """

    def run(batches):
        found: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()

        for batch in batches:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for i, k in enumerate(ids):
                found.update(words_of([k], [blobs[i].as_py()], min_chars, typo_every))
                if len(found) > held:
                    yield from flush()
        yield from flush()

    counted = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_n)


def rotations(word: str) -> tuple[list[str], list[str], list[bool]]:
    """Permuterm keys of word + END.

    First, all rotations that begin behind a gap: for each place i from 0 to the length,
    what stands from i on, END, what stands before.  Second, the same with the letter at i
    left out (the rotation from i + 1 on without its last letter, the edited one): words
    that share such a key differ in that letter alone, and a word whose whole rotation
    it is lacks that letter.  Third, whether the letter differs from the one before it: of a
    run of equal letters only the first counts as left out, so a shorter word is met once.
    """
    n = len(word)
    first = [i == 0 or word[i] != word[i - 1] for i in range(n)]
    if n <= LONG_WORD:
        return [word[i:] + END + word[:i] for i in range(n + 1)], [word[i + 1 :] + END + word[:i] for i in range(n)], first
    # fingerprints of beginnings and ends, by polynomials: the value of a rotation is put together from both
    power, before = [1], [0]
    for c in word:
        power.append(power[-1] * _BASE % _PRIME)
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)

    def name(start: int, stop: int) -> str:
        """The rotation word[start:] END word[:stop]."""
        end = (before[n] - before[start] * power[n - start]) % _PRIME
        value = ((end * _BASE + ord(END)) * power[stop] + before[stop]) % _PRIME
        return f"{(word[start : start + LONG_WORD] + END + word[:stop])[:LONG_WORD]}{END}{n - start + stop}{END}{value:x}"

    return [name(i, i) for i in range(n + 1)], [name(i + 1, i) for i in range(n)], first


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): per word of `words` (word, n) that has any, its near words' number and the one of largest n (ties: smallest).

    Two words are near if one inserted, deleted or replaced code point makes one of the other.
    All rotations are dealt by ranges and sorted once; the range of one prefix holds the word
    whose whole rotation it is and those with one more letter, so no more rows than there are
    letters and one.  A scan gives every member the rest's number and best; each pair of near
    words meets in one range only.  A word's rows are then added up.
    """
    columns = "key string, word string, n long, kind int"

    def turn(batches):
        for batch in batches:
            names, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(names), 2000):
                keys, of, kinds = [], [], []
                for i, w in enumerate(names[a : a + 2000], a):
                    whole, gaps, first = rotations(w)
                    keys += whole + gaps
                    of += [i] * (len(whole) + len(gaps))
                    kinds += [0] * len(whole) + [1 if x else 2 for x in first]
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array(kinds, pa.int32())], names=["key", "word", "n", "kind"])

    rows = cut_lineage(words.select("word", "n").mapInArrow(turn, columns))
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key", "kind")

    def met(group: list) -> list:
        """Members are (kind, word, n); kind 0 is the shorter word, 2 does not meet it."""
        out = []
        ranked = sorted(group, key=lambda m: (-m[2], m[1]))
        for kind, word, _ in group:
            others = [m for m in ranked if m[1] != word and (kind > 0 or m[0] != 2) and not (kind == 2 and m[0] == 0)]
            if others:
                out.append((word, len(others), others[0][2], others[0][1]))
        return out

    def scan(batches):
        kept = None
        for batch in batches:
            batch = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0)
            changes = np.flatnonzero(key.slice(1).to_numpy(zero_copy_only=False) != key.slice(0, len(key) - 1).to_numpy(zero_copy_only=False)) + 1 if len(key) else np.zeros(0, np.int64)
            last = int(changes[-1]) if len(changes) else 0
            yield out_of(batch, np.concatenate(([0], changes[:-1])) if last else changes[:0], changes)
            kept = batch.slice(last)
        if kept is not None and kept.num_rows:
            yield out_of(kept, np.array([0]), np.array([kept.num_rows]))

    def out_of(batch, starts, stops):
        several = np.flatnonzero(stops - starts > 1)
        found = []
        for a, b in zip(starts[several].tolist(), stops[several].tolist()):
            found += met(list(zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in (3, 1, 2)))))
        cols = list(zip(*found)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    partial = dealt.mapInArrow(scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the last of each word's forms; `forms` (word, form) has one row a word, and no circles.

    Each round halves the way: a word's form is replaced by that form's own.  Words at their
    root leave, so the rows that meet under one form are those still on the way.
    """
    steps, done = forms.select("word", F.col("form").alias("root")), None
    while True:
        onward = steps.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        moved = cut_lineage(steps.join(onward, steps["root"] == onward["_from"], "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("on")))
        here = moved.filter("not on").select("word", "root")
        if moved.filter("on").isEmpty():
            return here if done is None else done.unionAll(here)
        steps = moved.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 6, min_n: int = 5, times: int = 5, typo_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every counted word, the word it is taken to be a variant of, and the last of these.

    A word's form is its near word (see near_words) of largest n, of ties the smallest by
    code points, if that is at least `times` the word's own n; else null.  root follows forms
    to the end.  Forms have several times the n, so there are no circles and few steps.

    Null and empty texts have no words; repeated rows count each time; null keys stand as
    nothing before the colon of the planted typos; an empty table gives no rows; texts and
    words are whole, of any length (keys of words beyond LONG_WORD letters are 127-bit
    fingerprints); extra columns of any name are ignored.
    """
    words = cut_lineage(count_words(docs, key, text, min_chars, min_n, typo_every))
    near = cut_lineage(near_words(words))
    known = cut_lineage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("best_n") >= times * F.col("n"), F.col(c)).alias(a) for c, a in (("best", "form"), ("best_n", "form_n")))))
    roots = follow(known.filter(F.col("form").isNotNull()))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
