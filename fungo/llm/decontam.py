"""Benchmark decontamination with a generalised suffix automaton over word ids."""

from __future__ import annotations

import hashlib
import pickle
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, cut_lineage, list_array, with_fields

#: Letters, digits and every byte of a non-ASCII character stay; A-Z become a-z; all else parts words.
_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c >= 0x80 or c in _KEEP else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased."""
    return text.translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of ints."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # the prefix is known from another sequence
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int, after: dict, link: int = 0) -> int:
        self.next.append(after)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and longest match after reading c."""
        nxt = self.next
        while state and c not in nxt[state]:
            state = self.link[state]
            length = self.len[state]
        to = nxt[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def suffix(self, state: int, length: int) -> int:
        """The state of the suffix of `length` words of what led to `state`."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state


def pack_items(items: list[tuple[str, list[bytes]]], window: int) -> dict:
    """The automaton of `items` (id, words) as plain arrays, and which items each window's state belongs to.

    Transitions and owners are sorted codes, so looking one up is a binary search.
    """
    ids: dict[bytes, int] = {}
    seqs = [(i, [ids.setdefault(w, len(ids)) for w in ws]) for i, ws in items if ws]
    automaton = SuffixAutomaton()
    for _, s in seqs:
        automaton.add(s)
    owners: dict[tuple[int, int], set[str]] = {}
    for i, s in seqs:
        n, state, length = min(window, len(s)), 0, 0
        for c in s:
            state, length = automaton.step(state, length, c)
            if length >= n:
                owners.setdefault((n, automaton.suffix(state, n)), set()).add(i)
    v, n_states = max(1, len(ids)), len(automaton.len)
    steps = np.array([(q * v + c, to) for q, after in enumerate(automaton.next) for c, to in after.items()], np.int64).reshape(-1, 2)
    steps = steps[np.argsort(steps[:, 0])]
    owned = sorted((n * n_states + q, sorted(x)) for (n, q), x in owners.items())
    return {
        "window": window,
        "words": b"\n".join(ids),
        "step": steps[:, 0],
        "to": steps[:, 1].astype(np.int32),
        "link": np.array(automaton.link, np.int32),
        "len": np.array(automaton.len, np.int32),
        "lengths": sorted({min(window, len(s)) for _, s in seqs}),
        "owned": np.array([x for x, _ in owned], np.int64),
        "owners": [x for _, x in owned],
        "pairs": np.unique(np.array([a * v + b for _, s in seqs for a, b in zip(s, s[1:])], np.int64)),
    }


class Benchmark:
    """Matches documents against the arrays of pack_items."""

    def __init__(self, packed: dict):
        words = packed["words"].split(b"\n") if packed["words"] else []
        self.ids = dict(zip(words, range(len(words))))
        self.v, self.n_states = max(1, len(words)), len(packed["len"])
        self.step_codes, self.to, self.pairs = packed["step"], packed["to"], packed["pairs"]
        self.link, self.len = packed["link"].tolist(), packed["len"].tolist()
        self.lengths, self.owned, self.owners = packed["lengths"], packed["owned"], packed["owners"]

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and longest match after reading c."""
        while True:
            code = state * self.v + c
            at = int(self.step_codes.searchsorted(code))
            if at < len(self.step_codes) and self.step_codes[at] == code:
                return int(self.to[at]), length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.len[state]

    def owners_of(self, n: int, state: int) -> list[str]:
        """Items with a window of n words that ends what led to `state`."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        code = n * self.n_states + state
        at = int(self.owned.searchsorted(code))
        return self.owners[at] if at < len(self.owned) and self.owned[at] == code else []

    def runs(self, ids: np.ndarray):
        """Ranges of words long enough to hold a window, all in the vocabulary and every neighbouring pair in some item."""
        if not self.lengths or not len(ids):
            return
        least = self.lengths[0]
        known = ids >= 0
        if least == 1:
            joined = known[1:] & known[:-1]
        else:
            code = ids[:-1] * self.v + ids[1:]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            joined = known[1:] & known[:-1] & (self.pairs[at] == code if len(self.pairs) else False)
        cut = np.flatnonzero(np.concatenate(([True], ~joined, [True])))
        for i in np.flatnonzero((cut[1:] - cut[:-1] >= least) & known[cut[:-1]]):
            yield int(cut[i]), int(cut[i + 1])

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged ranges of words inside any occurrence of a window, and the items whose windows occur."""
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        spans: list[list[int]] = []
        found: set[str] = set()
        for a, b in self.runs(ids):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                state, length = self.step(state, length, c)
                for n in self.lengths:
                    if n > length:
                        break
                    own = self.owners_of(n, state)
                    if own:
                        found.update(own)
                        while spans and spans[-1][0] >= i - n:
                            spans.pop()
                        if spans and spans[-1][1] >= i - n:
                            spans[-1][1] = i
                        else:
                            spans.append([i - n, i])
        return spans, found


def _united(lists: list) -> list:
    """Sorted, merged ranges of all lists."""
    out: list[list[int]] = []
    for x, y in sorted(tuple(r) for ranges in lists for r in ranges):
        if out and out[-1][1] >= x:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def build_index(items: DataFrame, item_key: str, item_text: str, window: int, shard_bytes: int) -> DataFrame:
    """(shard, blob): automata of about `shard_bytes` of item text each, built in tasks; an item larger than that makes a larger shard."""
    rows = items.select(F.coalesce(F.col(item_key).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_shards = max(1, -(-total // shard_bytes))

    def build(table):
        ids, texts = table.column("i").to_pylist(), table.column("t").cast(pa.binary()).to_pylist()
        blob = pickle.dumps(pack_items([(i, words_of(t)) for i, t in sorted(zip(ids, texts), key=lambda x: (x[0], x[1] or b""))], window))
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])

    return rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(build, "shard int, blob binary")


FOUND = "row long, items array<string>, spans array<array<int>>"
OUT = "k long, n_words long, n_hit long, items array<string>, spans array<array<int>>, n_cut long"


def _narrow(numbered: DataFrame, sent) -> DataFrame:
    """What one group of shards finds, for rows that it finds anything in."""

    def run(batches):
        shards = [Benchmark(pickle.loads(b)) for b in sent.value]
        for batch in batches:
            rows, items, spans = [], [], []
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ws = words_of(t)
                got = [s.match(ws) for s in shards]
                if any(x for x, _ in got):
                    rows.append(row)
                    spans.append(_united([x for x, _ in got]))
                    items.append(sorted(set().union(*(y for _, y in got))))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), list_array(items, pa.string()), list_array(spans, pa.list_(pa.int32()))], names=["row", "items", "spans"])

    return numbered.select("row", "t").mapInArrow(run, FOUND)


def find_contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 13, cut_words: int | None = None, shard_bytes: int = 1_000_000, max_index_mb: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of `docs`: key, n_words, n_hit, items (ids as strings, sorted), spans (word ranges [start, end)), n_cut.

    A window is `window` consecutive words of an item (all its words, if fewer); a word of a
    document is hit inside any occurrence of one.  The items, lower-cased and cut to words,
    form generalised suffix automata, one to about `shard_bytes` of their text, built in
    tasks; documents stream through them where they are and are never shuffled.  Only
    stretches whose every neighbouring word pair occurs in an item, and long enough for a
    window, are streamed: nothing else can reach one.

    The arrays of all automata are broadcast while they take `max_index_mb` as measured on
    the built table.  Beyond, shards go out in groups of that size; each group reads the
    texts once and writes only what it finds, and the narrow findings are joined to the
    documents at the end.

    With `cut_words`, a column `text` follows: the text without the spans of at least so many
    words (n_cut words in all); without it n_cut is 0.

    Null or empty text has no words; items without words match nothing; an empty benchmark
    hits nothing; items that repeat are all reported; repeated and null keys stay as rows;
    texts are whole, of any length; extra columns are ignored but for those in `carry` (see
    common.map_text).
    """
    spark = docs.sparkSession
    index = cut_lineage(build_index(items, item_key, item_text, window, shard_bytes))
    groups: list[list[int]] = [[]]
    room = max_index_mb << 20
    for shard, size in sorted(map(tuple, index.select("shard", F.octet_length("blob")).collect())):
        if groups[-1] and room < size:
            groups.append([])
            room = max_index_mb << 20
        groups[-1].append(shard)
        room -= size

    def broadcast(shards):
        return spark.sparkContext.broadcast([r[0] for r in index.filter(F.col("shard").isin(shards)).orderBy("shard").select("blob").collect()])

    columns, more = carried(docs, carry)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), *columns)
    beside = [f"_c{i}" for i in range(len(carry))]
    if len(groups) == 1:
        rows = rows.withColumns({"items": F.lit(None).cast("array<array<string>>"), "spans": F.lit(None).cast("array<array<array<int>>>")})
    else:
        numbered = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
        parts = []
        for shards in groups[:-1]:
            sent = broadcast(shards)
            parts.append(cut_lineage(_narrow(numbered, sent)))
            sent.unpersist()
        found = reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.collect_list("items").alias("items"), F.collect_list("spans").alias("spans"))
        rows = numbered.join(found, "row", "left").drop("row")
    sent = broadcast(groups[-1])
    out = OUT + ("" if cut_words is None else ", text string")

    def run(batches):
        shards = [Benchmark(pickle.loads(b)) for b in sent.value]
        for batch in batches:
            n, hit, items, spans, n_cut, texts = [], [], [], [], [], []
            for t, old_items, old_spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ws = words_of(t)
                got = [s.match(ws) for s in shards]
                united = _united([*(x for x, _ in got), *(old_spans or ())])
                n.append(len(ws))
                hit.append(sum(y - x for x, y in united))
                items.append(sorted(set().union(*(y for _, y in got), *(old_items or ()))))
                spans.append(united)
                away = [r for r in united if cut_words is not None and r[1] - r[0] >= cut_words]
                n_cut.append(sum(y - x for x, y in away))
                texts.append(without_spans(t, away) if away else t)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), list_array(items, pa.string()), list_array(spans, pa.list_(pa.int32())), pa.array(n_cut, pa.int64())]
            if cut_words is not None:
                cols.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[4:]], names=[*(x.split()[0] for x in out.split(", ")), *beside])

    return rows.select("k", "t", "items", "spans", *beside).mapInArrow(run, with_fields(out, more)).withColumnRenamed("k", key)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, cut_words: int = 13, min_share_of: int = 20, **more) -> DataFrame:
    """The columns of `docs` without what is in the benchmark, by two limits.

    Coverage: a document whose hit words make 1/`min_share_of` of it or more goes (see
    contaminated).  Length: in the others, spans of at least `cut_words` hit words are cut
    from the text, and column `length`, if named, becomes the new text's code points; a
    document without such a span stays as it is.  Null and empty texts, repeated rows and
    null keys stay; empty tables give all of `docs`.  Further columns of any name stay as they are.
    """
    names = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    carry = tuple(d for c, d in names.items() if c != text)
    out = find_contamination(plain.withColumn("_key", F.col(names[key])), items, "_key", names[text], cut_words=cut_words, carry=carry, **more).filter(~contaminated(min_share_of=min_share_of))
    beside = {d: F.col(f"_c{i}") for i, d in enumerate(carry)} | {names[text]: F.col("text")}
    if length is not None:
        at = names[length]
        beside[at] = F.when(F.col("n_cut") > 0, F.char_length("text").cast(docs.schema[length].dataType)).otherwise(beside[at])
    return out.select(*(beside[d].alias(c) for c, d in names.items()))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", min_share_of: int = 20):
    """At least one hit word, and hit words make 1/min_share_of of the document or more."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * min_share_of >= F.col(n_words))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def without_spans(text: bytes, spans: list) -> bytes:
    """The text without the bytes from each span's first word to its last; `spans` are word ranges as found above."""
    if not spans:
        return text
    flat = text.translate(_TABLE)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])
