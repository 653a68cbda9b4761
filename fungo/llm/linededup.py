"""Line dedup: frequent lines in a sharded minimal perfect hash that documents probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, WHITE, carried, cut_lineage, map_text, with_fields

#: Distinct keys a shard of the index holds on average.
SHARD_KEYS = 100_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without ASCII white space at its ends, A-Z in lower case; None if shorter than `min_chars` code points."""
    k = line.strip(WHITE).lower()
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode()) < min_chars):
        return None
    return k


def hash_keys(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes as two unsigned words a row."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)


def _mix(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x = h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def build_mph(h: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash (hash, displace) for distinct words `h`.

    Buckets of about four keys take, largest first, the first displacement that puts
    their keys on free slots; a bucket of one key names a free slot itself (negative).
    """
    n = len(h)
    n_buckets = max(1, (n + 3) // 4)
    bucket = (_mix(h, np.zeros(n)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    ends = np.cumsum(sizes)
    free = np.ones(n, bool)
    displace = np.zeros(n_buckets, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    tries = np.arange(1, 33, dtype=np.uint64)
    for b in by_size:
        k = sizes[b]
        if k < 2:
            break
        mine = h[order[ends[b] - k : ends[b]]]
        base = np.uint64(0)
        while True:
            slots = (_mix(mine[None, :], (tries + base)[:, None]) % np.uint64(n)).astype(np.int64)
            s = np.sort(slots, axis=1)
            ok = free[slots].all(1) & (s[:, 1:] != s[:, :-1]).all(1)
            if ok.any():
                i = int(ok.argmax())
                displace[b] = int(tries[i] + base)
                free[slots[i]] = False
                break
            base += np.uint64(32)
            if base > 1 << 24:
                raise ValueError("two keys of the index share all hash bits")
    single = by_size[sizes[by_size] == 1]
    displace[single] = -np.flatnonzero(free)[: len(single)] - 1
    return displace


def mph_slots(h: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """The slot of each word; for a word outside the set, some slot."""
    bucket = (_mix(h, np.zeros(len(h))) % np.uint64(len(displace))).astype(np.int64)
    d = displace[bucket]
    slots = (_mix(h, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -d - 1, slots)


def _word(a: np.ndarray, b: np.ndarray, mix: int) -> np.ndarray:
    """The word that places a key of two hash words; another for each `mix`."""
    return a ^ (b >> np.uint64(mix))


INDEX_SCHEMA = "shard int, n int, mix int, displace binary, finger binary, count binary, keeper binary"


def build_index(frequent: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: displacements and, by slot, 64-bit fingerprint, count and keeper.

    Keys are dealt by their hash, so shards hold about SHARD_KEYS distinct keys each
    whatever the lines look like.  Should two keys of a shard share the word that places
    them, the next mix of their two hash words is taken.
    """

    def build(pdf):
        import pandas as pd

        a, b = pdf["h1"].to_numpy().view(np.uint64), pdf["h2"].to_numpy().view(np.uint64)
        mix, n = next(m for m in range(1, 64) if len(np.unique(_word(a, b, m))) == len(a)), len(a)
        displace = build_mph(_word(a, b, mix))
        slot = mph_slots(_word(a, b, mix), displace, n)
        finger, count, keeper = np.zeros(n, np.uint64), np.zeros(n, np.uint32), np.zeros(n, np.int64)
        finger[slot], count[slot], keeper[slot] = b, np.minimum(pdf["n_docs"], 2**32 - 1), pdf["keeper"]
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), n, mix, displace.astype("<i8").tobytes(), finger.astype("<u8").tobytes(), count.astype("<u4").tobytes(), keeper.astype("<i8").tobytes())], columns=["shard", "n", "mix", "displace", "finger", "count", "keeper"])

    return frequent.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


class LineIndex:
    """Probes shards; `load` takes the rows of build_index."""

    def __init__(self, rows: list, n_shards: int):
        self.n_shards = n_shards
        self.shards = {r[0]: (r[1], r[2], np.frombuffer(r[3], "<i8"), np.frombuffer(r[4], "<u8"), np.frombuffer(r[6], "<i8")) for r in rows}

    def keepers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash pair: whether it is a frequent line, and the document that keeps it."""
        hit, keeper = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        shard = np.mod(h[:, 0].view(np.int64), self.n_shards)
        for s in np.unique(shard):
            if s in self.shards:
                at = np.flatnonzero(shard == s)
                n, mix, displace, finger, keep = self.shards[s]
                slot = mph_slots(_word(h[at, 0], h[at, 1], mix), displace, n)
                hit[at], keeper[at] = finger[slot] == h[at, 1], keep[slot]
        return hit, keeper


def _keyed(texts: list, min_chars: int) -> Iterator[tuple[int, int, bytes]]:
    for d, t in enumerate(texts):
        for i, line in enumerate((t or b"").split(b"\n")):
            if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None:
                yield d, i, k


def line_hashes(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, whole) once per row and distinct line key; `whole` is xxhash64 of the row's text."""

    def make():
        def f(ids, texts):
            found = list(dict.fromkeys((d, k) for d, _, k in _keyed(texts, min_chars)))
            h = hash_keys([k for _, k in found]).view(np.int64)
            of = [xxhash.xxh64_intdigest(t or b"", 42) for t in texts]
            whole = np.array([of[d] for d, _ in found], np.uint64).view(np.int64)
            return [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([ids[d] for d, _ in found], pa.int64()), pa.array(whole)]

        return f

    return map_text(docs, key, text, "h1 long, h2 long, doc long, whole long", make)


def _rebuild(ids: list, texts: list, min_chars: int, dropped) -> list:
    """Columns key, text, n_lines, n_dropped; `dropped(ids, d, h)` tells which keyed lines go."""
    at = list(_keyed(texts, min_chars))
    goes = dropped(np.array([d for d, _, _ in at], np.int64), hash_keys([k for *_, k in at])) if at else []
    out: dict[int, set[int]] = {}
    for (d, i, _), x in zip(at, goes):
        if x:
            out.setdefault(d, set()).add(i)
    kept, n_lines, n_dropped = [], [], []
    for d, t in enumerate(texts):
        lines = (t or b"").split(b"\n")
        gone = out.get(d)
        kept.append(None if t is None else t if not gone else b"\n".join(x for i, x in enumerate(lines) if i not in gone))
        n_lines.append(len(lines))
        n_dropped.append(len(gone or ()))
    return [pa.array(ids, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]


OUT = "k long, text string, n_lines long, n_dropped long"


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, max_index_mb: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops repeated lines: (key, text, n_lines, n_dropped), one row per input row.

    A line's key (see line_key) of at least `min_chars` code points that `min_docs`
    documents hold loses all its lines but those in the largest document holding it.  Counts
    and keepers of the frequent keys sit in a sharded minimal perfect hash (build_index);
    documents probe it where they are, so texts are never shuffled.  Fingerprints have 64
    bits beside the 64 that choose the slot.

    The index is broadcast while it takes at most `max_index_mb`, as measured on the
    built table; beyond that, line hashes go to the shard they belong to, in one exchange,
    and only hits go back to the texts (probe_by_shard).

    A document is a key: rows that repeat one count once, and all rows of the keeping key
    keep the line.  Rows without a key count as one document together, which never keeps (a
    line that only such rows hold stays).  Null or empty text is one empty line (null stays
    null); an empty table gives no rows; texts are whole, of any length.  Extra columns are
    ignored but for those in `carry` (see map_text).
    """
    spark = docs.sparkSession
    held = line_hashes(docs, key, text, min_chars).select("h1", "h2", "doc").distinct()
    counts = held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
    frequent = cut_lineage(counts.filter((F.col("n_docs") >= min_docs) & F.col("keeper").isNotNull()))
    n_shards = max(1, -(-frequent.count() // SHARD_KEYS))
    index = cut_lineage(build_index(frequent, n_shards))
    size = index.agg(F.coalesce(F.sum(sum(F.octet_length(c) for c in ("displace", "finger", "count", "keeper"))), F.lit(0))).first()[0]
    if size <= max_index_mb << 20:
        return probe_documents(docs, spark.sparkContext.broadcast([tuple(r) for r in index.collect()]), n_shards, key, text, min_chars, carry).withColumnRenamed("k", key)
    return probe_by_shard(docs, frequent, index, n_shards, key, text, min_chars, carry).withColumnRenamed("k", key)


def probe_documents(docs: DataFrame, rows, n_shards: int, key: str, text: str, min_chars: int, carry: tuple[str, ...] = ()) -> DataFrame:
    def make():
        index = LineIndex(rows.value, n_shards)

        def f(ids, texts):
            own = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)

            def dropped(d, h):
                hit, keeper = index.keepers(h)
                return hit & (keeper != own[d])

            return _rebuild(ids, texts, min_chars, dropped)

        return f

    return map_text(docs, key, text, OUT, make, carry=carry)


def probe_by_shard(docs: DataFrame, frequent: DataFrame, index: DataFrame, n_shards: int, key: str, text: str, min_chars: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """For an index beyond the broadcast bound: each shard of it streams past the line hashes that belong to it.

    Shards and hashes are exchanged once; a task sorts them so that a shard's arrays come
    before its hashes, and holds one shard at a time.  Lines that more than one of HOT_SHARE
    of all hits belong to, fewer than HOT_SHARE lines, would crowd their shard: they are
    joined by broadcast instead.
    """
    hashes = cut_lineage(line_hashes(docs, key, text, min_chars))
    total = frequent.agg(F.sum("n_docs")).first()[0]
    hot = F.broadcast(frequent.filter(F.col("n_docs") * HOT_SHARE > total).select("h1", "h2", "keeper"))
    goes = F.col("doc").isNull() | (F.col("doc") != F.col("keeper"))
    common = hashes.join(hot, ["h1", "h2"]).filter(goes).select("h1", "doc", "whole")
    seldom = hashes.join(hot, ["h1", "h2"], "left_anti").select(F.pmod("h1", F.lit(n_shards)).cast("int").alias("shard"), F.lit(1).alias("kind"), "h1", "h2", "doc", "whole")
    arrays = [c for c in INDEX_SCHEMA.split(", ") if not c.startswith("shard")]
    dealt = index.withColumn("kind", F.lit(0)).unionByName(seldom, allowMissingColumns=True).select("shard", "kind", "h1", "h2", "doc", "whole", *(c.split()[0] for c in arrays))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "kind")

    def probe(batches):
        at, shard = None, -1
        for b in batches:
            shards, kinds = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            heads = np.flatnonzero(kinds == 0).tolist()
            for start, end in zip([-1, *heads], [*heads, len(kinds)]):
                if start >= 0:
                    shard = int(shards[start])
                    at = LineIndex([(shard, *(b.column(6 + i)[start].as_py() for i in range(len(arrays))))], n_shards)
                part = b.slice(start + 1, end - start - 1)
                part = part.filter(pa.array(part.column(0).to_numpy(zero_copy_only=False) == shard))
                if part.num_rows:
                    hit, keeper = at.keepers(np.stack([part.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3)], 1))
                    own = part.column(4).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                    yield part.select([2, 4, 5]).filter(pa.array(hit & (keeper != own)))

    drops = dealt.mapInArrow(probe, "h1 long, doc long, whole long").unionByName(common)
    lists = drops.groupBy(F.col("doc").alias("_doc"), F.col("whole").alias("_whole")).agg(F.collect_set("h1").alias("_gone"))  # the lines of one text at most
    columns, more = carried(docs, carry)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("w"), *columns)
    joined = rows.join(lists, F.col("k").eqNullSafe(F.col("_doc")) & (F.col("w") == F.col("_whole")), "left").select("k", "t", "_gone", *(f"_c{i}" for i in range(len(carry))))

    def rebuild(batches):
        for b in batches:
            ids, texts, gone = b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()
            sets = [frozenset(x or ()) for x in gone]
            cols = _rebuild(ids, texts, min_chars, lambda d, h: [int(x) in sets[i] for i, x in zip(d, h[:, 0].view(np.int64))])
            yield pa.RecordBatch.from_arrays([*cols, *b.columns[3:]], names=["k", "text", "n_lines", "n_dropped", *(f"_c{i}" for i in range(len(carry)))])

    return joined.mapInArrow(rebuild, with_fields(OUT, more))
