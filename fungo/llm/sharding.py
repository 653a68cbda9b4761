"""Histogram sort: documents in equal-byte shards from exact counts, with one exchange."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import carried, cut_lineage, uncarried

KEYS = ("_k0", "_k1", "_k2")
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


@dataclass
class Bracket:
    """A run of sort keys that still holds some wanted boundary: `fixed` leading key parts and a range of the next one."""

    fixed: tuple
    low: int
    high: int
    bytes_below: int = 0
    rows_below: int = 0
    targets: list = field(default_factory=list)

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - self.bits)

    bits: int = 16

    def holds(self) -> Column:
        part = F.col(KEYS[len(self.fixed)])
        same = [F.col(k) == F.lit(v) for k, v in zip(KEYS, self.fixed)]
        return reduce(lambda a, b: a & b, [*same, part.between(F.lit(self.low), F.lit(self.high))])

    def probe(self) -> Column:
        part = F.col(KEYS[len(self.fixed)])
        return F.shiftright(part, self.shift) - F.lit(self.low >> self.shift)


@dataclass
class Splitter:
    """Keys from `key` upwards lie behind the boundary."""

    key: tuple
    bytes_below: int
    rows_below: int


def _partition(splitters: list[Splitter]) -> Column:
    """Number of splitters at or below a row's key.

    By the leading bits of the first key part, a table gives how many splitters lie below all
    rows with these bits, and how many among them; only those few are compared.
    """
    if not splitters:
        return F.lit(0)
    keys = sorted((*s.key, *(_FIRST,) * (len(KEYS) - len(s.key))) for s in splitters)
    shift = max(0, 63 - max(4, len(keys).bit_length() + 2))
    below = [0] * ((_LAST >> shift) + 2)
    for k in keys:
        below[(k[0] >> shift) + 1] += 1
    for i in range(1, len(below)):
        below[i] += below[i - 1]
    sorted_keys = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(KEYS, k))) for k in keys))
    table, bin_ = F.array(*map(F.lit, below)), F.shiftright(F.col(KEYS[0]), shift).cast("int") + 1
    before, to = F.element_at(table, bin_), F.element_at(table, bin_ + 1)
    mine = F.struct(*(F.col(k) for k in KEYS))
    return (before + F.size(F.filter(F.slice(sorted_keys, before + 1, to - before), lambda k: k <= mine))).cast("int")


def find_splitters(rows: DataFrame, targets: list[tuple[Fraction, float]], max_bins: int = 1 << 16) -> list[Splitter]:
    """Splitters whose exact bytes-below meet each (target, tolerance).

    Every round counts bytes and rows between equally spaced candidate boundaries of
    all brackets that still hold a target (one grouped sum of at most about `max_bins`
    rows), accepts the candidates within tolerance and narrows the brackets of the
    rest to the bin around the target.  A bin whose keys are all equal goes on with the
    next part of the key, so a text that a third of the rows share is split by doc_id.
    """
    found: list[Splitter | None] = [None] * len(targets)
    brackets = [Bracket((), 0, _LAST, targets=list(range(len(targets))))]
    while brackets:
        bits = max(1, (max_bins // len(brackets)).bit_length() - 1)
        for b in brackets:
            b.bits = bits
        which = reduce(lambda c, ib: c.when(ib[1].holds(), F.struct(F.lit(ib[0]).alias("b"), ib[1].probe().alias("p"))), enumerate(brackets), F)
        bounds = [x for k in KEYS for x in (F.min(k).alias(f"lo{k}"), F.max(k).alias(f"hi{k}"))]
        bins = rows.withColumn("_at", which).filter("_at is not null").groupBy("_at.b", "_at.p").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n"), *bounds).collect()
        narrower = []
        for i, b in enumerate(brackets):
            mine = sorted((r for r in bins if r["b"] == i), key=lambda r: r["p"])
            below, n_below, at = b.bytes_below, b.rows_below, 0
            for t in sorted(b.targets, key=lambda t: targets[t][0]):
                want, slack = targets[t]
                while at < len(mine) and below + mine[at]["bytes"] <= want:
                    below, n_below, at = below + mine[at]["bytes"], n_below + mine[at]["n"], at + 1
                if at == len(mine):  # nothing behind: the boundary is the end of the bracket
                    end = (b.high + 1,) if b.high < _LAST else (_LAST,) * (len(KEYS) - len(b.fixed))  # no row has the last place
                    found[t] = Splitter((*b.fixed, *end), below, n_below)
                    continue
                r, depth = mine[at], len(b.fixed)
                under, over = want - below, below + r["bytes"] - want
                single = r["n"] == 1 or all(r[f"lo{k}"] == r[f"hi{k}"] for k in KEYS)
                if min(under, over) <= slack or single:
                    found[t] = Splitter((*b.fixed, r[f"lo{KEYS[depth]}"]), below, n_below) if under <= over or r[f"hi{KEYS[depth]}"] == _LAST else Splitter((*b.fixed, r[f"hi{KEYS[depth]}"] + 1), below + r["bytes"], n_below + r["n"])
                    continue
                fixed = b.fixed
                while r[f"lo{KEYS[len(fixed)]}"] == r[f"hi{KEYS[len(fixed)]}"]:
                    fixed = (*fixed, r[f"lo{KEYS[len(fixed)]}"])
                nxt = next((x for x in narrower if x.fixed == fixed and x.low == r[f"lo{KEYS[len(fixed)]}"]), None)
                if nxt is None:
                    nxt = Bracket(fixed, r[f"lo{KEYS[len(fixed)]}"], r[f"hi{KEYS[len(fixed)]}"], below, n_below)
                    narrower.append(nxt)
                nxt.targets.append(t)
        brackets = narrower
    return found  # type: ignore[return-value]


def shard_digest(key: str = "doc_id", text: str = "text", shard: str = "shard", slot: str = "slot") -> list[Column]:
    """Columns that say where a document lies and what it holds, from the document itself."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col(shard).alias("shard"),
        F.col(slot).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    ]


def histogram_shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.0, parts_per_shard: int | None = None, part_mb: int = 256, max_parts: int = 16_384, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deals documents into `n_shards` shards of near equal bytes, sorted by (MD5 of the text, key).

    Law `bytes`: a shard's share of the sum of (UTF-8 bytes of the text + 1) differs from
    1/n_shards by no more than `tolerance` of a shard at each end, or by half a row where
    one row is larger; by default each boundary is the one next to the exact share.  Equal
    texts are neighbours in the order and part only where a boundary falls among them.
    Every shard is sorted as `parts_per_shard` ranges (default: what
    spark.sql.shuffle.partitions and `part_mb` a range call for, `max_parts` ranges in all,
    beyond which ranges grow and their sorts spill), so no shard has to fit one task; ranges
    meet a quarter of their own size.

    Rows are written once, so that a row's place stays the same; the rounds read narrow
    columns of that, and whole documents are exchanged, once.  Null text counts no bytes
    and has checksum 0; an empty table gives no rows; repeated rows are told apart by their
    place in the input; of two boundaries as near to a share the lower is taken; texts are
    whole, of any length; extra columns are ignored but for those in `carry` (see map_text).
    Null keys sort first.  Returns the columns of shard_digest (slot: gapless from 0 in each
    shard, in sort order; grown_shard is null: `bytes` promises nothing about more shards)
    and the text, and _c0, _c1 and so on.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(key).cast("long").alias("_id"),
            F.col(text).alias("_text"),
            (F.octet_length(body).cast("long") + 1).alias("_size"),
            F.conv(F.substring(F.md5(F.encode(body, "UTF-8")), 1, 15), 16, 10).cast("long").alias("_k0"),
            F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("_k1"),
            F.monotonically_increasing_id().alias("_k2"),
            *carried(docs, carry)[0],
        ),
        "zstd",
    )
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    wanted = max(ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / n_shards), ceil(total / n_shards / (part_mb << 20)))
    m = parts_per_shard or max(1, min(max_parts // n_shards, wanted))
    n_parts = n_shards * m
    targets = [(Fraction(total * j, n_parts), tolerance * total / n_shards / 2 if j % m == 0 else total / n_parts / 4) for j in range(1, n_parts)]
    splitters = find_splitters(rows, targets) if total else []
    first_row = [0, *(s.rows_below for s in splitters)] if total else [0] * n_parts
    shard_start = [first_row[p - p % m] for p in range(n_parts)]
    before = F.array(*(F.lit(first_row[p] - shard_start[p]).cast("long") for p in range(n_parts)))
    part = _partition(splitters)
    placed = rows.withColumn("_part", part).repartitionById(n_parts, F.col("_part"))  # the window needs no other exchange
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*KEYS)) - 1
    dealt = placed.select(
        F.col("_id").alias(key),
        F.col("_text").alias(text),
        F.floor(F.col("_part") / m).cast("int").alias("_shard"),
        (F.element_at(before, F.col("_part") + 1) + rank).alias("_slot"),
        *(f"_c{i}" for i in range(len(carry))),
    )
    return dealt.select(*shard_digest(key, text, "_shard", "_slot"), text, *(f"_c{i}" for i in range(len(carry))))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, key: str = "doc_id", text: str = "text", shard: str = "shard", slot: str = "slot", **more) -> DataFrame:
    """Writes whole documents by shard (see histogram_shards) and returns them as read from the files.

    Files lie in `path`/`shard`=0, 1 and so on, each in slot order; they hold the columns of
    `docs` and `slot`.  A column of `docs` that has one of these two names gets underscores
    behind it until its name is free.
    """
    given = {c: c for c in docs.columns}
    for c in docs.columns:
        while given[c].lower() in (shard.lower(), slot.lower()) or given[c] != c and given[c].lower() in map(str.lower, docs.columns):
            given[c] += "_"
    docs = docs.toDF(*given.values())
    carry = tuple(c for c in docs.columns if c not in (key, text))
    dealt = histogram_shards(docs, n_shards, key, text, carry=carry, **more)
    rows = dealt.select(key, text, *uncarried(carry), F.col("slot").alias(slot), F.col("shard").alias(shard))
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    fields = StructType([docs.schema[c] if c != key else rows.schema[c] for c in docs.columns]).add(slot, LongType()).add(shard, IntegerType())
    return docs.sparkSession.read.schema(fields).parquet(path)
