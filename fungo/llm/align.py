"""Cross-tokenizer alignment: products of token-byte and token-group incidence matrices in compressed rows."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_share, list_array, map_text
from .spm import SPACE, Model

#: How the byte-level vocabulary cuts texts before it merges bytes: a fixed value of its format.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Rows:
    """A sparse matrix in compressed rows: row r has `indices` (columns) and `data` from indptr[r] to indptr[r + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray

    @property
    def n(self) -> int:
        return len(self.indptr) - 1

    def part(self, a: int, b: int) -> Rows:
        at = slice(self.indptr[a], self.indptr[b])
        return Rows(self.indptr[a : b + 1] - self.indptr[a], self.indices[at], self.data[at])


def from_triples(row: np.ndarray, column: np.ndarray, value: np.ndarray, n_rows: int) -> Rows:
    """Entries of one place are added up; columns ascend within a row."""
    if not ((row[1:] > row[:-1]) | ((row[1:] == row[:-1]) & (column[1:] >= column[:-1]))).all():
        order = np.lexsort((column, row))
        row, column, value = row[order], column[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    starts = np.flatnonzero(new)
    data = np.add.reduceat(value, starts) if len(starts) else value[:0]
    return Rows(np.concatenate(([0], np.cumsum(np.bincount(row[starts], minlength=n_rows)))), column[starts], data)


def product(a: Rows, b: Rows, step: int = 1 << 20) -> Rows:
    """a times b by Gustavson's rows: row i is the sum of the rows of b that row i of a names, each times its entry.

    Rows of a are taken together until they name about `step` entries of b (one row at least).
    """
    sizes = np.diff(b.indptr)
    work = np.concatenate(([0], np.cumsum(sizes[a.indices])))[a.indptr]
    parts, at = [], 0
    while at < a.n:
        to = max(at + 1, int(np.searchsorted(work, work[at] + step, "right")) - 1)
        own = a.part(at, to)
        n = sizes[own.indices]
        row = np.repeat(np.repeat(np.arange(to - at), np.diff(own.indptr)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.indptr[own.indices], n)
        parts.append(from_triples(row, b.indices[place], np.repeat(own.data, n) * b.data[place], to - at))
        at = to
    if not parts:
        return Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    indptr = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.indptr) for p in parts]))))
    return Rows(indptr, np.concatenate([p.indices for p in parts]), np.concatenate([p.data for p in parts]))


def token_bytes(lengths: np.ndarray) -> Rows:
    """Tokens of these byte lengths, one after the other, by the bytes they cover."""
    n = int(lengths.sum())
    return Rows(np.concatenate(([0], np.cumsum(lengths))), np.arange(n), np.ones(n, np.int64))


def bytes_token(lengths: np.ndarray) -> Rows:
    """The transpose of token_bytes: every byte by its one token."""
    n = int(lengths.sum())
    return Rows(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64))


def groups_of(overlaps: Rows, n_b: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and B token, and their number: a group ends where tokens of both end, so where the next A token shares no B token with the one before."""
    first, last = overlaps.indices[overlaps.indptr[:-1]], overlaps.indices[overlaps.indptr[1:] - 1]
    of_a = np.cumsum(np.concatenate(([False], first[1:] != last[:-1])))
    of_b = np.zeros(n_b, np.int64)
    of_b[overlaps.indices] = np.repeat(of_a, np.diff(overlaps.indptr))
    return of_a, of_b, int(of_a[-1]) + 1 if len(of_a) else 0


class Pair:
    """Both vocabularies: A byte-level BPE (the bytes of its JSON file), B a SentencePiece model."""

    def __init__(self, byte_bpe: bytes, piece_model: bytes):
        import tiktoken

        model = json.loads(byte_bpe)["model"]
        # bytes that print stand for themselves, the others for the code points from 256 on, in order
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if all(c in of for c in t)}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if any(model["vocab"][m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("ids of the byte-level vocabulary are not in the order of its merges")
        ranks = {t: i for t, i in ranks.items() if i < 256 + len(merges)}  # special tokens come behind
        self.bpe = tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = Model(piece_model)
        self.n_b = len(self.piece.out)
        self.a_length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.a_length[i] = len(t)
        self.b_length = np.array([len(x) for x in self.piece.out], np.int64)

    def lengths(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.a_length[a], self.b_length[b]

    def tokens(self, *parts: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both for texts one after the other, each encoded by itself."""
        a = chain.from_iterable(map(self.bpe.encode_ordinary, parts))
        b = chain.from_iterable(self.piece.processor.encode([s.replace(" ", SPACE) for s in parts], num_threads=1))
        return np.fromiter(a, np.int64), np.fromiter(b, np.int64)


#: A space behind anything but a space and before anything but white space begins a token in both vocabularies.
_CUT = re.compile(r"(?<=[^ ])(?= \S)")
_UNEVEN = re.compile(r" \s| $")
#: Parts that may stand behind and before any others without a change of their tokens; only a text's first or last part may be none.
_SOLID = re.compile(r" \S(?:.*[^ ])?", re.DOTALL)


def units_of(s: str) -> list[str]:
    """Parts of a text at whose edges tokens of both vocabularies end whatever stands around them."""
    if _UNEVEN.search(s) or s[:1] != " ":
        return _CUT.split(s)
    return [" " + w for w in s[1:].split(" ")]


@dataclass
class Units:
    """Distinct parts of texts, aligned: by part counts, group strings, and id pairs with their links in compressed rows."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_overlaps: np.ndarray
    same: np.ndarray
    links: Rows
    text: list[str]


def align_units(units: list[str], pair: Pair) -> Units:
    """Aligns distinct parts (see units_of), the solid ones encoded one after the other as a single text.

    Overlaps of tokens are the product of A's token-byte matrix with the transpose of B's;
    groups follow from them (groups_of).  Links within groups are the product of the
    matrices id-by-group and group-by-id, whose entries count occurrences, so that a group of
    very many tokens costs no more than its distinct ids.
    """
    solid = np.fromiter((_SOLID.fullmatch(u) is not None for u in units), bool, len(units))
    order, n_solid = np.argsort(~solid, kind="stable"), int(solid.sum())
    sizes = np.array([len(u.encode()) for u in units], np.int64)[order]
    joined = pair.tokens(*("".join([units[u] for u in order[i : min(i + 64, n_solid)]]) for i in range(0, n_solid, 64)))
    if [x.sum() for x in pair.lengths(*joined)] != [sizes[:n_solid].sum()] * 2:  # some part's bytes change: each by itself
        joined, n_solid = pair.tokens(), 0
    single = [pair.tokens(units[u]) for u in order[n_solid:]]
    good = [all(x.sum() == n for x in pair.lengths(*p)) for p, n in zip(single, sizes[n_solid:])]
    a, b = (np.concatenate([joined[i], *(p[i] for p, ok in zip(single, good) if ok)]) for i in (0, 1))
    same = np.ones(len(units), bool)
    same[order[n_solid:]] = good
    told = order[same[order]]
    edges = np.cumsum(sizes[same[order]])
    la, lb = pair.lengths(a, b)
    overlaps = product(token_bytes(la), bytes_token(lb))
    of_a, of_b, n_groups = groups_of(overlaps, len(b))
    unit_a, unit_b = (told[np.searchsorted(edges, np.cumsum(x), "left")] for x in (la, lb))
    n = len(units)
    ends = np.flatnonzero(np.diff(of_a, append=n_groups))  # the last A token of every group
    # id by group and group by id
    left = from_triples(of_a, a, np.ones(len(a), np.int64), n_groups)
    right = from_triples(of_b, b, np.ones(len(b), np.int64), n_groups)
    group = np.repeat(np.arange(n_groups), np.diff(left.indptr))
    shared = product(Rows(np.arange(len(group) + 1), group, left.data), right)
    per = np.diff(shared.indptr)
    links = from_triples(np.repeat(unit_a[ends][group], per), np.repeat(left.indices, per) * pair.n_b + shared.indices, shared.data, n)
    count = lambda x: np.bincount(x, minlength=n)
    return Units(count(unit_a), count(unit_b), count(unit_a[ends]), np.bincount(unit_a, np.diff(overlaps.indptr), n).astype(np.int64), same, links, _group_strings(a, b, of_a, of_b, unit_a, n))


def _group_strings(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, unit_a: np.ndarray, n: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each part."""
    if not len(a):
        return [""] * n
    at = np.empty(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")
    place_b = np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")
    at[place_a], at[place_b] = a, b
    sign = np.full(len(at), ",")
    sign[place_a[np.flatnonzero(np.diff(of_a, append=of_a[-1] + 1))]] = "|"
    sign[place_b[np.flatnonzero(np.diff(of_b, append=of_b[-1] + 1))]] = ";"
    last = np.flatnonzero(np.diff(unit_a, append=-1))  # each part's last A token
    stop = np.searchsorted(of_b, of_a[last], "right") + last + 1  # ends of the parts in `at`
    flat = list(chain.from_iterable(zip(map(str, at.tolist()), sign.tolist())))
    out, start = [""] * n, 0
    for u, e in zip(unit_a[last].tolist(), stop.tolist()):
        out[u] = "".join(flat[2 * start : 2 * e - 1])
        start = e
    return out


FACTS = "n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, pairs array<long>, links array<long>"


def align_texts(texts: list, pair: Pair) -> list:
    """Columns of FACTS for texts as UTF-8 bytes or None, each with a space before it."""
    index: dict[str, int] = {}
    rows = [[index.setdefault(u, len(index)) for u in units_of(" " + t.decode())] if t else [] for t in texts]
    made = align_units(list(index), pair) if index else None
    whole = [bool(row) and bool(made.same[row].all()) for row in rows]
    sizes = np.array([len(row) if ok else 0 for row, ok in zip(rows, whole)], np.int64)
    part = np.fromiter(chain.from_iterable(row for row, ok in zip(rows, whole) if ok), np.int64, int(sizes.sum()))
    if not len(part):
        none = pa.array([0] * len(texts), pa.int64())
        return [none, none, none, none, pa.array([""] * len(texts)), *[list_array([[]] * len(texts), pa.int64())] * 2]
    doc = np.repeat(np.arange(len(texts)), sizes)
    found = product(from_triples(doc, part, np.ones(len(part), np.int64), len(texts)), made.links)
    sums = [np.bincount(doc, x[part], len(texts)).astype(np.int64) for x in (made.n_a, made.n_b, made.n_groups, made.n_overlaps)]
    sha = [hashlib.sha256(";".join([made.text[u] for u in row]).encode()).hexdigest() if ok else "" for row, ok in zip(rows, whole)]
    lists = [pa.ListArray.from_arrays(pa.array(found.indptr, pa.int32()), pa.array(x, pa.int64())) for x in (found.indices, found.data)]
    return [*(pa.array(x) for x in sums), pa.array(sha, pa.string()), *lists]


def pair_counts(aligned: DataFrame, n_b: int, held: int = 500_000) -> DataFrame:
    """(pair, n_docs, best): for every id pair (A id times n_b plus B id) the documents that hold it linked, and whether no pair of its A id has more.

    Tasks count up to about `held` distinct pairs before they hand them on.
    """

    def run(batches):
        pairs, ns, size = [], [], 0

        def flush():
            p, n = np.concatenate(pairs), np.concatenate(ns)
            p, at = np.unique(p, return_inverse=True)
            return p, np.bincount(at, n, len(p)).astype(np.int64)

        def given(p, n):
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                flat = batch.column(0).slice(at, 256).flatten().to_numpy()
                p, n = np.unique(flat, return_counts=True)
                pairs.append(p)
                ns.append(n)
                size += len(p)
                if size > 4 * held:
                    p, n = flush()
                    pairs, ns, size = [p], [n], len(p)
                    if size > held:
                        yield given(p, n)
                        pairs, ns, size = [], [], 0
        if pairs:
            yield given(*flush())

    counts = cut_lineage(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs")))
    top = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n_docs").alias("top"), F.count("*").alias("rows"))
    n = counts.count()
    marked = join_by_share(counts.withColumn("a", F.floor(F.col("pair") / n_b)), top, "a", "rows", n)
    return cut_lineage(marked.select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best")))


def align_documents(docs: DataFrame, byte_bpe: str, piece_model: str, key: str = "doc_id", text: str = "text", max_pairs: int = 2_000_000) -> DataFrame:
    """One row per input row: key, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, groups_sha256, pairs, links.

    Both vocabularies encode a space and the text.  n_overlaps: pairs of tokens that share
    bytes; groups lie between byte offsets where tokens of both end; n_links: pairs of tokens
    in one group; `pairs` (A id times the size of B plus B id, ascending) and `links` say how
    many of these each id pair has.  An id pair's count is how many rows hold it linked:
    n_best sums the links whose pair has the highest count of its A id, count_sum the counts
    of all links.  Vocabulary files, of fixed size, are sent to the tasks.

    Texts are cut where tokens of both vocabularies begin in any case (units_of), and a slice
    of texts aligns its distinct parts once.  Pair counts are broadcast while they are at most
    `max_pairs`, as counted; beyond, they meet the documents' pairs in an exchange in which
    pairs of very many documents are joined apart (join_by_share).

    Null and empty texts, and texts whose token bytes differ from a space and the text (the
    mark U+2581 becomes a space), have no tokens: zeros, '' and empty lists; repeated rows
    and null keys stay rows of their own; an empty table gives no rows; texts are whole, of
    any length; extra columns of any name are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (byte_bpe, piece_model)))
    n_b = len(Model(sent.value[1]).out)

    def make():
        pair = Pair(*sent.value)
        return lambda ids, texts: [pa.array(ids, pa.int64()), *align_texts(texts, pair)]

    aligned = cut_lineage(map_text(docs, key, text, f"k long, {FACTS}", make, 2_000_000).withColumn("row", F.monotonically_increasing_id()), "zstd")
    counts = pair_counts(aligned, n_b)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    n_pairs = counts.count()
    if n_pairs <= max_pairs:
        told = each.join(F.broadcast(counts), "pair")
    else:
        told = join_by_share(each, counts.withColumn("rows", F.col("n_docs")), "pair", "rows", counts.agg(F.sum("n_docs")).first()[0])
    sums = told.groupBy("row").agg(F.sum("links").alias("n_links"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = aligned.join(sums, "row", "left")
    return out.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_overlaps", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256", "pairs", "links")
