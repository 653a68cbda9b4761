"""SentencePiece BPE encoding and decoding; giant documents by a max-plus scan over chunks.

A piece sequence is the model's encoding exactly if every two neighbours, merged on their
own, come out as those two pieces again.  So encoding is a best path in a lattice whose
steps weigh 0 (compatible neighbours) or minus infinity, and there is one finite path.
Max-plus products of such steps are associative: a chunk of a document becomes a matrix
from the pieces that may lie over its left edge to those over its right edge, the matrices
of a document combine in any grouping, and with the edges known each chunk backtraces alone.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, shared_path, slices

SPACE = "▁"
BARRED = -np.inf
#: Words beyond this many characters are not worth keeping.
LONG_WORD = 64
#: Characters of units whose lattices are scanned together.
SCAN_CHARS = 1 << 16
#: Text of a bucket of chunks.
BUCKET_BYTES = 32 << 20


def escaped(text: str, prefix: str) -> str:
    """A text as its pieces spell it: `prefix` before any text at all, spaces marked."""
    return (prefix if text else "") + text.replace(" ", SPACE)


class Numbers:
    """A fixed table from whole numbers (42 bits) to small ones (20 bits) in a flat array that holds both in one, filled and asked a vector at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        if len(keys) and (keys.min() < 0 or keys.max() >> 42 or values.min() < 0 or values.max() >> 20):
            raise ValueError("numbers beyond the table's bits")
        bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.held = np.full(1 << bits, -1, np.int64)
        at, rest = self._place(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.held[at[rest]] < 0]
            self.held[at[free]] = keys[free] << 20 | values[free]
            rest = rest[self.held[at[rest]] >> 20 != keys[rest]]
            at[rest] = (at[rest] + 1) & self.last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of these keys, -1 where there is none."""
        at = self._place(keys)
        held = self.held[at]
        rest = np.flatnonzero((held >> 20 != keys) & (held >= 0))
        at, keys = at[rest], keys[rest]
        while len(rest):
            at = (at + 1) & self.last
            found = self.held[at]
            held[rest] = found
            go = np.flatnonzero((found >> 20 != keys) & (found >= 0))
            rest, at, keys = rest[go], at[go], keys[go]
        return np.where(held < 0, -1, held & 0xFFFFF).astype(np.int32)


class Steps:
    """Fixed tables of a model's tokens, by which the lattices of many units are scanned at once.

    Tokens are pieces by id, then characters of pieces that are none themselves, then one
    number for all other characters.  A token of several characters has the two tokens that
    its own last merge joins, and the rank of that merge.  Merges come by rank, but for
    pieces no later in rank than a part of theirs (runs of spaces, all of one rank): units
    that `uneven` finds one in are not for these tables.
    """

    def __init__(self, model: Model):
        rank = {x: i for i, x in enumerate(sorted(set(model.scores.values()), reverse=True))}
        of = {p: model.ids[p] for p in model.ids if len(p) == 1 or model.is_token(p)}
        self.n_pieces = len(model.out)
        of |= {c: self.n_pieces + i for i, c in enumerate(sorted(c for c in model.known if c not in of))}
        self.other = max(self.n_pieces, *of.values()) + 1
        self.left, self.right = np.zeros((2, self.other + 1), np.int32)
        self.rank = np.full(self.other + 1, -1, np.int32)
        for p, i in of.items():
            if len(p) > 1:
                a, b = model.merged(p, 2)
                self.left[i], self.right[i], self.rank[i] = of[a], of[b], rank[model.scores[p]]
        late = [p for p, i in of.items() if len(p) > 1 and max(self.rank[self.left[i]], self.rank[self.right[i]]) >= self.rank[i]]
        self.uneven = re.compile("|".join(map(re.escape, late)) or "(?!)")
        joins = [(of[p[:i]] * (self.other + 1) + of[p[i:]], rank[x]) for p, x in model.scores.items() for i in range(1, len(p)) if p[:i] in of and p[i:] in of]
        self.joins = Numbers(*np.array(joins, np.int64).reshape(-1, 2).T.copy())
        nodes = {"": 0}
        for p in of:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        self.token = np.full(len(nodes), -1, np.int32)
        self.token[[nodes[p] for p in of]] = list(of.values())
        self.nodes = Numbers(*np.array([(nodes[p[:-1]] << 21 | ord(p[-1]), n) for p, n in nodes.items() if p], np.int64).T.copy())

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b, merged on their own, come out as those two again.

        Merges come by rank, the leftmost of equals first.  So the merges of a and b are
        undone from the last one back, and those parts that then stand at the edge must not
        have merged before it.
        """
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a < self.other) & (b < self.other))
        a, b, limit = a[at], b[at], np.full(len(at), np.iinfo(np.int32).max, np.int32)
        while len(at):
            joined = self.joins.get(a.astype(np.int64) * (self.other + 1) + b)
            merges = (joined >= 0) & (joined < limit)
            out[at[merges]] = False
            x, y = self.rank[a], self.rank[b]
            go = np.flatnonzero(~merges & (np.maximum(x, y) >= 0))
            at, a, b, x, y = at[go], a[go], b[go], x[go], y[go]
            later = x > y
            a, b, limit = np.where(later, self.right[a], a), np.where(later, b, self.left[b]), np.where(later, x, y + 1)
        return out

    def scan(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of units that no piece crosses on either side, one unit after the other: their numbers, where they begin in the joined units, and how many each unit has.

        All lattices are walked together, each to the longest token that fits the one before,
        and back where that leads nowhere.  Of the tokens that end at a place one is on a path
        of finite weight at most, so a place is tried once.
        """
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size)
        begin = end - size
        stop = np.repeat(end, size)
        at, node = np.arange(len(code)), self.nodes.get(code)
        token = np.where(node >= 0, self.token[node], -1)
        steps = [(at, np.ones(len(at), np.int32), np.where(token >= 0, token, np.int32(self.other)), np.full(len(at), -1))]
        top, held, n = at.copy(), len(at), 1  # the longest step from each place so far
        while len(at):
            go = np.flatnonzero((node >= 0) & (at + n < stop[at]))
            at = at[go]
            node = self.nodes.get(node[go].astype(np.int64) << 21 | code[at + n])
            n += 1
            token = np.where(node >= 0, self.token[node], -1)
            some = np.flatnonzero(token >= 0)
            steps.append((at[some], np.full(len(some), n, np.int32), token[some], top[at[some]]))
            top[at[some]] = np.arange(held, held + len(some))
            held += len(some)
        start, length, token, shorter = (np.concatenate(x) for x in zip(*steps))
        came = np.full(len(code), -1)  # the step that ends behind a character
        at = np.arange(len(units))[size > 0]
        first, stop, step = begin[at], end[at], top[begin[at]]
        while len(step):
            p = start[step]
            q = p + length[step] - 1
            good = came[q] < 0
            some = np.flatnonzero(good & (p > first))
            good[some] = self.fit(token[came[p[some] - 1]], token[step[some]])
            some = np.flatnonzero(good)
            came[q[some]] = step[some]
            bad = np.flatnonzero(~good)
            step[bad] = shorter[step[bad]]
            some = some[q[some] + 1 < stop[some]]
            step[some] = top[q[some] + 1]
            back = bad[step[bad] < 0]
            while len(back):  # no step from here is left: another one than that which came here
                if (p[back] <= first[back]).any():
                    raise RuntimeError("a unit without a path of finite weight")
                by = came[p[back] - 1]
                p[back], step[back] = start[by], shorter[by]
                back = back[step[back] < 0]
            good &= q + 1 == stop
            first, stop, step = first[~good], stop[~good], step[~good]
        found, at = np.full(len(code), -1, np.int32), np.arange(len(units))[size > 0]
        end = end[at]
        while len(at):
            by = came[end - 1]
            end = start[by]
            found[end] = token[by]
            go = np.flatnonzero(end > begin[at])
            at, end = at[go], end[go]
        where = np.flatnonzero(found >= 0)
        return found[where], where, np.searchsorted(where, begin + size) - np.searchsorted(where, begin)


class Model:
    """Pieces of a SentencePiece BPE model with byte fallback, and the library for short texts.

    Caches hold the packed ids of whole words of up to `LONG_WORD` characters, about
    `cache_chars` in all.  `steps` are the tables of Steps, made once and sent to the tasks.
    """

    def __init__(self, blob: bytes, cache_chars: int = 1_600_000, steps: Steps | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        self.prefix = SPACE if self.dummy_prefix else ""
        proto.normalizer_spec.add_dummy_prefix = False  # added here, once a document
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.bytes_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.out = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in proto.pieces]
        self.sizes = np.array(list(map(len, self.out)), np.int64)
        self.longest = max(map(len, self.ids))
        self.known = {c for p in self.ids for c in p}
        self.begins = {p[:i] for p in self.ids for i in range(2, len(p) + 1)}
        self.units = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+")
        if "\n" in self.known or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces cross white space; units would not be independent")
        self.narrow = np.dtype("<u2" if len(self.out) <= 1 << 16 else "<u4")  # how ids are kept and travel
        self.cache: dict[str, bytes] = {}
        self.flawed: set[str] = set()
        self.cache_chars, self.held = cache_chars, 0
        self.unit_cache: dict[str, bytes] = {}
        self.units_held = 0
        self._steps = steps
        self.pair_cache: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def escape(self, text: str) -> str:
        return escaped(text, self.prefix)

    def parts(self, s: str) -> list[str]:
        """What `units` finds in s, in some cases with empty strings between; made by marking where units begin."""
        if "\0" in s:
            return self.units.findall(s)
        s = s.replace(SPACE, "\0" + SPACE).replace(SPACE + "\0", SPACE)  # the second undoes marks inside runs of spaces
        if "\n" in s:
            s = s.replace("\n", "\0\n\0")
            for _ in range(2):  # every other mark of a run is undone at a time
                s = s.replace("\n\0\0\n", "\n\n")
        return s.split("\0")

    @property
    def steps(self) -> Steps:
        if self._steps is None:
            self._steps = Steps(self)
        return self._steps

    def packed(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids that stand one after the other, as the bytes of `counts` each."""
        flat, edges = np.asarray(ids, self.narrow).tobytes(), (np.concatenate(([0], np.cumsum(counts))) * self.narrow.itemsize).tolist()
        return [flat[a:b] for a, b in zip(edges, edges[1:])]

    def _spells(self, units: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        """Puts those of these units that their own ids do not spell, of which byte fallback leaves none, into `flawed`."""
        want = "".join(units).replace(SPACE, " ").encode()
        got = list(map(self.out.__getitem__, flat.tolist()))
        ends = np.cumsum(counts)
        begins = np.flatnonzero((np.frombuffer(want, np.uint8) & 0xC0) != 0x80)  # of characters
        due = np.append(begins, len(want))[np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))]
        if b"".join(got) != want or not np.array_equal(np.append(0, np.cumsum(self.sizes[flat]))[ends], due):
            self.flawed.update(u for u, e, n in zip(units, ends.tolist(), counts.tolist()) if b"".join(got[e - n : e]) != u.replace(SPACE, " ").encode())

    def encode_packed(self, escaped: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of texts that begin and end where no piece can cross, by the library, and whether they spell the text unit by unit."""
        parts = list(map(self.parts, escaped))
        cache = self.cache
        if self.held > self.cache_chars:
            cache.clear()
            self.flawed.clear()
            self.held = 0
        new = list(set().union(*parts).difference(cache))
        ids = self.processor.encode(new, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), self.narrow, int(counts.sum()))
        self._spells(new, flat, counts)
        cache.update(zip(new, self.packed(flat, counts)))
        out = [b"".join(map(cache.__getitem__, p)) for p in parts]
        self.held += sum(map(len, new))
        for u in new:
            if len(u) > LONG_WORD:
                del cache[u]
                self.held -= len(u)
        return out, [self.flawed.isdisjoint(p) for p in parts] if self.flawed else [True] * len(parts)

    def encode_escaped(self, escaped: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, self.narrow).tolist() for x in self.encode_packed(escaped)[0]]

    def trace(self, units: list[str]) -> list[bytes]:
        """Packed ids of units that no piece crosses on either side, scanned together, `SCAN_CHARS` at a time; those of more than `LONG_WORD` characters, and uneven ones (see Steps), by themselves."""
        if max(map(len, units), default=0) > LONG_WORD or self.steps.uneven.search("\0".join(units)):
            alone = [len(u) > LONG_WORD or self.steps.uneven.search(u) is not None for u in units]
            rest = iter(self.trace([u for u, x in zip(units, alone) if not x]))
            return [np.array(self.unit_ids(u), self.narrow).tobytes() if x else next(rest) for u, x in zip(units, alone)]
        out = []
        for a, b in slices(list(map(len, units)), SCAN_CHARS):
            tokens, where, counts = self.steps.scan(units[a:b])
            spelled = np.flatnonzero(tokens >= self.steps.n_pieces)  # characters that are no piece: by their bytes
            if len(spelled):
                text = "".join(units[a:b])
                encoded = [text[i].encode() for i in where[spelled].tolist()]
                n = np.ones(len(tokens), np.int64)
                n[spelled] = list(map(len, encoded))
                unit = np.repeat(np.arange(len(counts)), counts)
                counts = np.bincount(unit, n, len(counts)).astype(np.int64)
                is_byte = np.repeat(tokens >= self.steps.n_pieces, n)
                tokens = np.repeat(tokens, n)
                tokens[is_byte] = [self.bytes_id[x] for x in b"".join(encoded)]
            out += self.packed(tokens, counts)
        return out

    def know(self, units: set[str]) -> None:
        """Traces those of these units that the cache lacks."""
        if self.units_held > self.cache_chars:
            self.unit_cache.clear()
            self.units_held = 0
        new = [u for u in units.difference(self.unit_cache) if len(u) <= LONG_WORD]
        self.unit_cache.update(zip(new, self.trace(new)))
        self.units_held += sum(map(len, new))

    def longest_token(self, s: str, p: int, limit: int) -> int:
        """Where the longest token of `s` that begins at `p` and ends at `limit` at most ends."""
        whole, best = self.whole, p + 1
        for e in range(p + 2, limit + 1):
            token = s[p:e]
            known = whole.get(token)
            if known is None:
                if token not in self.begins:
                    break
                known = self.is_token(token)
            if known:
                best = e
        return best

    def unit_ids(self, s: str) -> list[int]:
        """Ids of a unit that no piece crosses on either side: the one finite path of its lattice, whose matrix has one entry and one exit.

        Steps go to the longest token that fits the one before, and back where that leads
        nowhere.  No two paths of finite weight end at one place, so a place is tried once.
        """
        n, pairs = len(s), self.pair_cache
        seen, tokens = bytearray(n + 1), []
        at, limit = 0, n
        while at < n:
            e = self.longest_token(s, at, limit)
            token = s[at:e]
            if not seen[e] and (not tokens or pairs.get((tokens[-1], token)) or self.fits(tokens[-1], token)):
                seen[e] = 1
                tokens.append(token)
                at, limit = e, n
                continue
            limit = e - 1
            while limit <= at:
                limit = at - 1
                at -= len(tokens.pop())
        return [i for t in tokens for i in self.token_ids(t)]

    def spelled(self, packed: bytes) -> bytes:
        """What packed ids spell, a space before the text included."""
        return b"".join(map(self.out.__getitem__, np.frombuffer(packed, self.narrow).tolist()))

    def decode(self, ids) -> bytes:
        text = b"".join(map(self.out.__getitem__, ids))
        return text[1:] if self.dummy_prefix and text[:1] == b" " else text

    def merged(self, s: str, least: int = 1) -> list[str]:
        """BPE of a few characters: the best scored neighbours merge first, the leftmost of equals; ends at `least` parts."""
        x = list(s)
        while True:
            best = max(((self.scores[x[i] + x[i + 1]], -i) for i in range(len(x) - 1) if x[i] + x[i + 1] in self.scores), default=None)
            if best is None or len(x) == least:
                return x
            i = -best[1]
            x[i : i + 2] = [x[i] + x[i + 1]]

    def is_token(self, s: str) -> bool:
        """Whether s is one character or a piece that its own characters merge to."""
        known = self.whole.get(s)
        if known is None:
            if len(s) == 1:
                return True
            if s not in self.begins:
                return False
            known = self.whole[s] = s in self.scores and self.merged(s) == [s]
        return known

    def fits(self, a: str, b: str) -> bool:
        k = (a, b)
        if k not in self.pair_cache:
            if len(self.pair_cache) > self.cache_chars // 8:
                self.pair_cache.clear()
            self.pair_cache[k] = self.merged(a + b) == ([a, b] if b else [a])
        return self.pair_cache[k]

    def token_ids(self, s: str) -> list[int]:
        i = self.ids.get(s)
        return [i] if i is not None else [self.bytes_id[b] for b in s.encode()]

    def parted(self, s: str, p: int) -> bool:
        """Whether no piece can cross place p of s."""
        return (s[p] == SPACE and s[p - 1] != SPACE) or s[p] not in self.known or s[p - 1] not in self.known


class Lattice:
    """Pieces between `lo` and `hi` of `s`, each with the best weight from every entry; `ends[p]` are those that end at p."""

    def __init__(self, model: Model, s: str, lo: int, hi: int, entries: list[tuple[str | None, int]]):
        self.ends: dict[int, list] = {}
        for i, (token, end) in enumerate(entries):
            w = np.full(len(entries), BARRED)
            w[i] = 0.0
            self.ends.setdefault(end, []).append((token, None, w, None))
        for p in range(lo, hi):
            before = self.ends.get(p)
            if not before:
                continue
            for e in range(p + 1, min(p + model.longest, len(s)) + 1):
                token = s[p:e]
                if not model.is_token(token):
                    continue
                steps = [n for n in before if n[0] is None or model.fits(n[0], token)]
                if steps:
                    self.ends.setdefault(e, []).append((token, p, reduce(np.maximum, [n[2] for n in steps]), steps[0] if len(entries) == 1 else None))

    def path(self, end: int, start: int | None = None) -> list[str]:
        """The tokens up to the node that ends at `end` (and began at `start`), without the entry; one entry only."""
        node = next(n for n in self.ends[end] if (start is None or n[1] == start) and n[2][0] > BARRED)
        out = []
        while node[1] is not None:
            out.append(node[0])
            node = node[3]
        return out[::-1]


def edge_states(model: Model, s: str, at: int) -> list[tuple[int, int]]:
    """(characters before, characters from) place `at` of every token that begins before it and ends there or later."""
    reach = model.longest
    return [(at - b, e - at) for b in range(max(0, at - reach), at) for e in range(at, min(len(s), b + reach) + 1) if model.is_token(s[b:e])]


def _inner_parts(model: Model, s: str, a: int, b: int) -> tuple[int, int] | None:
    """The first and last place in [a, b) that no piece crosses."""
    first = next((p for p in range(max(a, 1), b) if model.parted(s, p)), None)
    return None if first is None else (first, next(p for p in range(b - 1, first - 1, -1) if model.parted(s, p)))


def transfer(model: Model, s: str, a: int, b: int, first: bool, last: bool) -> tuple[list, list, np.ndarray]:
    """Entry states, exit states and the max-plus matrix of the chunk s[a:b] (s has `longest` characters of context on both sides)."""
    entries = [(0, 0)] if first else edge_states(model, s, a)
    exits = [x for x in edge_states(model, s, b) if not last or x[1] == 0]
    nodes = [(None, a) if first else (s[a - x : a + y], a + y) for x, y in entries]

    def weights(lattice: Lattice, n: int) -> np.ndarray:
        at = {(b - node[1], e - b): node[2] for e, ends in lattice.ends.items() if e >= b for node in ends if node[1] is not None}
        return np.stack([at.get(x, np.full(n, BARRED)) for x in exits], 1) if exits else np.zeros((n, 0))

    parts = _inner_parts(model, s, a, b)
    if parts is None:
        return entries, exits, weights(Lattice(model, s, a, b, nodes), len(nodes))
    p, q = parts
    left = reduce(np.maximum, [n[2] for n in Lattice(model, s, a, p, nodes).ends.get(p, [])], np.full(len(nodes), BARRED))
    right = weights(Lattice(model, s, q, b, [(None, q)]), 1)
    return entries, exits, left[:, None] + right


def compose(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (x[:, :, None] + y[None, :, :]).max(1)


def resolve(chunks: list[tuple[list, list, np.ndarray]]) -> list[tuple[tuple, tuple]]:
    """The entry and exit state of every chunk on the one finite path, from prefix and suffix products."""
    forward = [np.zeros((1, 1))]
    for *_, m in chunks:
        forward.append(compose(forward[-1], m))
    backward = np.zeros((chunks[-1][2].shape[1], 1))
    states = [None] * (len(chunks) + 1)
    for c in range(len(chunks) - 1, -1, -1):
        entries, exits, m = chunks[c]
        states[c + 1] = exits[int((forward[c + 1][0] + backward[:, 0]).argmax())]
        backward = compose(m, backward)
        states[c] = entries[int((forward[c][0] + backward[:, 0]).argmax())]
    return list(zip(states, states[1:]))


def inner_units(model: Model, s: str, a: int, b: int) -> list[str]:
    """Units of a chunk between the first and the last place that no piece crosses."""
    parts = _inner_parts(model, s, a, b)
    return [] if parts is None else model.parts(s[slice(*parts)])


def backtrace_packed(model: Model, s: str, a: int, b: int, entry: tuple, exit_: tuple, first: bool, units: list[str]) -> bytes:
    """Ids of the tokens that begin in s[a:b], with the tokens over both edges known.

    Between the first and the last place that no piece crosses, the chunk is a product of
    units with one entry and one exit each, so each unit is traced by itself (`know` before
    has traced the short ones together).
    """
    start = a + entry[1]
    node = (None, a) if first else (s[a - entry[0] : start], start)
    parts = _inner_parts(model, s, a, b)

    def packed(tokens):
        return np.array([i for t in tokens for i in model.token_ids(t)], model.narrow).tobytes()

    if parts is None:
        return packed(Lattice(model, s, a, b, [node]).path(b + exit_[1], b - exit_[0]))
    p, q = parts
    head = Lattice(model, s, a, p, [node]).path(p) if start < p else []
    tail = Lattice(model, s, q, b, [(None, q)]).path(b + exit_[1], b - exit_[0])
    known = model.unit_cache
    try:
        inner = b"".join(map(known.__getitem__, units))
    except KeyError:
        inner = b"".join(known[u] if u in known else np.array(model.unit_ids(u), model.narrow).tobytes() for u in units)
    return packed(head) + inner + packed(tail)


def backtrace(model: Model, s: str, a: int, b: int, entry: tuple, exit_: tuple, first: bool) -> list[int]:
    units = inner_units(model, s, a, b)
    model.know(set(units))
    return np.frombuffer(backtrace_packed(model, s, a, b, entry, exit_, first, units), model.narrow).tolist()


CHUNK = "row long, k long, c int, n int, s string, a int, b int, n_chars long, plain boolean"
OUT = "k long, token_ids array<int>, n_tokens long, n_chars long, n_chunks int, round_trip boolean"


def _dealt(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks (`size` bytes in all) as a table of the shared folder, bucketed by row and c: their texts are shuffled once, and what is joined to them comes to them.

    The table's name is dropped at once; the files stay for the plans that read them.
    """
    spark = chunks.sparkSession
    n, name = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)), f"fungo_{uuid.uuid4().hex}"
    chunks.repartition(n, "row", "c").write.bucketBy(n, "row", "c").option("compression", "zstd").option("path", shared_path(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _rows(batches, n: int = 256):
    """Rows of record batches, `n` at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n).to_pylist()


def _cuts(n: int, size: int) -> list[int]:
    """Edges of the fewest chunks of at most `size`, as even as can be."""
    k = max(1, -(-n // size))
    return [n * c // k for c in range(k + 1)]


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", chunk_chars: int = 8_000) -> DataFrame:
    """(key, token_ids, n_tokens, n_chars, n_chunks, round_trip): the ids the SentencePiece library gives for each whole text.

    `round_trip` tells that decoding the ids gives the text again (false only where the text
    holds the space mark U+2581 itself).  The model file's bytes, of fixed size, are sent to
    the tasks.  Texts of up to `chunk_chars` are one chunk and are encoded where they are, word
    by word with a bounded cache.  Longer ones are cut into even chunks of that size at most;
    the chunks are dealt over all tasks (_dealt), give max-plus matrices (transfer), the
    matrices of a document, some hundred bytes each, are combined (resolve), and each chunk
    is backtraced by itself, its inside too.  So a text of a hundred million characters is
    many small tasks; only its ids meet again, in its one row.

    Null text gives null ids and round_trip null; empty text no ids; an empty table no rows;
    repeated rows and null keys stay rows of their own; extra columns are ignored.
    """
    with open(model_path, "rb") as f:
        blob = f.read()
    own = Model(blob)
    sent = docs.sparkSession.sparkContext.broadcast((blob, own.steps))
    prefix, longest, narrow = own.prefix, own.longest, own.narrow
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    giant = F.coalesce(F.char_length("t"), F.lit(0)) > chunk_chars

    def short(batches):
        model = Model(sent.value[0], steps=sent.value[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids, spelled = model.encode_packed([model.escape(t or "") for t in texts])
                back = [None if t is None else x and SPACE not in t for t, x in zip(texts, spelled)]
                yield _out(part.column(0), [None if t is None else i for t, i in zip(texts, ids)], narrow, [None if t is None else len(t) for t in texts], [None if t is None else 1 for t in texts], back)

    def cut(batches):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        for batch in batches:
            for at in range(batch.num_rows):
                (row,), (k,), (t,) = (batch.column(i).slice(at, 1).to_pylist() for i in range(3))
                s, plain = escaped(t, prefix), SPACE not in t
                edges = _cuts(len(s), chunk_chars)
                ends = list(enumerate(zip(edges, edges[1:])))
                for i in range(0, len(ends), 64):
                    some = ends[i : i + 64]
                    lows, highs = [max(0, a - 2 * longest) for _, (a, _) in some], [min(len(s), b + 2 * longest) for _, (_, b) in some]
                    m = len(some)
                    columns = [row] * m, [k] * m, [c for c, _ in some], [len(ends)] * m, [s[x:y] for x, y in zip(lows, highs)], [a - x for (_, (a, _)), x in zip(some, lows)], [b - x for (_, (_, b)), x in zip(some, lows)], [len(t)] * m, [plain] * m
                    yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(columns, kinds)], names=[x.split()[0] for x in CHUNK.split(", ")])

    def matrices(batches):
        model = Model(sent.value[0], steps=sent.value[1])
        for r in _rows(batches):
            got = [transfer(model, x["s"], x["a"], x["b"], x["c"] == 0, x["c"] == x["n"] - 1) for x in r]
            flat = [pa.array([x[i] for x in r], t) for i, t in (("row", pa.int64()), ("c", pa.int32()))]
            ends = [list_array([list(chain.from_iterable(g[i])) for g in got], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*flat, *ends, list_array([g[2].ravel().tolist() for g in got], pa.float64())], names=["row", "c", "entries", "exits", "m"])

    def combined(batches):
        def pairs(flat):
            return list(zip(flat[::2], flat[1::2]))

        for r in _rows(batches, 32):
            states = [resolve([(pairs(y["entries"]), pairs(y["exits"]), np.array(y["m"], float).reshape(len(y["entries"]) // 2, -1)) for y in x["x"]]) for x in r]
            flat = [pa.array([x["row"] for x in r for _ in x["x"]], pa.int64()), pa.array([y["c"] for x in r for y in x["x"]], pa.int32())]
            ends = [list_array([list(y[i]) for x in states for y in x], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*flat, *ends], names=["row", "c", "entry", "exit"])

    def traced(batches):
        model = Model(sent.value[0], steps=sent.value[1])
        for r in _rows(batches, 64):
            units = [inner_units(model, x["s"], x["a"], x["b"]) for x in r]
            model.know(set().union(*units))
            ids = [backtrace_packed(model, x["s"], x["a"], x["b"], tuple(x["entry"]), tuple(x["exit"]), x["c"] == 0, u) for x, u in zip(r, units)]
            # what begins in a chunk must spell it, from the token over its left edge to the one over its right edge
            back = [x["plain"] and model.spelled(i) == x["s"][x["a"] + x["entry"][1] : x["b"] + x["exit"][1]].replace(SPACE, " ").encode() for x, i in zip(r, ids)]
            yield pa.RecordBatch.from_arrays([pa.array([x["row"] for x in r], pa.int64()), pa.array([x["k"] for x in r], pa.int64()), pa.array([x["c"] for x in r], pa.int32()), pa.array([x["n_chars"] for x in r], pa.int64()), pa.array(back, pa.bool_()), pa.array(ids, pa.binary())], names=["row", "k", "c", "n_chars", "back", "ids"])

    def finish(batches):
        for r in _rows(batches, 32):
            yield _out(pa.array([x["k"] for x in r], pa.int64()), [b"".join(x["ids"]) for x in r], narrow, [x["n_chars"] for x in r], [x["n"] for x in r], [x["back"] for x in r])

    out = rows.filter(~giant).mapInArrow(short, OUT)
    numbered = rows.filter(giant).select(F.monotonically_increasing_id().alias("row"), "k", "t")
    total = rows.filter(giant).agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    chunks = _dealt(numbered.mapInArrow(cut, CHUNK), total)
    of_chunks = chunks.select(*(x.split()[0] for x in CHUNK.split(", "))).mapInArrow(matrices, "row long, c int, entries array<int>, exits array<int>, m array<double>")
    edges = of_chunks.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("c", "entries", "exits", "m"))).alias("x")).mapInArrow(combined, "row long, c int, entry array<int>, exit array<int>")
    ids = chunks.join(edges.hint("shuffle_hash"), ["row", "c"]).mapInArrow(traced, "row long, k long, c int, n_chars long, back boolean, ids binary")
    whole = ids.groupBy("row").agg(F.first("k").alias("k"), F.first("n_chars").alias("n_chars"), F.bool_and("back").alias("back"), F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("x"))
    long_ones = whole.select("k", F.col("x.ids").alias("ids"), "n_chars", "n", "back").mapInArrow(finish, OUT)
    return out.unionAll(long_ones).withColumnRenamed("k", key)


def _out(keys, ids: list, narrow: np.dtype, n_chars: list, n_chunks: list, back: list) -> pa.RecordBatch:
    """Rows of OUT; ids as packed bytes."""
    n = [None if i is None else len(i) // narrow.itemsize for i in ids]
    ends = np.cumsum([0, *(x or 0 for x in n)]).astype(np.int32)
    flat = np.frombuffer(b"".join([i for i in ids if i]), narrow).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in n], pa.bool_()))
    return pa.RecordBatch.from_arrays([keys, lists, pa.array(n, pa.int64()), pa.array(n_chars, pa.int64()), pa.array(n_chunks, pa.int32()), pa.array(back, pa.bool_())], names=[x.split()[0] for x in OUT.split(", ")])


def decode_documents(tokens: DataFrame, model_path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(key, text): the text of each row's ids; null ids give null, bytes that are no UTF-8 become U+FFFD."""
    with open(model_path, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        model = Model(sent.value)
        for batch in batches:
            texts = [None if i is None else model.decode(i).decode(errors="replace") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return tokens.select(F.col(key).cast("long").alias("k"), ids).mapInArrow(run, "k long, text string").withColumnRenamed("k", key)
