"""Secret scans: three fixed patterns, and a character convolutional network over every other candidate."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_text

#: Base kinds in the order they are listed.
KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What the network judges besides: runs of token characters.
MIN_RUN = 8
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: Runs taken for plain words where labelled findings are gathered: letters of one case, or of one after the first.
_PLAIN = re.compile(r"(?:[A-Za-z][a-z]{7,23}|[A-Z]{8,24})\.*")

#: Characters of a window: context before, the candidate (longer ones have several windows), context after.
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Character classes: printable ASCII by itself, white space, anything else, padding.
N_CLASSES = 98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the fixed patterns, leftmost without overlap per kind; offsets in code points."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of token characters, and what base spans leave of them, from MIN_RUN characters up."""
    cuts = sorted((a, b) for a, b, _ in taken)
    i = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while i < len(cuts) and cuts[i][1] <= start:
            i += 1
        for j in range(i, len(cuts)):
            a, b = cuts[j]
            if a >= end:
                break
            if a - start >= MIN_RUN:
                yield start, a
            start = max(start, b)
        if end - start >= MIN_RUN:
            yield start, end


def window(text: str, a: int, b: int) -> str:
    """The network's view of text[a:b], INSIDE characters at most, padded by NUL to WIDTH."""
    return text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0") + text[a:b].ljust(INSIDE, "\0") + text[b : b + AFTER].ljust(AFTER, "\0")


def views(a: int, b: int) -> Iterator[tuple[int, int]]:
    """Parts of a run that windows show: the whole of it, or INSIDE characters at every half of that, up to its end."""
    if b - a <= INSIDE:
        yield a, b
        return
    for s in range(a, b - INSIDE, INSIDE // 2):
        yield s, s + INSIDE
    yield b - INSIDE, b


def found_by_base(w: str) -> bool:
    """Whether a fixed pattern finds (a part of) the candidate in a window."""
    return any(a < BEFORE + INSIDE and b > BEFORE for a, b, _ in base_spans(w))


_CLASS = np.full(128, 96, np.int64)
_CLASS[33:127] = np.arange(94)
_CLASS[0] = 97
_CLASS[[9, 10, 11, 12, 13, 32]] = 94


def encode(windows: list[str]) -> np.ndarray:
    c = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(-1, WIDTH)
    return np.where(c < 128, _CLASS[np.minimum(c, 127)], 95)


class CharCnn:
    """Embedding, one convolution over 5 characters, ReLU, maximum and mean over each of the context before, the candidate and the context after, logistic output."""

    def __init__(self, dim: int = 8, filters: int = 24, width: int = 5, seed: int = 7):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": r.normal(0, 0.3, (N_CLASSES, dim)), "k": r.normal(0, (width * dim) ** -0.5, (width * dim, filters)), "c": np.zeros(filters), "w": r.normal(0, filters**-0.5, 6 * filters), "b": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        edges = (0, BEFORE - width // 2, BEFORE + INSIDE - width // 2, WIDTH - width + 1)
        self.regions = [slice(*e) for e in zip(edges, edges[1:])]

    def state(self) -> dict:
        """Plain numbers and arrays, which tasks take without this class."""
        return {"width": self.width, "p": self.p, "scale": float(self.scale), "shift": float(self.shift), "threshold": self.threshold}

    @classmethod
    def of(cls, state: dict) -> CharCnn:
        net = cls(width=state["width"])
        net.p, net.scale, net.shift, net.threshold = (state[k] for k in ("p", "scale", "shift", "threshold"))
        return net

    def _pool(self, a: np.ndarray) -> np.ndarray:
        return np.concatenate([f for r in self.regions for f in (a[:, r].max(1), a[:, r].mean(1))], 1)

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        n, length, dim = e.shape
        patches = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.width + 1, self.width * dim)
        a = np.maximum(patches @ self.p["k"] + self.p["c"], 0)
        pooled = self._pool(a)
        return patches, a, pooled, pooled @ self.p["w"] + self.p["b"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """As logits, scaled, but in single precision from tables: what each two neighbouring characters add to the filters."""
        if not len(x):
            return np.zeros(0)
        k = self.p["k"].reshape(self.width, -1, self.p["k"].shape[1])
        one = [(self.p["e"] @ k[i]).astype(np.float32) for i in range(self.width)]
        one[0] += self.p["c"].astype(np.float32)
        two = [(one[i][:, None] + one[i + 1]).reshape(N_CLASSES**2, -1) for i in range(0, self.width - 1, 2)]
        steps, w, out = x.shape[1] - self.width + 1, self.p["w"].astype(np.float32), []
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            pairs = part[:, :-1] * N_CLASSES + part[:, 1:]
            a = two[0].take(pairs[:, :steps], 0)
            for j, t in enumerate(two[1:], 1):
                a += t.take(pairs[:, 2 * j : 2 * j + steps], 0)
            if self.width % 2:
                a += one[-1].take(part[:, self.width - 1 :], 0)
            np.maximum(a, 0, out=a)
            out.append(self._pool(a) @ w + np.float32(self.p["b"][0]))
        return 1 / (1 + np.exp(-np.clip(self.scale * np.concatenate(out).astype(float) + self.shift, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.004, seed: int = 7) -> None:
        """Adam on the logistic loss."""
        r = np.random.default_rng(seed)
        m, v, t = {k: 0 * p for k, p in self.p.items()}, {k: 0 * p for k, p in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                g = self._gradients(x[order[i : i + batch]], y[order[i : i + batch]])
                t += 1
                for k, p in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        patches, a, pooled, z = self._forward(x)
        n, steps, f = a.shape
        dz = (1 / (1 + np.exp(-z)) - y) / n
        dp = dz[:, None] * self.p["w"]
        da = np.zeros_like(a)
        for i, r in enumerate(self.regions):
            da[:, r] = dp[:, None, (2 * i + 1) * f : (2 * i + 2) * f] / (r.stop - r.start)
            da[np.arange(n)[:, None], r.start + a[:, r].argmax(1), np.arange(f)] += dp[:, 2 * i * f : (2 * i + 1) * f]
        da *= a > 0
        flat = da.reshape(-1, f)
        dpatch = (flat @ self.p["k"].T).reshape(n, steps, self.width, -1)
        dx = np.zeros((*x.shape, dpatch.shape[-1]))
        for i in range(self.width):
            dx[:, i : i + steps] += dpatch[:, :, i]
        de = np.stack([np.bincount(x.ravel(), dx[..., d].ravel(), N_CLASSES) for d in range(dx.shape[-1])], 1)
        return {"e": de, "k": patches.reshape(-1, patches.shape[-1]).T @ flat, "c": flat.sum(0), "w": pooled.T @ dz, "b": dz.sum(keepdims=True)}

    def calibrate(self, x: np.ndarray, y: np.ndarray, min_recall: float, decided: np.ndarray | None = None) -> None:
        """Platt scaling on held-out findings, then the highest threshold that keeps `min_recall` of the secrets.

        Only findings in `decided` (default: all) count for the threshold, and for `recall`
        and `precision`, which say what it did to them.
        """
        z = self.logits(x)
        w = np.array([1.0, 0.0])
        f = np.stack([z, np.ones(len(z))], 1)

        def loss(w):
            return np.logaddexp(0, np.where(y == 1, -1, 1) * (f @ w)).sum() + 5e-3 * ((w - [1, 0]) ** 2).sum()

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -500, 500)))
            step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2), f.T @ (y - p) - 1e-2 * (w - [1, 0]))
            while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:  # findings that part cleanly make whole steps overshoot
                step /= 2
            w += step
        self.scale, self.shift = w
        p, counted = self.probability(x), np.ones(len(y), bool) if decided is None else decided
        real = np.sort(p[(y == 1) & counted])
        self.threshold = float(real[int((1 - min_recall) * len(real))]) if len(real) else 0.5
        hit = (p >= self.threshold) & counted
        self.recall = float((hit & (y == 1)).sum() / len(real)) if len(real) else None
        self.precision = float(y[hit].mean()) if hit.any() else None


def synthetic_findings(words: list[str], n: int, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled windows beside the corpus's own: random keys of common formats (1), and words, names, addresses, paths, versions, dates and numbers built from words of the corpus or made-up ones (0).

    Short keys and those of digits alone come after words that announce them, as nothing
    else tells them from plain ones (of such, none but words follows them as no key); other
    keys and plain runs both come with and without; some keys lie inside long paths.
    """
    r = random.Random(seed)
    words = words or ["word"]
    hexd, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def made_up():
        return "".join(r.choice(("bcdfghjklmnprstvwz", "aeiou")[i % 2]) for i in range(r.randint(3, 10)))

    def word():
        return r.choice(words) if r.random() < 0.5 else made_up()

    def rnd(alphabet, a, b):
        return "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))

    secret = (lambda: rnd(hexd, 18, 64), lambda: rnd(b62, 20, 48), lambda: rnd(b62 + "+/", 24, 60) + "==", lambda: r.choice(("ghp_", "sk_live_", "xoxb-", "glpat-")) + rnd(b62, 16, 36), lambda: "AKIA" + rnd(b62[:26] + b62[52:], 12, 16), lambda: "eyJ" + rnd(b62, 12, 30) + "." + rnd(b62 + "_-", 16, 40), lambda: rnd(b62[:52], 20, 48))
    told = (lambda: rnd(b62, 8, 15), lambda: rnd(b62[52:], 8, 24), lambda: rnd(b62[26:], 8, 15))
    plain = (lambda: f"{word()}-{word()}-{r.randint(1, 999)}", lambda: f"mail{r.randint(0, 99)}.{word()}.com", lambda: f"{word()}_{word()}_{r.randint(1, 99)}", lambda: f"www.{word()}{r.randint(1, 99)}.org/{word()}/{r.randint(1, 9999)}", lambda: f"{word()}{word()}{r.randint(1, 9999)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}", lambda: f"version-{r.randint(1, 20)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}", lambda: f"{word()}/{word()}/{word()}{r.randint(1, 99)}.txt", lambda: f"{word().title()}{word().title()}{word().title()}{r.randint(1, 20)}", lambda: (word() + word()).capitalize() + r.choice(("", ".")), lambda: word() + word() + r.choice(("", ".", "...")), lambda: rnd(b62[52:], 8, 20), lambda: r.choice(".-=_/") * r.randint(8, 60), lambda: (word() + r.choice(("", "-", "_")) + word()).upper() + r.choice(("", ".", str(r.randint(1, 99)))), lambda: f"{rnd('ABCDEFGHKLMNPRSTX', 2, 4)}-{r.randint(1990, 2030)}-{r.randint(0, 999999):06}-{rnd('ABCDEFGHKLMNPRSTX', 1, 2)}{r.randint(1, 99)}", lambda: "-".join(rnd(hexd, n, n) for n in (8, 4, 4, 4, 12)), lambda: "/".join(word() for _ in range(r.randint(5, 14))))
    lead = ("the key is ", "key=", "Authorization: Bearer ", "Bearer ", "credential: ", "auth \"", "pwd=", "passphrase: ", "private key ")
    other = ("name=", "page ", "city: ", "no. ", "see \"")
    out = []
    for _ in range(n):
        label = r.random() < 0.5
        short = label and r.random() < 0.25
        announced = short or r.random() < (0.4 if label else 0.25)
        core = r.choice(told if short else secret if label else plain)()
        if announced and not label and core.isdigit():
            core = word() + word()
        if not label and r.random() < 0.1:  # what announces a key is none
            name = r.choice(("Authorization", "passphrase", "credential", "password", "private_key", "client-secret"))
            before = " ".join(word() for _ in range(3)) + " "
            out.append((window(before + name + r.choice((": ", "=", " ", ": Bearer ")) + r.choice((*told, *secret))(), len(before), len(before) + len(name)), 0))
            continue
        before = " ".join(word() for _ in range(3)) + " " + (r.choice(lead) if announced else r.choice(other) if r.random() < 0.3 else "")
        joined = label and not short and r.random() < 0.25
        front, back = (("/".join(word() for _ in range(r.randint(2, 9))) + "/", "/" + "/".join(word() for _ in range(r.randint(1, 9)))) if joined else ("", ""))
        text = before + front + core + back + " " + word()
        a, b = len(before), len(before + front + core + back)
        at = len(before + front)
        parts = list(views(a, b))
        a, b = max(parts, key=lambda v: min(v[1], at + len(core)) - max(v[0], at)) if joined else r.choice(parts)
        out.append((window(text, a, b), int(label)))
    return out


def gather_findings(docs: DataFrame, key: str, text: str, max_docs: int, max_findings: int) -> tuple[list[tuple[str, int]], list[str]]:
    """Labelled windows of about `max_docs` rows drawn by a hash of the key: base findings are secrets (`max_findings` at most), other candidates that are plain words are not (twice as many).  Also words of these rows."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(min(1.0, max_docs / max(1, n)) * (1 << 20))

    def run(batches):
        for batch in batches:
            wins, labels = [], []
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                spans = base_spans(t)
                own = [window(t, *v) for a, b, _ in spans for v in islice(views(a, b), 8)]
                wins += own
                labels += [1] * len(own)
                runs = [(a, b) for a, b in candidates(t, spans) if _PLAIN.fullmatch(t, a, b)]
                some = runs[:: max(1, len(runs) // 5)][:5]
                wins += [window(t, *v) for v in some]
                labels += [0] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.string()), pa.array(labels, pa.int32())], names=["w", "y"])

    found = cut_lineage(docs.filter(draw).select(text).mapInArrow(run, "w string, y int"))
    # the same findings on every run, whatever the partitions: the first by hash
    rows = [r for y in (0, 1) for r in found.filter(F.col("y") == y).orderBy(F.xxhash64("w"), "w").limit(max_findings if y else 2 * max_findings).collect()]
    words = sorted({r["w"][BEFORE : BEFORE + INSIDE].rstrip("\0").rstrip(".") for r in rows if r["y"] == 0})
    return [(r["w"], r["y"]) for r in rows], words


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", max_docs: int = 20_000, max_findings: int = 1_500, n_synthetic: int = 3_000, n_calibrate: int = 6_000, min_recall: float = 0.98, seed: int = 5) -> CharCnn:
    """The network, fitted on a bounded set of labelled findings and calibrated on others: a fifth held out and `n_calibrate` made for it, of which only secrets that no fixed pattern finds set the threshold (fewer would leave a quantile to chance)."""
    own, words = gather_findings(docs, key, text, max_docs, max_findings)
    found = own + synthetic_findings(words, n_synthetic)
    x, y = encode([w for w, _ in found]), np.array([v for _, v in found], float)
    part = np.random.default_rng(seed).permutation(len(x))
    held = len(x) // 5
    net = CharCnn()
    net.fit(x[part[held:]], y[part[held:]])
    apart = [found[i] for i in part[:held]] + synthetic_findings(words, n_calibrate, seed=12)
    net.calibrate(encode([w for w, _ in apart]), np.array([v for _, v in apart], float), min_recall, np.array([not (v and found_by_base(w)) for w, v in apart]))
    return net


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", net: CharCnn | None = None, **training) -> DataFrame:
    """(key, starts, ends, kinds): all spans of every whole text, by start, then kind as in KINDS; offsets in code points, end exclusive.

    Spans of the fixed patterns always stay; every other run of MIN_RUN token characters or
    more is judged by the network (fitted on `docs` unless given; some 30 kB, broadcast)
    together with its context, and added as kind `model` at or above the calibrated
    threshold.  Long runs are judged by overlapping windows; the surest decides.

    Null and empty texts have no spans; an empty table gives no rows; repeated rows and null
    keys stay; extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((net or train(docs, key, text, **training)).state())

    def make():
        net = CharCnn.of(sent.value)

        def f(ids, texts):
            spans, wins, place = [], [], []
            found: set[tuple[int, int, int]] = set()

            def judge():
                if wins:
                    found.update(q for q, p in zip(place, net.probability(encode(wins))) if p >= net.threshold)
                wins.clear()
                place.clear()

            for d, t in enumerate(texts):
                t = t.decode() if t else ""
                spans.append(base_spans(t))
                for a, b in candidates(t, list(spans[d])):
                    for v in views(a, b):
                        wins.append(window(t, *v))
                        place.append((d, a, b))
                        if len(wins) == 4096:
                            judge()
            judge()
            for d, a, b in found:
                spans[d].append((a, b, 3))
            spans = [sorted(x, key=lambda x: (x[0], x[2])) for x in spans]
            return [pa.array(ids, pa.int64()), *(pa.array([[s[i] for s in x] for x in spans], pa.list_(pa.int32())) for i in range(3))]

        return f

    return map_text(docs, key, text, "k long, starts array<int>, ends array<int>, kinds array<int>", make).withColumnRenamed("k", key)
