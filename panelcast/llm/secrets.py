"""Secret scans: three fixed patterns, and a character convolutional network over every candidate.

A candidate is a run of token characters that is long enough, or a span of the fixed patterns. The network, written in numpy, reads the whole candidate, in overlapping tiles with the characters
around them; the highest response of its tiles is the candidate's. It learns from the labelled findings of all
documents: their distinct tiles are dealt to shards, tasks train one network a shard, and after every pass the networks
and the state of their steps are averaged. Spans of the fixed patterns are the secrets, and besides them the same keys
without what the patterns go by: without name or prefix, in other alphabets, shorter. Other candidates (words,
numbers, addresses, references, secrets of other kinds) are unlabelled: the classes weigh the same, so telling the
labelled from the unlabelled ranks candidates as telling secrets from others does. The findings of a quarter of the
keys are set aside: on all of these the scores are calibrated by a logistic curve, and the threshold is the highest that
still finds RECALL of the set-aside secrets, whatever the unlabelled ones score. Spans of the fixed patterns always stay; the network adds
to them.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage

SHARD, BLOCK = 12_000, 4096  # tiles that one task learns from, about; numbers of a network that are averaged together
LEAST_FINDINGS = 6  # set-aside and training findings of either class that a network needs
RECALL = 0.95
LEFT, INSIDE, RIGHT = 20, 40, 8  # characters read before, in and after a tile
STRIDE, TOGETHER = 20, 8192  # characters from tile to tile; distinct tiles scored together
FILTERS, WIDTH, EPOCHS, BATCH, RATE = 24, 5, 12, 128, 0.01
LEAST_CHARS = 16  # of a candidate
PLACEHOLDER = "[SECRET]"
# The base patterns, and the lengths that their matches must reach.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "cnn")

HINTS = ("passw", "secret", "token", "api")
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_CHARS},}}")
HEX_CLASS = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
SYMBOLS = 98  # padding, other characters, printable ASCII


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind as listed."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in text.encode("utf-8", "replace").translate(HEX_CLASS):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of all base spans and of every maximal run of LEAST_CHARS token characters."""
    found = [(a, b) for a, b, _ in base]
    for m in RUN.finditer(text):
        run = m[0].rstrip(".=-_/+")  # punctuation behind a word
        if len(run) >= LEAST_CHARS:
            found.append((m.start(), m.start() + len(run)))
    return sorted(set(found))


def masked(span: str, kind: str) -> list[str]:
    """The key of a span of a fixed pattern in forms that the patterns do not know."""
    if kind == "assign":
        forms = [ASSIGN.match(span)[2]]
    elif kind == "access":
        forms = [span[4:], span[4:].lower()]
    else:
        forms = [span.upper(), span[: 3 * LEAST_CHARS // 2], base64.b64encode(bytes.fromhex(span[: len(span) // 2 * 2])).decode().rstrip("=")]
    return [f for f in forms if len(f) >= LEAST_CHARS]


def masked_findings(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, str, int, int, str]]:
    """Masked forms of all spans, standing where the name and the quotes of the key stood, too."""
    rows, joined = [], []
    for a, b, _ in base:  # overlapping spans are of one key
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    at = 0
    for a, b, kind in base:
        at += a >= joined[at][1]
        first, last = joined[at]
        last += text[last : last + 1] in ('"', "'")
        left, right = text[max(0, first - LEFT) : first], text[last : last + RIGHT]
        for own in masked(text[a:b], kind):
            rows.append((1, left + own + right, len(left), len(left) + len(own), text[b - LEAST_CHARS // 2 : b]))
    return rows


def reach(base: list[tuple[int, int, str]]) -> Callable[[int], int]:
    """The furthest end of the spans that start before a place. A candidate (a, b) lies within a span if
    reach(a + 1) >= b, and overlaps one if reach(b) > a."""
    starts, ends = [a for a, _, _ in base], [-1, *accumulate((b for _, b, _ in base), max)]
    return lambda at: ends[bisect_left(starts, at)]


def windows(text: str, a: int, b: int) -> Iterator[bytes]:
    """Windows of overlapping tiles that cover the whole candidate; the last one ends where it does."""
    last = max(a, b - INSIDE)
    for at in (*range(a, last, STRIDE), last):
        yield window(text, at, min(b, at + INSIDE))


def window(text: str, a: int, b: int) -> bytes:
    """Symbols of the context and of a tile; the three regions have symbols of their own."""

    def coded(part: str, size: int, region: int, right: bool = False) -> list[int]:
        own = [ord(c) - 30 if " " <= c <= "~" else 1 for c in part]
        gap = [0] * (size - len(own))
        return [region * SYMBOLS + i for i in (gap + own if right else own + gap)]

    left, inside, after = text[max(0, a - LEFT) : a], text[a : min(b, a + INSIDE)], text[b : b + RIGHT]
    ids = coded(left, LEFT, 0, right=True) + coded(inside, INSIDE, 1) + coded(after, RIGHT, 2)
    return np.array(ids, dtype="<u2").tobytes()


def matrix(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), dtype="<u2").reshape(-1, LEFT + INSIDE + RIGHT).astype(np.int64)


REGIONS = ((0, LEFT), (LEFT - WIDTH + 1, LEFT + INSIDE), (LEFT + INSIDE - WIDTH + 1, LEFT + INSIDE + RIGHT - WIDTH + 1))


@dataclass
class Network:
    """Convolution over symbols, the largest response per filter and region, a logistic unit."""

    filters: np.ndarray  # (WIDTH, 3 * SYMBOLS, FILTERS)
    bias: np.ndarray
    top: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # nothing reaches it
    precision: float = float("nan")  # share of the secrets among the set-aside findings that reach the threshold

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x.shape[1] - WIDTH + 1
        response = sum(self.filters[k][x[:, k : k + n]] for k in range(WIDTH)) + self.bias
        at = np.stack([response[:, a:b].argmax(1) + a for a, b in REGIONS], axis=1)  # (rows, regions, filters)
        return np.take_along_axis(response, at, axis=1), at

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(0, self.pooled(x[i : i + 512])[0]).reshape(len(x[i : i + 512]), -1) @ self.top for i in range(0, len(x), 512)]
        return np.concatenate([*out, np.zeros(0)]) + self.offset

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.margin(x))

    def highest(self, tiled: Iterable[Iterable[bytes]]) -> np.ndarray:
        """The largest margin among the tiles of each candidate; equal tiles are scored once."""
        best, waiting = [], {}

        def score():
            for margin, of in zip(self.margin(matrix([*waiting])), waiting.values()):
                for n in of:
                    best[n] = max(best[n], margin)
            waiting.clear()

        for n, own in enumerate(tiled):
            best.append(-np.inf)
            for tile in own:
                waiting.setdefault(tile, set()).add(n)
                if len(waiting) >= TOGETHER:
                    score()
        if waiting:
            score()
        return np.array(best, dtype=float)


def untrained(rng: np.random.Generator) -> Network:
    return Network(rng.normal(0, 0.1, (WIDTH, 3 * SYMBOLS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), 0.0)


class Training:
    """A network with the moments of its steps (Adam), one vector each."""

    def __init__(self, net: Network):
        self.vectors = np.zeros((3, net.filters.size + net.bias.size + net.top.size + 1))
        self.vectors[0] = np.concatenate([net.filters.ravel(), net.bias, net.top, [net.offset]])

    def network(self) -> Network:
        """The network; its arrays are views, which steps change."""
        filters, bias, top, offset = np.split(self.vectors[0], np.cumsum([WIDTH * 3 * SYMBOLS * FILTERS, FILTERS, 3 * FILTERS]))
        return Network(filters.reshape(WIDTH, 3 * SYMBOLS, FILTERS), bias, top, float(offset[0]))

    def step(self, gradient: np.ndarray, t: int):
        value, m, v = self.vectors
        m[:] = 0.9 * m + 0.1 * gradient
        v[:] = 0.999 * v + 0.001 * gradient**2
        value -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def learn(self, x: np.ndarray, y: np.ndarray, sizes: tuple[int, int], epochs: Iterable[int], seed: int, shard: int = 0):
        """Passes over the rows of a shard; ``sizes`` are the rows of either class in all shards. Logistic loss; the
        context of half of the rows is blanked in every pass, so that the candidate itself must tell. Random numbers go
        on where the pass before stopped, in whichever task."""
        rng = np.random.default_rng([seed, shard] if shard else seed)
        untrained(rng)
        weight = np.where(y == 1, 0.5 / max(1, sizes[1]), 0.5 / max(1, sizes[0])) * sum(sizes)
        n, last = max(1, len(x) // BATCH), max(epochs)
        for epoch in range(last + 1):
            for i, own in enumerate(np.array_split(rng.permutation(len(x)), n)):
                blank = rng.random(len(own)) < 0.5
                if epoch in epochs:
                    self.step(self.gradient(x[own].copy(), y[own], weight[own], blank), epoch * n + i + 1)

    def gradient(self, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, blank: np.ndarray) -> np.ndarray:
        net = self.network()
        rows[blank, :LEFT] = 0
        rows[blank, LEFT + INSIDE :] = 2 * SYMBOLS
        pooled, at = net.pooled(rows)
        active = np.maximum(0, pooled).reshape(len(rows), -1)
        p = 1 / (1 + np.exp(-np.clip(active @ net.top + net.offset, -30, 30)))
        error = (p - y) * weight / len(rows)
        back = (error[:, None] * net.top).reshape(pooled.shape) * (pooled > 0)
        grad = np.zeros_like(net.filters)
        f = np.broadcast_to(np.arange(FILTERS), at.shape)
        for k in range(WIDTH):
            np.add.at(grad[k], (np.take_along_axis(rows[:, :, None], at.reshape(len(rows), -1, 1) + k, axis=1).reshape(at.shape), f), back)
        return np.concatenate([(grad + 1e-4 * net.filters).ravel(), back.sum((0, 1)), active.T @ error + 1e-4 * net.top, [error.sum()]])


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """A network from one shard."""
    found = Training(untrained(np.random.default_rng(seed)))
    found.learn(x, y, (int((1 - y).sum()), int(y.sum())), range(EPOCHS), seed)
    return found.network()


def train_shards(tiles: DataFrame, sizes: tuple[int, int], seed: int = 3) -> Network:
    """A network from all rows (window, secret), whose windows differ. A pass of all shards is one job, whose networks are
    averaged; a single shard has nothing to average before the end."""
    shards = -(-sum(sizes) // SHARD)
    h = F.xxhash64("window", F.lit(31))
    rows = tiles.select("window", "secret", h.alias("h"), F.pmod(F.xxhash64("window", F.lit(37)), F.lit(shards)).alias("shard"))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["secret", "h", "window"])
        secret = own["secret"].to_numpy(np.uint8).tobytes()
        return pd.DataFrame({"shard": [int(own["shard"].iloc[0])], "windows": [b"".join(own["window"])], "secret": [secret]})

    packed = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(pack, "shard long, windows binary, secret binary")
    packed = cut_lineage(packed)
    packed = cut_lineage(packed.repartitionByRange(shards, "shard")) if shards > 1 else packed
    found = Training(untrained(np.random.default_rng(seed)))
    for epochs in [range(EPOCHS)] if shards == 1 else [[e] for e in range(EPOCHS)]:
        vectors = found.vectors

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for shard, windows, secret in zip(b["shard"], b["windows"], b["secret"]):
                    own = Training(untrained(np.random.default_rng(seed)))
                    own.vectors = vectors.copy()
                    y = np.frombuffer(secret, np.uint8).astype(np.int64)
                    own.learn(matrix([windows]), y, sizes, epochs, seed, shard)
                    values = own.vectors.ravel()
                    blocks = [values[i : i + BLOCK] for i in range(0, len(values), BLOCK)]
                    yield pd.DataFrame({"shard": shard, "share": len(y) / sum(sizes), "block": range(len(blocks)), "values": blocks})

        def mean(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("shard")
            return pd.DataFrame({"block": own["block"].iloc[:1], "values": [sum(w * v for w, v in zip(own["share"], own["values"]))]})

        learnt = packed.mapInPandas(learn, "shard long, share double, block int, values array<double>")
        blocks = learnt.groupBy("block").applyInPandas(mean, "block int, values array<double>").collect()
        found.vectors = np.concatenate([np.array(r["values"]) for r in sorted(blocks)]).reshape(vectors.shape)
    return found.network()


def curve(sums: Callable[[np.ndarray, tuple[float, float]], Iterable], spread: float, sizes: tuple[int, int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins by Newton steps. ``sums(w, targets)`` adds up, over all
    candidates, p(1-p)x^2, p(1-p)x, p(1-p), (p-t)x and p-t, where x is the margin by its spread and t the class's target."""
    w = np.array([1.0, 0.0])
    for _ in range(25):
        xx, x, one, gx, g = map(float, sums(w, (1 / (sizes[0] + 2), (sizes[1] + 1) / (sizes[1] + 2))))
        step = np.linalg.solve(np.array([[xx, x], [x, one]]) + 1e-6 * np.eye(2), np.array([gx, g]) + 1e-6 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / spread), float(w[1])


def calibrate(net: Network, margin: np.ndarray, y: np.ndarray) -> Network:
    """A logistic curve on the margins of candidates; then the highest threshold that keeps RECALL."""
    spread = margin.std() or 1.0

    def sums(w: np.ndarray, targets: tuple[float, float]) -> list[float]:
        x = margin / spread
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        slope, error = p * (1 - p), p - np.where(y == 1, targets[1], targets[0])
        return [(slope * x * x).sum(), (slope * x).sum(), slope.sum(), (error * x).sum(), error.sum()]

    net.scale, net.shift = curve(sums, spread, (int((1 - y).sum()), int(y.sum())))
    of_secrets = np.sort(net.calibrated(margin[y == 1]))
    net.threshold = float(of_secrets[int((1 - RECALL) * len(of_secrets))])
    net.precision = float(y[net.calibrated(margin) >= net.threshold].mean())
    return net


def calibrate_rows(net: Network, held: DataFrame, sizes: tuple[int, int]) -> Network:
    """calibrate() for rows (secret, margin). Sums are of decimals, so that they do not hang on the order of rows."""

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(28,12)"))

    def clipped(z: Column) -> Column:
        return F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))

    margin, secret = F.col("margin"), F.col("secret")
    mean, square = (float(v) / sum(sizes) for v in held.agg(total(margin), total(margin * margin)).first())
    spread = float(np.sqrt(max(0.0, square - mean * mean))) or 1.0

    def sums(w: np.ndarray, targets: tuple[float, float]) -> Iterable:
        x = margin / F.lit(spread)
        p = 1 / (1 + F.exp(-clipped(F.lit(float(w[0])) * x + F.lit(float(w[1])))))
        slope, error = p * (1 - p), p - F.when(secret == 1, targets[1]).otherwise(targets[0])
        return held.agg(*[total(c) for c in (slope * x * x, slope * x, slope, error * x, error)]).first()

    net.scale, net.shift = curve(sums, spread, sizes)
    placed = held.select("secret", clipped(F.lit(net.scale) * margin + F.lit(net.shift)).alias("at"))
    rank = int((1 - RECALL) * sizes[1])
    ordered = placed.where(secret == 1).select("at").orderBy("at").rdd.zipWithIndex()
    least = ordered.filter(lambda r: r[1] == rank).collect()[0][0]["at"]
    net.threshold = float(1 / (1 + np.exp(-least)))
    net.precision = placed.where(F.col("at") >= least).agg(F.avg("secret")).first()[0]
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """The network, or None where the documents hold too few findings of either class to learn and to
    calibrate: the fixed patterns then stand alone."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                text = text or ""
                base = base_spans(text)
                end = reach(base)
                rows += masked_findings(text, base)
                for s, e in candidates(text, base):
                    secret, lead = end(s + 1) >= e, min(s, LEFT)
                    if secret or end(e) <= s:  # of a run that is a secret in part, no label is known
                        rows.append((int(secret), text[s - lead : e + RIGHT], lead, lead + e - s, text[e - LEAST_CHARS // 2 : e]))
            yield pd.DataFrame(rows, columns=["secret", "part", "start", "end", "key"])

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for secret, part, s, e in zip(b["secret"], b["part"], b["start"], b["end"]):
                yield pd.DataFrame({"window": list(windows(part, s, e))}).assign(secret=secret)

    def classes(df: DataFrame) -> tuple[int, int]:
        found = {r["secret"]: r["count"] for r in df.groupBy("secret").count().collect()}
        return found.get(0, 0), found.get(1, 0)

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(find, "secret int, part string, start int, end int, key string")
    # one example of each text: a key copied a thousand times is one finding
    found = found.groupBy("part", "start", "end").agg(F.max("secret").alias("secret"), F.min("key").alias("key"))
    found = cut_lineage(found.withColumn("h", F.xxhash64("part", "start", "end", F.lit(31))))
    aside = F.pmod(F.xxhash64("key", F.lit(31)), F.lit(4)) == 0  # by the end of the key: all its forms go together
    tiles = found.where(~aside).mapInPandas(tile, "window binary, secret int").groupBy("window").agg(F.max("secret").alias("secret"))
    tiles = cut_lineage(tiles)
    sizes, held_sizes = classes(tiles), classes(found.where(aside))
    if min(*sizes, *held_sizes) < LEAST_FINDINGS:
        return None
    net = train_shards(tiles, sizes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            margin = net.highest(windows(part, s, e) for part, s, e in zip(b["part"], b["start"], b["end"]))
            yield pd.DataFrame({"secret": b["secret"], "margin": margin})

    held = cut_lineage(found.where(aside).repartition("h").mapInPandas(measure, "secret int, margin double"))
    return calibrate_rows(net, held, held_sizes)


def scan(net: Network | None, texts) -> list[list[tuple[int, int, str]]]:
    """All spans of each text. Spans of the network may overlap those of the fixed patterns, and reach beyond
    them, but never lie within one."""
    texts = [t or "" for t in texts]
    found, spots = [base_spans(t) for t in texts], []
    for n, (text, base) in enumerate(zip(texts, found)):
        if net is not None:
            end = reach(base)
            spots += [(n, a, b) for a, b in candidates(text, base) if end(a + 1) < b]
    if spots:
        p = net.calibrated(net.highest(windows(texts[n], a, b) for n, a, b in spots))
        for (n, a, b), own in zip(spots, p):
            if own >= net.threshold:
                found[n].append((a, b, "cnn"))
    return [sorted(own, key=lambda s: (s[0], KINDS.index(s[2]))) for own in found]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row; spans are (start, end, kind) in code points, end exclusive, by start and
    kind. Null texts count as empty; repeated rows each keep a row; an empty table gives an empty result."""
    net = fit(docs, id_col, text_col)

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in own] for own in scan(net, texts)])

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(net: Network | None, text: Column) -> Column:
    """The text with every found span, overlapping ones together, replaced by PLACEHOLDER."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, scan(net, texts)):
            parts, last = [], 0
            for a, b, _ in spans:
                if a >= last:
                    parts += [t[last:a], PLACEHOLDER]
                last = max(last, b)
            out.append("".join([*parts, t[last:]]) if spans else t)
        return pd.Series(out)

    return run(text)
