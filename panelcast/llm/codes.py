"""Compression of vectors to codes: integer k-means per part, nearest entries found by a GNAT.

Components become integers, floor(scale x); a vector is cut into equal parts, and every part position has a
codebook of its own. The nearest entry of a part is searched in a geometric near-neighbour access tree
over the entries: a node holds a few split points and, for every split point and every child, the range of the
distances between that point and the entries of the child. If the distance of the query to a split point lies
outside such a range by strictly more than the best distance so far, the whole child is left out. Distances are floating-point
numbers taken with a proven margin, ranges are rounded outwards, so no entry that could be nearest or tie is
lost; what is left is compared by exact integer distances, ties to the lower index.

The rows are read once a round. A task folds its rows into one count and one sum per entry, so the shuffle and the
driver see numbers of the codebooks only, whatever the input and however alike its rows are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage

ENTRIES, PARTS, ROUNDS, SCALE = 16, 8, 6, 4096
DEGREE = 4  # split points of a node
SAFE = 2**62  # integers below it are held in 64 bits
MOST = 2**63 - 1


def integers(vectors, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale x), padded with zeros to ``width``; 64-bit integers, or Python's where these do not suffice."""
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(scale * x).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale)
    return np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


class Gnat:
    """A tree over the rows of ``entries``. ``shift``: bits dropped before numbers are turned into floats."""

    def __init__(self, entries: np.ndarray, shift: int = 0):
        self.entries, self.shift, self.most = entries, shift, largest(entries)
        self.floats = self.rounded(entries)
        self.slack = self.margin(np.array([float(self.most >> shift)]))[0]
        self.root = self.grow(np.arange(len(entries)))

    def rounded(self, x: np.ndarray) -> np.ndarray:
        return (x >> self.shift if self.shift else x).astype(np.float64)

    def margin(self, most: np.ndarray) -> np.ndarray:
        """A bound on the error of a distance between a query with components up to ``most`` and an entry."""
        width = self.entries.shape[1]
        return 2.0**-50 * width**1.5 * (most + float(self.most >> self.shift)) + (4 * width**0.5 if self.shift else 0)

    def distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((x[:, None] - self.floats[at]) ** 2).sum(axis=2))

    def grow(self, own: np.ndarray):
        """(split points, low, high, children): low and high hold a range per split point and child."""
        if not len(own):
            return None
        splits = [own[0]]
        away = self.distance(self.floats[own], own[:1])[:, 0]
        while len(splits) < min(DEGREE, len(own)):  # the farthest from those chosen
            splits.append(own[int(away.argmax())] if away.max() > 0 else next(i for i in own if i not in splits))
            away = np.minimum(away, self.distance(self.floats[own], np.array(splits[-1:]))[:, 0])
        splits, rest = np.array(splits), np.setdiff1d(own, splits)
        between = self.distance(self.floats[rest], splits)
        nearest = between.argmin(axis=1) if len(rest) else np.zeros(0, int)
        low, high = np.zeros((2, len(splits), len(splits)))
        for child in np.unique(nearest):
            low[:, child] = between[nearest == child].min(axis=0) - self.slack
            high[:, child] = between[nearest == child].max(axis=0) + self.slack
        return splits, low, high, [self.grow(rest[nearest == c]) for c in range(len(splits))]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row, ties to the lower index."""
        x = self.rounded(q)
        margin = self.margin(np.abs(x).max(axis=1, initial=0))
        found = np.full((len(q), len(self.entries)), np.inf)
        best = np.full(len(q), np.inf)  # no nearest entry lies beyond

        def visit(node, rows: np.ndarray) -> None:
            splits, low, high, children = node
            own, slack = self.distance(x[rows], splits), margin[rows]
            found[rows[:, None], splits] = own
            best[rows] = np.minimum(best[rows], own.min(axis=1) + slack)
            for c, child in enumerate(children):
                if child is not None:
                    least = np.maximum(own - high[:, c], low[:, c] - own).max(axis=1) - slack
                    inside = rows[least <= best[rows]]
                    if len(inside):
                        visit(child, inside)

        if len(q):
            visit(self.root, np.arange(len(q)))
        row, entry = np.nonzero(found - margin[:, None] <= best[:, None])
        wide = (largest(q) + self.most) ** 2 * max(1, q.shape[1]) >= SAFE
        apart = (q.astype(object)[row] - self.entries.astype(object)[entry]) if wide else q[row] - self.entries[entry]
        exact = (apart * apart).sum(axis=1) if apart.shape[1] else np.zeros(len(row), np.int64)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first) if len(first) else exact
        hits = np.flatnonzero(exact == np.repeat(least, np.diff(np.append(first, len(row)))))
        at = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]  # entries ascend within a row
        return entry[at], exact[at]


def part(x: np.ndarray, at: int, parts: int) -> np.ndarray:
    width = x.shape[1] // parts
    return x[:, at * width : (at + 1) * width]


def trees(books: list[np.ndarray], x: np.ndarray | None = None) -> list[Gnat]:
    """Trees of all codebooks; for numbers too large for a float's square the lowest bits are left out of the floats."""
    most = max([largest(b) for b in books] + [largest(x) if x is not None else 0])
    return [Gnat(b, max(0, most.bit_length() - 400)) for b in books]


def coder(books: list[list[list[int]]]):
    """A function from integer vectors to (codes, squared distances), both with a column per part."""
    held = [np.array(b, dtype=object) for b in books]
    if all(largest(b) < SAFE for b in held):
        held = [b.astype(np.int64) for b in held]
    usual = trees(held)

    def code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = usual if x.dtype != object else trees(held, x)
        found = [tree.nearest(part(x, p, len(own))) for p, tree in enumerate(own)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    return code


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of a number to the base 2^32: such digits can be summed in 64 bits, however large the number."""
    place = 0
    while value not in (0, -1):
        value, digit = divmod(value, 2**32)
        if digit:
            yield place, digit
        place += 1
    if value:
        yield place, value


def learn(kept: DataFrame, width: int, entries: int, parts: int, rounds: int, scale: int) -> list[list[list[int]]]:
    """The codebooks: lists of parts, entries and integer components."""
    start = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries)
    first = integers([r["vec"] for r in start.select("id", "vec").collect()], width, scale)  # ``entries`` rows
    books = [[[int(v) for v in row] for row in part(first, p, parts)] for p in range(parts)]

    def fold(books):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            code, k = coder(books), len(books[0])
            count = np.zeros((parts, k), dtype=np.int64)
            total = np.zeros((parts, k, width // parts), dtype=object)
            for b in filter(len, batches):
                x = integers(b["vec"].to_numpy(), width, scale)
                own = code(x)[0]
                for p in range(parts):
                    each = (own[:, p] == np.arange(k)[:, None]).astype(x.dtype)
                    count[p] += np.bincount(own[:, p], minlength=k)
                    total[p] += each @ part(x, p, parts)
            rows = [(p, e, -1, 0, int(count[p, e])) for p, e in np.argwhere(count)]
            for p, e in np.argwhere(count):
                for at, value in enumerate(total[p, e]):
                    rows += [(p, e, at, place, digit) for place, digit in limbs(int(value))]
            yield pd.DataFrame(rows, columns=["part", "entry", "at", "place", "value"], dtype="int64")

        return run

    for _ in range(rounds if books[0] else 0):
        sums = kept.select("vec").mapInPandas(fold(books), "part long, entry long, at long, place long, value long")
        sums = sums.groupBy("part", "entry", "at", "place").agg(F.sum("value").alias("value"))
        count, total = {}, {}
        for p, e, at, place, value in sums.collect():  # numbers of the codebooks
            if at < 0:
                count[p, e] = value
            else:
                total[p, e, at] = total.get((p, e, at), 0) + (value << 32 * place)
        for (p, e), n in count.items():
            books[p][e] = [total.get((p, e, at), 0) // n for at in range(width // parts)]
    return books


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): one row per vector.

    Vectors that are null or hold null or non-finite components are dropped. Vectors whose length is no multiple of
    ``parts``, and those shorter than the longest, are filled up with zeros at the end; an empty one is all zeros.
    The codebooks start from the smallest ids, null ids last, equal ones in the order of their vectors; with fewer rows than ``entries``
    there are as many entries as rows. Repeated rows count each; null labels are one label. Errors beyond 64 bits
    are given as the largest 64-bit number. An empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    vec = F.col(vec_col)
    if dict(rows.dtypes)[vec_col] != "array<float>":
        vec = vec.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
    kept = cut_lineage(kept.where(F.col("vec").isNotNull() & F.forall("vec", finite)))
    longest = kept.agg(F.max(F.size("vec"))).first()[0] or 0
    width = -(-longest // parts) * parts
    books = learn(kept, width, entries, parts, rounds, scale)
    digest = hashlib.sha256(",".join(str(v) for b in books for row in b for v in row).encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = coder(books) if books[0] else None
        for b in filter(len, batches):
            own, error = code(integers(b["vec"].to_numpy(), width, scale))
            out = b.drop(columns="vec")
            out["code"] = [bytes(row).hex() for row in own.astype(np.uint8)]
            out["error"] = [min(MOST, int(sum(row))) for row in error.tolist()]
            yield out

    label = next(f for f in kept.schema if f.name == "label").dataType.simpleString()
    coded = kept.mapInPandas(run, f"id long, label {label}, code string, error long")
    coded = cut_lineage(coded)
    of_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    of_label = of_label.select(F.col("label").alias("own_label"), F.least("sum", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(of_label, F.col("label").eqNullSafe(F.col("own_label")))
    return joined.select("id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
