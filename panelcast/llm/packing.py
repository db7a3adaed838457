"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence. The program asks for as few
configurations as cover the histogram. It is solved by multiplicative weights: every length has a
price; a knapsack dynamic program finds the dearest configuration; it is taken in bulk and its lengths
become cheaper in proportion to the share of their pieces it used up. The solution is scaled to use no
length beyond its count and rounded down; what is left is placed by best fit, decreasing, on the
histogram. Histogram, prices and plan are bounded by the sequence length, whatever the input; pieces
find their place by their rank among the pieces of their length, which Spark computes in blocks.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage

CAPACITY = 2048
END_ID = 0  # written after every document
ROUNDS, GREED = 400, 0.7  # pricing rounds; strength of a price's fall
RANKED = 400  # pieces ranked together
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """Byte ranks of a byte-level vocabulary file; by default the 50k one, whose ranks are the ids that
    ``byte_bpe_50k.json`` gives."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int]):
    """A function from text to ids. The library's pattern fails on white space of some 800,000 characters, so long runs are cut
    out where the pattern cuts them itself: all of a run but its last character is one piece, at the end of the text all of it."""
    import tiktoken

    coding = tiktoken.Encoding("panelcast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += coding.encode_ordinary(text[at : run.start()])
            ids += coding._encode_single_piece(text[run.start() : end])
            at = end
        return ids + coding.encode_ordinary(text[at:]) if at else coding.encode_ordinary(text)

    return encode


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: only the first piece may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids]); every document has at least one."""
    ranks = vocabulary(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks)
        for b in batches:
            out = defaultdict(list)
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for piece, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    own = ids[start : start + length]
                    values = (doc_id, piece, start, length, zlib.crc32(own.tobytes()))
                    for name, value in zip(("doc_id", "piece", "start", "length", "ids_crc32"), values):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(own.astype(np.int64))
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def knapsack(price: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest multiset of lengths (price[l] > 0) that fits the capacity."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[c - 1 :: -1][:c]
        at = int(value.argmax())
        best[c], choice[c] = (value[at], at + 1) if value[at] > best[c - 1] else (best[c - 1], 0)
    found, c = defaultdict(int), capacity
    while c:
        if choice[c]:
            found[int(choice[c])] += 1
        c -= int(choice[c]) or 1
    return dict(found)


def configurations(count: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, times): a packing of all pieces; count[l] pieces have length l."""
    left = count.astype(np.int64).copy()
    plan = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    length = np.arange(capacity + 1)
    have = np.maximum(left, 1)
    price = np.where(left > 0, length / capacity, -np.inf)
    taken: dict[tuple, float] = defaultdict(float)
    used = np.zeros(capacity + 1)
    for _ in range(rounds if left.any() else 0):
        own = knapsack(price, capacity)
        if not own:
            break
        at, n = np.array(list(own)), np.array(list(own.values()))
        times = (have[at] / n).min()
        taken[tuple(sorted(own.items()))] += times
        used[at] += n * times
        price[at] *= np.exp(-GREED * n * times / have[at])
    most = max(1.0, (used / have).max())
    for own, times in sorted(taken.items(), key=lambda x: -x[1]):
        at, n = (np.array(x) for x in zip(*own))
        times = int(min(times / most, (left[at] // n).min()))
        if times and (at * n).sum() == capacity:  # a looser one is left to best fit
            left[at] -= n * times
            plan.append((dict(own), times))
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, decreasing, on the histogram: sequences of equal contents are filled together."""
    room: dict[int, list] = defaultdict(list)  # by space left: [contents, sequences]
    for l in range(capacity, 0, -1):
        k = int(left[l])
        while k:
            space = min((r for r, own in room.items() if r >= l and own), default=capacity)
            contents, n = room[space].pop() if room.get(space) else [{}, k]
            each = min(space // l, k)
            filled = min(n, k // each)
            if n > filled:
                if contents:
                    room[space].append([contents, n - filled])
            room[space - each * l].append([contents | {l: each}, filled])
            k -= filled * each
    return [(contents, n) for own in room.values() for contents, n in own]


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first rank, first sequence, pieces a sequence, offset) of every configuration that has it."""
    rows, ranks, sequence = defaultdict(list), defaultdict(int), 0
    for own, times in plan:
        offset = 0
        for l, n in sorted(own.items(), reverse=True):
            rows[l].append((ranks[l], sequence, n, offset))
            ranks[l] += n * times
            offset += n * l
        sequence += times
    return {l: tuple(np.array(x, dtype=np.int64) for x in zip(*own)) for l, own in rows.items()}


def ranked(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, 0, 1, … among the pieces of one length: positions within small blocks plus
    the sizes of the blocks before, so a very common length is spread over many tasks."""
    blocks = F.ceil(F.col("count") / F.lit(float(RANKED)))
    dealt = pieces.join(F.broadcast(counts), "length")  # one row per length, CAPACITY at most
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), blocks)).drop("count")
    held = dealt.groupBy("length", "block").count()
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    dealt = dealt.withColumn("own", F.row_number().over(own) - 1).join(held, ["length", "block"])
    return dealt.withColumn("rank", F.col("before") + F.col("own")).drop("block", "before", "own")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Null and empty texts are a single end id. Texts are encoded whole, runs of white space or letters of any length
    too; strings of special tokens, as ``<|endoftext|>``, are plain text. Only documents longer than the capacity are cut; repeated
    rows are packed once each, a null id stays null, an empty table gives an empty result.
    """
    pieces = cut_lineage(tokenize(docs, id_col, text_col, path, capacity))
    counts = cut_lineage(pieces.groupBy("length").count())
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.collect():  # one row per length
        histogram[row["length"]] = row["count"]
    where = places(configurations(histogram, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            for l in np.unique(length):
                own = np.flatnonzero(length == l)
                first, start, n, at = where[int(l)]
                which = np.searchsorted(first, rank[own], side="right") - 1
                nth, slot = np.divmod(rank[own] - first[which], n[which])
                sequence[own], offset[own] = start[which] + nth, at[which] + slot * l
            yield b.drop(columns="rank").astype({"doc_id": "Int64"}).assign(sequence_id=sequence, offset=offset)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = [x.split()[0] for x in schema.split(", ")]
    return ranked(pieces, counts).select(*names, "rank").mapInPandas(place, schema + ", sequence_id long, offset long")
