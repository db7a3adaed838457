"""SimHash near-duplicates: 64-bit fingerprints and an exact tiled comparison.

Distinct fingerprints are cut into tiles of similar population counts (four counts, one per
16-bit quarter). Two fingerprints differ in at least as many bits as the sum of the differences of
those counts, so a pair of tiles whose count ranges lie further apart than the radius is skipped;
every other pair of tiles is compared in full with numpy exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage
from panelcast.llm.components import Forest, connected_components

TILE = 4096  # fingerprints of a tile
GUESTS = 512  # tiles compared with one tile in a group, on average
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bits set in over half of the XXH64 values of the word shingles (repeats included)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    count, last = np.zeros(64, np.int64), n - shingle + 1
    for at in range(0, last, 65536):
        to = min(last, at + 65536)
        spans = zip(start[at:to].tolist(), end[at + shingle - 1 : to + shingle - 1].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > last).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, text_hash, fp) for every row; fp holds the 64 bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "text_hash": b["text_hash"], "fp": fp})

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    return rows.mapInPandas(run, "id long, text_hash long, fp long")


def quarter_counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row per fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def cut_cells(cells: np.ndarray, weight: np.ndarray, size: int = TILE) -> list[np.ndarray]:
    """Groups of cell numbers of at most ``size`` weight each (or of one cell), split at weighted medians."""
    todo, done = [np.arange(len(cells))], []
    while todo:
        own = todo.pop()
        spread = np.ptp(cells[own], axis=0)
        if weight[own].sum() <= size or not spread.any():
            done.append(own)
            continue
        axis = int(spread.argmax())
        own = own[np.argsort(cells[own, axis], kind="stable")]
        values = cells[own, axis]
        middle = values[np.searchsorted(np.cumsum(weight[own]), weight[own].sum() / 2)]
        at = np.searchsorted(values, middle if middle > values[0] else middle + 1)
        todo += [own[:at], own[at:]]
    return done


def near_links(group: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of one host tile with itself and its guests, as a forest: never all pairs of a group."""
    host = np.concatenate([np.asarray(x, np.int64) for x in group["fps"][group["host"] == group["tile"]]])
    guest = [np.asarray(x, np.int64) for x in group["fps"][group["host"] != group["tile"]]]
    whole = np.concatenate([host, *guest]).view(np.uint64)
    forest, pending, waiting = Forest(len(whole)), [], 0
    for at in range(0, len(host), 256):
        rows = whole[at : min(at + 256, len(host))]
        for start in range(0, len(whole), 8192):
            near = np.bitwise_count(rows[:, None] ^ whole[None, start : start + 8192]) <= radius
            r, c = np.divmod(np.flatnonzero(near), near.shape[1])
            r, c = r + at, c + start
            keep = r < c
            pending.append((r[keep], c[keep]))
            waiting += len(pending[-1][0])
            if waiting > 1_000_000:
                forest.join(*map(np.concatenate, zip(*pending)))
                pending, waiting = [], 0
    if waiting:
        forest.join(*map(np.concatenate, zip(*pending)))
    member, root = forest.links()
    signed = whole.view(np.int64)
    return pd.DataFrame({"u": signed[member], "v": signed[root]})


def fingerprint_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(u, v): links between distinct fingerprints of column ``fp`` at ``radius`` or fewer differing
    bits, thinned to a forest within each tile comparison; components are those of all links."""

    def cell_of(fp: np.ndarray) -> np.ndarray:
        return quarter_counts(fp).astype(np.int64) @ np.array([4913, 289, 17, 1])

    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    cell = sum((q.cast("long") * w for q, w in zip(quarter, (4913, 289, 17, 1))), F.lit(0).cast("long"))
    held = distinct.groupBy(cell.alias("cell")).count().collect()  # 17^4 cells at most, whatever the input
    number = np.array(sorted(r["cell"] for r in held), dtype=np.int64)
    weight = np.array([r["count"] for r in sorted(held, key=lambda r: r["cell"])], dtype=np.int64)
    counts = np.stack([number // w % 17 for w in (4913, 289, 17, 1)], axis=1).astype(np.int16).reshape(-1, 4)
    first, parts, low, high = np.zeros(len(number), np.int64), np.ones(len(number), np.int64), [], []
    for own in cut_cells(counts, weight) if len(number) else []:
        first[own], parts[own] = len(low), -(-weight[own].sum() // TILE)
        low += [counts[own].min(0)] * int(parts[own[0]])
        high += [counts[own].max(0)] * int(parts[own[0]])
    lows, highs = np.array(low, np.int16).reshape(-1, 4), np.array(high, np.int16).reshape(-1, 4)
    chunks = max(1, -(-len(lows) // GUESTS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            at = np.searchsorted(number, cell_of(fp))
            mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield pd.DataFrame({"fp": fp, "tile": first[at] + (mixed % parts[at].astype(np.uint64)).astype(np.int64)})

    def invite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sends a tile to every earlier tile within the radius, and to all chunks of its own."""
        for b in batches:
            for tile, fps in zip(b["tile"], b["fps"]):
                gap = np.maximum(0, np.maximum(lows[:tile] - highs[tile], lows[tile] - highs[:tile])).sum(1)
                hosts = np.flatnonzero(gap <= radius)
                for at in range(0, len(hosts), 64):
                    own = hosts[at : at + 64]
                    yield pd.DataFrame({"host": own, "chunk": tile % chunks, "tile": tile, "fps": [fps] * len(own)})
                for chunk in range(chunks):
                    yield pd.DataFrame({"host": [tile], "chunk": chunk, "tile": tile, "fps": [fps]})

    tiles = distinct.select("fp").mapInPandas(deal, "fp long, tile long").groupBy("tile")
    tasks = 4 * distinct.sparkSession.sparkContext.defaultParallelism
    tiles = tiles.agg(F.collect_list("fp").alias("fps"))
    tiles = tiles.repartition(max(1, min(len(lows), max(tasks, len(lows) // 64))), "tile")  # small rows that fan out: not for one task
    guests = tiles.mapInPandas(invite, "host long, chunk long, tile long, fps array<long>")
    pairs = len(lows) * chunks
    guests = guests.repartition(max(1, min(pairs, max(tasks, pairs // 16))), "host", "chunk")  # by work, not by bytes
    return guests.groupBy("host", "chunk").applyInPandas(lambda g: near_links(g, radius), "u long, v long")


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(id, text_hash, fp, root, component_id) for every row: component_id is the smallest id reachable
    by links, root the component's own key.

    Null or word-less texts have fingerprint zero and link like any other. Rows with equal
    fingerprints are one node, so copies never multiply links; repeated rows each keep a row. A
    null id stays null and names no component, unless all ids of its component are null.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(fingerprint_links(distinct, radius))
    linked = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("least"))
    moved = roots.join(least, "root").select(F.col("node").alias("fp"), "root", F.col("least").alias("joined"))
    component = distinct.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("joined", "least").alias("component_id")
    )
    return prints.join(cut_lineage(component), "fp").select("id", "text_hash", "fp", "root", "component_id")


def fingerprint_hex(fp) -> object:
    """16 lower-case hex digits of a signed long column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
