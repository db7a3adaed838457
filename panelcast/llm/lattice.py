"""Embedding near-duplicates by lattice hashing.

Every vector, scaled to length one, is projected to eight random dimensions in each of several tables and
decoded to the nearest point of the E8 lattice: its home cell. It also visits the neighbouring cells
whose lattice points are next nearest. Vectors that meet in a cell, one of them at home, are
verified by cosine in double precision; the links found join vectors to components. The links of a vector
are then counted within its component, again by cosine, in blocks. Equal vectors are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage
from panelcast.llm.components import Forest, connected_components
from panelcast.llm.vectors import keyed, stacked, unit

TABLES, VISITS, SCALE, SEED = 4, 2, 5.0, 11  # the scale is that of DIM dimensions
DIM = 64
BLOCK = 2048  # vectors of a cell or component compared with one another
GROUP = 8192  # rows of a task's group of small cells or components, on average


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points of even sum: where rounding gives an odd sum, the worst coordinate goes the other way."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the nearer of both."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cell_key(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of lattice points; a chance collision only adds a comparison."""
    key = np.full(len(points), salt + 1, dtype=np.uint64)
    for column in np.rint(points * 2).astype(np.int64).astype(np.uint64).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def cells(x: np.ndarray, table: int, visits: int, scale: float) -> np.ndarray:
    """Keys of the home cell and of the visited ones, one row per vector of length one.

    A projection to eight of ``dim`` dimensions shrinks distances by sqrt(8 / dim), and not at all below eight: the
    scale makes up for it, so that links are as long in cells as those of DIM dimensions, and so are the
    distances of vectors that have nothing in common. Below DIM cells are a twentieth larger, as lengths vary less there.
    """
    dim = x.shape[1]
    scale = scale * np.sqrt(max(dim, 8) / DIM) * (0.95 if dim < DIM else 1.0)
    rng = np.random.default_rng([SEED, table, dim])
    axes = np.linalg.qr(rng.normal(size=(max(dim, 8), 8)))[0][:dim]
    point = x @ axes * scale + rng.uniform(0, 1, 8)
    home = nearest_e8(point)
    around = roots()
    nearest = np.argsort(-((point - home) @ around.T), axis=1, kind="stable")[:, :visits]
    salt = table * 1_000_003 + dim
    return np.stack([cell_key(home, salt), *(cell_key(home + around[nearest[:, i]], salt) for i in range(visits))], axis=1)


def by_length(vectors) -> Iterator[np.ndarray]:
    """Positions of the vectors of each length: vectors of different lengths link with nothing."""
    size = np.array([len(v) for v in vectors])
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def cell_rows(distinct: DataFrame, tables: int, visits: int, scale: float) -> DataFrame:
    """(rep, cell, home) for every cell a vector lives in or visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own in by_length(b["vec"]):
                x, rep = unit(stacked(b["vec"].iloc[own])), b["rep"].to_numpy()[own]
                for t in range(tables):
                    keys = cells(x, t, visits, scale)
                    for i in range(visits + 1):
                        yield pd.DataFrame({"rep": rep, "cell": keys[:, i], "home": i == 0})

    return distinct.select("rep", "vec").mapInPandas(run, "rep long, cell long, home boolean")


def dealt(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """``rows`` with (g, i, j): small keys share a group; the rows of a large one are split into blocks,
    and every block goes to the groups of all pairs of blocks it belongs to. ``sizes``: key and n."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // GROUP))
    large = F.col("n") > BLOCK
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
    at = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, at).alias("i"), F.greatest(k, at).alias("j")))
    alone = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    out = rows.join(sizes, key).withColumn("block", F.when(large, at).otherwise(-1))
    out = out.withColumn("pair", F.explode(F.when(large, pair).otherwise(alone)))
    group = F.when(large, F.col(key)).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    return out.select(*rows.columns, "block", group.alias("g"), "pair.i", "pair.j")


def blocks_of(group: pd.DataFrame, key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of each key of a group with their matrix, and which pairs are to be compared here."""
    for _, own in group.groupby(key, sort=False):
        for same in by_length(own["vec"]):
            if len(same) > 1:
                rows = own.iloc[same]
                yield rows, unit(stacked(rows["vec"]))


def new_pairs(rows: pd.DataFrame, at: slice) -> np.ndarray:
    """Of a pair of blocks, pairs across them; pairs within a block are left to the group (i, i)."""
    block, i, j = rows["block"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0]
    return block[at, None] != block[None, :] if i != j else np.ones((len(block[at]), len(block)), dtype=bool)


def cell_links(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between the vectors of each cell, as a forest: never all pairs of a group."""
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, x in blocks_of(group, "cell"):
        forest, home, rep = Forest(len(rows)), rows["home"].to_numpy(), rows["rep"].to_numpy()
        if not home.any():
            continue
        for a in range(0, len(x), 512):
            at = slice(a, a + 512)
            near = (x[at] @ x.T >= least) & (home[at, None] | home[None, :]) & new_pairs(rows, at)
            r, c = np.nonzero(near)
            keep = r + a < c
            forest.join(r[keep] + a, c[keep])
        member, root = forest.links()
        us.append(rep[member])
        vs.append(rep[root])
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})


def link_counts(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Other vectors linked with each distinct vector, as far as this group compares them."""
    reps, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, x in blocks_of(group, "root"):
        n, copies = np.zeros(len(rows), np.int64), rows["copies"].to_numpy()
        for a in range(0, len(x), 512):
            at = slice(a, a + 512)
            near = (x[at] @ x.T >= least) & new_pairs(rows, at)
            near[np.arange(len(near)), np.arange(len(near)) + a] = False
            n[at] = near @ copies
        reps.append(rows["rep"].to_numpy())
        counts.append(n)
    return pd.DataFrame({"rep": np.concatenate(reps), "n": np.concatenate(counts)})


def lattice_dedup(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9,
    tables: int = TABLES, visits: int = VISITS, scale: float = SCALE,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    vectors of different lengths. Equal vectors link with one another. Repeated rows and rows of a null
    id are vectors of their own; a component's id is its smallest id, null if it has none. An empty
    table gives an empty result.
    """
    own = keyed(rows, id_col, vec_col)
    linkable = own.where(F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0))
    classes = linkable.groupBy("vec").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("least"))
    distinct = cut_lineage(classes)
    held = cell_rows(distinct, tables, visits, scale)
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived").drop("lived")
    met = dealt(held, "cell", cut_lineage(sizes))
    met = met.join(distinct.select("rep", "vec"), "rep")
    links = met.groupBy("g", "i", "j").applyInPandas(lambda g: cell_links(g, least), "u long, v long")
    component = connected_components(links).withColumnRenamed("node", "rep")
    members = cut_lineage(distinct.join(component, "rep"))
    held = members.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    held = cut_lineage(held)
    inside = dealt(members.select("rep", "root", "vec", "copies"), "root", held.select("root", "n"))
    counts = inside.groupBy("g", "i", "j").applyInPandas(lambda g: link_counts(g, least), "rep long, n long")
    counts = counts.groupBy("rep").agg(F.sum("n").alias("others"))
    known = members.select("rep", "root").join(held.select("root", "component_id"), "root").join(counts, "rep", "left")
    known = known.select(F.col("rep").alias("r"), "component_id", "others")
    known = distinct.join(known, distinct["rep"] == known["r"], "left").select(
        F.col("vec").alias("v"),
        F.coalesce("component_id", "least").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    )
    known = cut_lineage(known)
    out = own.join(known, own["vec"] == known["v"], "left")
    component_id = F.coalesce("component_id", "id")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
