import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.llm import lattice as L
from panelcast.llm import topk as T
from panelcast.llm.catalog import QUERIES

from odd_rows import SF, collected

VEC = "vec_id long, embedding array<float>, label int, node string, rank string, n_links string"


def brute(vectors, ids, least=0.9):
    x = np.array(vectors, dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, True)
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 10**12).min(1)
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


@pytest.fixture(scope="module")
def clouds():
    """Clouds at all distances, among them links of cosine just above the threshold."""
    rng = np.random.default_rng(2)
    rows = []
    for spread in (0.0, 0.02, 0.04, 0.055):
        for _ in range(6):
            centre = rng.normal(size=64) / 8
            rows += [centre + rng.normal(size=64) * spread for _ in range(12)]
    rows += list(rng.normal(size=(200, 64)) / 8)
    return np.array(rows, dtype=np.float32)


def test_recall_and_precision(spark, clouds):
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "", "") for i, v in enumerate(clouds)], VEC)
    found = L.lattice_dedup(df).toPandas().sort_values("id")
    links, label = brute(clouds, range(len(clouds)))
    assert (found.n_links.to_numpy() <= links).all()
    assert found.n_links.sum() >= 0.95 * links.sum()
    pairs = found.component_id.to_numpy()
    assert all(label[i] == label[c] for i, c in enumerate(pairs))  # no link that is none
    assert (found.kept == (found.id == found.component_id)).all()


@pytest.mark.parametrize("dim", [4, 8, 16, 32, 64, 256])
def test_recall_in_every_dimension(dim):
    """Pairs at a cosine of exactly 0.95, as the lattice cells meet them."""
    rng = np.random.default_rng(dim)
    a, b = rng.normal(size=(2, 3000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    met = np.zeros(len(a), bool)
    for t in range(L.TABLES):
        own, other = (L.cells(v, t, L.VISITS, L.SCALE) for v in (a, b))
        met |= (own[:, :1] == other).any(1) | (other[:, :1] == own).any(1)
    assert met.mean() >= 0.95


@pytest.mark.parametrize("dim", [4, 5, 6, 8, 12, 16, 32, 64, 128, 256, 768, 1536])
def test_recall_and_chance_meetings_in_every_dimension(dim):
    """Pairs at a cosine of exactly 0.9 meet as a rule, vectors that have nothing in common hardly ever."""
    rng = np.random.default_rng(dim)
    a, b, other = rng.normal(size=(3, 2000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other /= np.linalg.norm(other, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.9**2) * b / np.linalg.norm(b, axis=1)[:, None]
    met, chance = np.zeros((2, len(a)), bool)
    for t in range(L.TABLES):
        x, y, z = (L.cells(v, t, L.VISITS, L.SCALE) for v in (a, b, other))
        met |= (x[:, :1] == y).any(1) | (y[:, :1] == x).any(1)
        chance |= (x[:, :1] == z).any(1) | (z[:, :1] == x).any(1)
    assert met.mean() >= 0.9
    assert chance.mean() <= (0.03 if dim >= 8 else 0.06)  # of four dimensions, 2 % are links by chance


def test_large_cells_are_split(spark, clouds, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "GROUP", 64)
    df = spark.createDataFrame([(i, v.tolist(), 0, "", "", "") for i, v in enumerate(clouds[:150])], VEC)
    found = L.lattice_dedup(df).toPandas().sort_values("id")
    links, label = brute(clouds[:150], range(150))
    assert found.n_links.tolist() == links.tolist() or found.n_links.sum() >= 0.95 * links.sum()


def test_query_against_brute_force(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    found = QUERIES["op2_lattice_near_dedup"](spark, SF).toPandas().sort_values("vec_id")
    links, label = brute(list(e.embedding), e.vec_id.tolist())
    assert found.n_links.tolist() == links.tolist() and found.component_id.tolist() == label.tolist()


def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 0.0]), (11, [1e38, 2e38]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]
    return spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows], VEC)


def test_lattice_on_odd_rows(spark):
    found = collected(L.lattice_dedup(odd(spark)))
    assert len(found) == 14
    linked = [r for r in found if r["component_id"] == 0]
    assert sorted(str(r["id"]) for r in linked) == ["0", "1", "1", "11", "2", "None"] and {r["n_links"] for r in linked} == {5}
    assert all(r["n_links"] == 0 and r["kept"] for r in found if r["id"] in (3, 4, 5, 6, 7, 8, 9, 10))
    assert L.lattice_dedup(odd(spark).where("false")).count() == 0


def test_lattice_points():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 3
    p = L.nearest_e8(x)
    assert np.isin(np.abs((p * 2) % 2), (0, 1)).all() and ((p.sum(1) % 2) == 0).all()
    around = L.roots()
    assert len({tuple(r) for r in around}) == 240 and np.allclose((around**2).sum(1), 2)
    other = ((x[:, None] - (p[:, None] + around)) ** 2).sum(2).min(1)
    assert (((x - p) ** 2).sum(1) <= other + 1e-9).all()


def brute_top(rows, queries, k):
    out = []
    for qi, (q, qv) in queries:
        scored = sorted((-int(np.dot(np.floor(64 * np.array(qv)), np.floor(64 * np.array(v)))), i) for n, (i, v) in enumerate(rows) if n != qi)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 32)
    monkeypatch.setattr(T, "SHARD", 100)
    monkeypatch.setattr(T, "QUERIES", 5)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 16)), 1)
    v[100:140] = v[7]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([(i, x, 0, "", "", "") for i, x in rows], "vec_id long, embedding array<double>, label int, node string, rank string, n_links string")
    found = sorted(tuple(r) for r in T.top_k(df, F.col("id") % 20 == 0, k=20).collect())
    assert found == brute_top(rows, [(n, r) for n, r in enumerate(rows) if r[0] % 20 == 0], 20)


def test_top_k_on_odd_rows(spark):
    found = collected(T.top_k(odd(spark), F.col("id") % 2 == 0, k=20))
    assert {r["query_id"] for r in found} == {0, 2, 4, 10}  # 6 and 8 hold no usable vector
    best = [r for r in found if r["query_id"] == 0]
    assert best[0]["vec_id"] == 11 and best[0]["score"] == 2**63 - 1
    assert [r["vec_id"] for r in best[1:3]] == [2, 1] and sum(r["vec_id"] == 1 for r in best) == 2
    assert T.top_k(odd(spark).where("false"), F.col("id") % 2 == 0).count() == 0


def test_scores_beyond_64_bits_are_ranked_by_their_values(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 3)
    rows = [(0, [1e30, 1.0])] + [(i, [s * 1e30 * i, 0.0]) for i in range(1, 9) for s in ((1,) if i % 2 else (-1,))] + [(9, [1e-9, 5.0])]
    df = spark.createDataFrame([(i, v, 0, "", "", "") for i, v in rows], VEC.replace("float", "double"))
    found = collected(T.top_k(df, F.col("id") == 0, k=20))
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [7, 5, 3, 1, 9, 2, 4, 6, 8]
    assert [r["score"] for r in sorted(found, key=lambda r: r["rank"])] == [2**63 - 1] * 4 + [64 * 320] + [-(2**63)] * 4
