import numpy as np
import pandas as pd
import xxhash

from panelcast.llm import simhash as S
from panelcast.llm.catalog import QUERIES
from panelcast.llm.components import Forest, connected_components

from odd_rows import SF, collected


def brute_components(fps, ids, radius):
    near = np.array([[bin(a ^ b).count("1") <= radius for b in fps] for a in fps])
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 10**12).min(1)
        if (new == label).all():
            return label
        label = new


def brute_fingerprint(text, n=4):
    words = [w for w in (text or "").encode().lower().replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    found = QUERIES["op1_simhash_near_dedup"](spark, SF).toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in docs.text]
    assert found.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert found.component_id.tolist() == brute_components(fps, docs.doc_id.tolist(), 4).tolist()


def test_odd_rows(odd_docs, no_docs):
    found = collected(S.simhash_dedup(odd_docs))
    assert len(found) == 12
    zero = [r for r in found if r["fp"] == 0]
    assert {r["id"] for r in zero} == {1, 2, 3, None} and {r["component_id"] for r in zero} == {1}
    assert sorted(r["id"] for r in found if r["component_id"] == 4) == [4, 5, 5]
    assert S.simhash_dedup(no_docs).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    """Small tiles and chunks, dense groups and chains: components equal those of all pairs."""
    monkeypatch.setattr(S, "TILE", 16)
    monkeypatch.setattr(S, "GUESTS", 4)
    rng = np.random.default_rng(5)
    fps = set(int(x) for x in rng.integers(0, 2**63, 150, dtype=np.uint64))
    for base in list(fps)[:6]:
        for _ in range(30):
            flipped = base
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                flipped ^= 1 << int(bit)
            fps.add(flipped)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame(pd.DataFrame({"fp": fps}))
    links = S.fingerprint_links(df, 4)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    mine = {}
    for f in fps.tolist():
        mine.setdefault(roots.get(f, f), set()).add(f)
    label = brute_components([int(f) & (2**64 - 1) for f in fps.tolist()], list(range(len(fps))), 4)
    theirs = {}
    for f, one in zip(fps.tolist(), label):
        theirs.setdefault(one, set()).add(f)
    assert {frozenset(s) for s in mine.values()} == {frozenset(s) for s in theirs.values()}


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(path + star + [(7, 7), (5000, 5000), (None, 3), (1, 0)], "u long, v long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(1000, 1050)}) == 1
    assert roots[0] != roots[1000] and 5000 not in roots
    assert connected_components(edges.where("false")).count() == 0


def test_forest():
    forest = Forest(6)
    forest.join(np.array([0, 4, 3]), np.array([2, 5, 4]))
    member, root = forest.links()
    assert dict(zip(member.tolist(), root.tolist())) == {2: 0, 4: 3, 5: 3}
