import hashlib

import numpy as np
import pytest

from panelcast.llm import codes as C
from panelcast.llm.catalog import QUERIES

from odd_rows import SF, collected

VEC = "vec_id long, embedding array<double>, label int, id string, code string, error string"


def brute(rows, entries=16, parts=8, rounds=6):
    """Plain loops over Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[int(np.floor(4096.0 * x)) if abs(x) < 1e15 else int(x) * 4096 for x in v] for _, v, _ in rows]
    width = -(-max(map(len, vectors)) // parts)
    vectors = [v + [0] * (width * parts - len(v)) for v in vectors]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in vectors[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in vectors:
            best = [min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p])) for p in range(parts)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for v, f in zip(vectors, found) if f[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, found = [], assign()
    by_label = {}
    for (_, _, label), f in zip(rows, found):
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in f)
    for (i, _, label), f in zip(rows, found):
        out.append((i, "".join(f"{j:02x}" for _, j in f), min(C.MOST, sum(d for d, _ in f)), min(C.MOST, by_label[label]), digest))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, n, "x", "y", "z") for i, v, n in rows], VEC).repartition(3)
    return sorted((tuple(r) for r in C.compress(df, **kw).select("id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(150, 16)), 1)
    v[20:60] = v[3]  # ties and repeated rows
    rows = [(i, x.tolist(), None if i % 3 == 0 else i % 2) for i, x in enumerate(v)]
    assert run(spark, rows) == brute(rows)


def test_query_against_plain_loops(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in e]
    found = QUERIES["op11_vector_codes"](spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kept = [(3, [1.0, 2.0], 1), (3, [1.0, 2.0], None), (1, [], None), (None, [0.5] * 9, 1), (7, [-1e30, 1e30, 1e9], 2), (8, [1e300], 2), (9, [-0.0001], 2)]
    dropped = [(4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (2, [1.0, None], 1)]
    assert run(spark, kept + dropped) == brute(kept)
    assert run(spark, dropped) == [] and run(spark, []) == []
    only = [(1, [], None), (2, [], 5)]
    assert run(spark, only) == brute(only)
    with pytest.raises(ValueError):
        run(spark, kept, entries=257)


@pytest.mark.parametrize("size", [1, 10, 2**20, 2**31, 2**55, 2**90])
def test_tree_finds_every_nearest_entry(size):
    """Also among ties, repeated entries and numbers that no float holds."""
    rng = np.random.default_rng(5)
    for k in (1, 3, 16, 100):
        draw = lambda n: np.array([[int(x) * size for x in row] for row in rng.integers(-4, 5, size=(n, 3))], dtype=object)  # noqa: E731, B023
        entries, q = draw(k), draw(200)
        q[0] += 1
        if size < 2**40:
            entries, q = entries.astype(np.int64), q.astype(np.int64)
        at, apart = C.trees([entries], q)[0].nearest(q)
        for i, v in enumerate(q.tolist()):
            assert (int(apart[i]), at[i]) == min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(entries.tolist()))


def test_tree_leaves_out_subtrees(monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.integers(-(10**6), 10**6, size=(16, 4))
    entries = (centres[:, None] + rng.integers(-50, 50, size=(16, 16, 4))).reshape(-1, 4)
    tree, seen, distance = C.Gnat(entries), [], C.Gnat.distance
    monkeypatch.setattr(C.Gnat, "distance", lambda self, x, at: seen.append(len(x) * len(at)) or distance(self, x, at))
    q = entries[:, :] + 1
    at, _ = tree.nearest(q)
    assert (at == np.array([((entries - v) ** 2).sum(1).argmin() for v in q])).all()
    assert sum(seen) < 0.3 * len(q) * len(entries)
