import random
import re

import numpy as np
import pytest

from panelcast.llm import linededup as L

from odd_rows import DOC, clashing, collected


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(rows):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["id"], r["text"], r["n_lines"], r["n_dropped"]) for r in collected(df)), key=str)


def frame(spark, rows):
    return clashing(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOC))


def some(n, seed=1, first=0):
    rng = random.Random(seed)
    lines = [f"  Line number {k} that REPEATS é {'x' * (k % 9)}" for k in range(60)] + ["short", "", "ÄÖÜ" * 7, "ÄÖÜ" * 6 + "Ä"]
    ends = ["", " ", "\t", "\r", " \x0b\x0c", "\x1c", " "]
    pick = lambda: rng.choice(lines if rng.random() < 0.7 else [f"own line {rng.random()} of one text"]) + rng.choice(ends)
    rows = [(first + i, "\n".join(pick() for _ in range(rng.randint(0, 8)))) for i in range(n)]
    return [(i, t + "\nThis Line stands in every document") for i, t in rows]


@pytest.fixture
def small(monkeypatch):
    """Many shards, chunks and full filters."""
    for name, value in dict(SHARD=4, CHUNK=20, BUCKETS=4, CELLS=2, TURNS=6).items():
        monkeypatch.setattr(L, name, value)


def test_against_plain_loops(spark):
    rows = some(120)
    assert found(L.dedup_lines(frame(spark, rows))) == brute(rows)


def test_shards_chunks_and_stash(spark, small):
    rows = some(150, 2)
    index = L.LineIndex.empty(spark).changed(L.keys_of(frame(spark, rows)))
    assert index.shards > 4 and 4 < index.filters.count() <= index.shards
    assert found(index.dedup(frame(spark, rows))) == brute(rows)


def state(index):
    table = lambda df: sorted(tuple(r) for r in df.collect())
    marks = {}
    for r in index.filters.collect():
        own = L.Cuckoo(r["cells"], r["stash"])
        marks[r["shard"]] = sorted(own.cells[own.cells != 0].tolist() + [x >> 32 for x in own.stash])
    return table(index.refs), table(index.counts), {k: v for k, v in marks.items() if v}


@pytest.mark.parametrize("tight", [False, True])
def test_insertions_and_deletions(spark, request, tight):
    if tight:
        request.getfixturevalue("small")
    a, b = some(60, 3), some(40, 4, first=1000)
    one = L.LineIndex.empty(spark).insert(frame(spark, a))
    both = one.insert(frame(spark, b))
    whole = L.LineIndex.empty(spark).insert(frame(spark, a + b))
    assert state(both)[:2] == state(whole)[:2]
    assert found(both.dedup(frame(spark, a + b))) == brute(a + b)
    assert found(both.dedup(frame(spark, a))) == [r for r in brute(a + b) if r[0] < 1000]  # read again, against all
    back = both.delete(spark.createDataFrame([(i,) for i, _ in b] + [(5000,), (None,)], "doc_id long"))
    assert state(back)[:2] == state(one)[:2]
    if both.shards == one.shards:
        assert state(back)[2] == state(one)[2]
    assert found(back.dedup(frame(spark, a))) == brute(a)
    none = back.delete(spark.createDataFrame([(i,) for i, _ in a], "doc_id long"))
    assert state(none) == ([], [], {})


def test_odd_rows(spark, odd_docs, no_docs):
    line = "the very same line in all of them"
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows += [(30, line), (30, line), (31, line + "\n\n" + line), (31, "another text of 31\n" + line), (None, line), (32, " " + line.upper()), (33, "x" * 19 + "\ny")]
    rows += [(40, "w\n" * 30_000 + line), (2**60 + 1, "large id alone, not repeated")]
    assert found(L.dedup_lines(frame(spark, rows))) == brute(rows)
    assert L.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3000, 12_000, 40_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, size=n, dtype=np.int64)
    f = L.Cuckoo()
    f.insert(keys)
    assert f.contains(keys).all()
    assert (f.cells != 0).sum() + len(f.stash) == n and (n > 15_000 or not f.stash)
    other = rng.integers(-(2**63), 2**63 - 1, size=20_000, dtype=np.int64)
    assert f.contains(other).mean() < 0.001 or n > 15_000
    f = L.Cuckoo(f.cells.tobytes(), f.stash)
    f.delete(keys[: n // 2])
    assert f.contains(keys[n // 2 :]).all() and (f.cells != 0).sum() + len(f.stash) == n - n // 2
    f.delete(keys[n // 2 :])
    assert not f.cells.any() and not f.stash
