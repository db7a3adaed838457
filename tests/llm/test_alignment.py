"""Alignment of two tokenizers against plain loops with the tokenizers' own libraries."""

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import alignment as A
from panelcast.llm.catalog import QUERIES
from panelcast.llm.packing import vocabulary

from odd_rows import DOC, SF, clashing, collected
from test_mix_pack import tokenizer

NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@functools.cache
def pieces():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@functools.cache
def bytes_of():
    return {rank: token for token, rank in vocabulary().items()}


def tokens(text):
    """((id, start, end) of A, of B), or nothing."""
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    b = pieces().encode(text)
    spell = lambda i: bytes([int(pieces().id_to_piece(i)[3:5], 16)]) if pieces().is_byte(i) else pieces().id_to_piece(i).replace("▁", " ").encode()
    for ids, held in ((tokenizer().encode(" " + text, add_special_tokens=False).ids, bytes_of().get), (b, spell)):
        at, own, joined = 0, [], b""
        for i in ids:
            token = held(i)
            own.append((i, at, at + len(token)))
            at += len(token)
            joined += token
        if joined != whole:
            return [], []
        out.append(own)
    return tuple(out)


def brute(rows):
    links, groups, sides = [], [], []
    for _, text in rows:
        a, b = tokens(text)
        sides.append((len(a), len(b)))
        links.append([(x, y) for x, s, e in a for y, u, v in b if max(s, u) < min(e, v)] if len(a) < 300 else overlaps(a, b))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        found, start = [], 0
        for end in ends:
            own = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)] if len(a) < 300 else None
            found.append("|".join(own) if own else "")
            start = end
        groups.append((len(ends), ";".join(found) if len(a) < 300 else None))
    count = Counter(x for own in links for x in own)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), own, (n, text), (a, b) in zip(rows, links, groups, sides):
        digest = "" if not a else hashlib.sha256(text.encode()).hexdigest() if text is not None else None
        out.append((doc_id, a, b, n, len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), digest))
    return out


def overlaps(a, b):
    """The same for long texts: one byte after the other."""
    of_a, of_b = ([i for i, (_, s, e) in enumerate(side) for _ in range(e - s)] for side in (a, b))
    return [(a[i][0], b[j][0]) for i, j in dict.fromkeys(zip(of_a, of_b))]


def run(df):
    return sorted((tuple(r[c] for c in NAMES) for r in collected(A.align(df))), key=str)


def same(found, expected):
    """A digest that the loops leave open is not compared."""
    expected = sorted(expected, key=lambda r: str(r[:7]))
    found = sorted(found, key=lambda r: str(r[:7]))
    assert len(found) == len(expected)
    for x, y in zip(found, expected):
        assert x[:7] == y[:7] and (y[7] is None or x[7] == y[7])


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(3)
    parts = [*"aaabc  \n\t  .,'s!1é😀  ▁x\x1c\rT", "  ", " the", " of", "'ll", "<s>", "</s>", "<0x41>", "<|endoftext|>", "ﬁ", "½", "​", "﻿", "한국"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for i in range(400)]
    rows += [(None, "null id"), (None, "null id"), (7, "the of the of"), (7, "the of the of"), (2**60 + 1, "large id"), (500, None), (501, ""), (502, " "), (503, "a\x00b")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_loops(spark, strange, monkeypatch, small):
    if small:  # many flushes, rounds of merging, frames and forgotten stretches
        for name, value in dict(CHARS=200, DOCS=9, FAN=2, FRAME=5, HELD=300, BATCH=7).items():
            monkeypatch.setattr(A, name, value)
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in strange], DOC)
    same(run(clashing(df)), brute(strange))


def test_query_against_plain_loops(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = [tuple(r[c] for c in NAMES) for r in collected(QUERIES["op13_token_alignment"](spark, SF))]
    same(found, brute(rows))


def test_long_runs_and_no_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(20, "a" * 200_000), (21, "x" + " " * 300_000 + "y"), (22, " " * 20_000)]
    same(run(spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOC)), brute(rows))
    assert A.align(no_docs).count() == 0
    none = spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], DOC)
    assert run(none) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_merging_runs():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 300, size=n)).astype(np.uint64) << np.uint64(30) for n in (1, 50, 200, 400)]
    blocks = lambda p: ((p[i : i + 7], np.arange(i, i + len(p[i : i + 7]))) for i in range(0, len(p), 7))
    total = Counter()
    for p in runs:
        total.update(dict(zip(p.tolist(), range(len(p)))))
    found = [*A.merged([blocks(p) for p in runs])]
    pair, count = (np.concatenate(x).tolist() for x in zip(*found))
    assert pair == sorted({v for p in runs for v in p.tolist()}) and all(total[p] == c for p, c in zip(pair, count))
    best = {}
    for p, c in zip(pair, count):
        best[p >> 32] = max(best.get(p >> 32, 0), c)
    for p, c, top in A.highest(iter(found)):
        assert [best[x >> 32] == y for x, y in zip(p.tolist(), c.tolist())] == top.tolist()
