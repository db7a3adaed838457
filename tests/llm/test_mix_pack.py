"""Mixing to target weights and packing."""

import functools
import re
import zlib

import numpy as np
import pytest

from panelcast.llm import mixing as M
from panelcast.llm import packing as P
from panelcast.llm.catalog import QUERIES

from odd_rows import SF, collected

SF01 = "/root/testdata/sf0.01"


def brute_targets(sizes, share=1.5, most=2.0):
    """Hands the excess on by weight, round after round."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        give = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if give[s] > most * sizes[s]]
        for s in over or list(free):
            target[s] = most * sizes[s] if over else give[s]
            rest -= target[s] if over else 0
            free.discard(s)
    return target


def test_mix_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").toPandas()
    found = QUERIES["op7_source_mixing"](spark, SF01).toPandas().merge(docs, on="doc_id")
    assert len(found) == len(docs)
    assert found["size"].tolist() == [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in found.text]
    by = found.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    target = brute_targets(by["size"].to_dict())
    assert (by["size"] == by.said).all() and np.allclose(by.target, [target[s] for s in by.index])
    assert ((by.taken - by.target).abs() <= by.largest).all()
    assert (found.taken <= 2 * found["size"]).all()
    again = QUERIES["op7_source_mixing"](spark, SF01).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(found.doc_id, found.taken))


def test_mix_keeps_words_and_expectations(spark):
    """Over many seeds a document is taken as often as its expectation says; words stay near the target."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "b" if i % 3 else "a") for i in range(150)], "doc_id long, text string, source string").cache()
    total = np.zeros(150)
    for seed in range(6):
        rows = M.mix(docs, seed=seed).toPandas().sort_values("id")
        total += rows.copies.to_numpy()
        for _, own in rows.groupby("source_size"):
            assert abs((own.copies * own["size"]).sum() - own.target.iloc[0]) <= 7
    expected = (rows.target / rows.source_size).to_numpy()
    assert abs(total.mean() / 6 - expected.mean()) < 0.05 and np.abs(total / 6 - expected).max() < 0.9


def test_mix_tree_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i % 10 else "b") for i in range(200)], "doc_id long, text string, source string")
    rows = M.mix(docs).toPandas()
    assert sorted(rows.id) == list(range(200))
    for _, own in rows.groupby("source_size"):
        assert abs((own.copies * own["size"]).sum() - own.target.iloc[0]) <= 5


def test_mix_on_odd_rows(odd_docs, no_docs):
    found = collected(M.mix(odd_docs))
    assert len(found) == 12 and all(0 <= r["copies"] <= 2 for r in found)
    assert all(r["size"] == 0 for r in found if r["id"] in (1, 2, 3))
    assert M.mix(no_docs).count() == 0


@functools.cache
def tokenizer():
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encoded(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def packed_right(rows, texts, capacity=2048):
    for doc_id, text in texts.items():
        ids = np.array([*encoded(text), 0], dtype="<u4")
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        at = 0
        for n, r in enumerate(own):
            assert r["piece"] == n and r["start"] == at and (r["length"] == capacity or n == 0) and r["length"] <= capacity
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(own) == -(-len(ids) // capacity)
    gapless(rows, capacity)


def gapless(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_query_against_the_tokenizer(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = collected(QUERIES["op8_best_fit_packing"](spark, SF))
    packed_right(rows, texts)
    assert gapless(rows, 2048) <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


def test_pack_on_odd_rows(spark, odd_docs, no_docs):
    rows = collected(P.pack(odd_docs))
    gapless(rows, 2048)
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert len([r for r in rows if r["doc_id"] == 5]) == 2
    special = spark.createDataFrame([(1, "<|endoftext|> x  y  z\n\n é😀 'Ll 's ½ ²"), (2, "\r\n \t x")], "doc_id long, text string")
    packed_right(collected(P.pack(special)), {1: "<|endoftext|> x  y  z\n\n é😀 'Ll 's ½ ²", 2: "\r\n \t x"})
    assert P.pack(no_docs).count() == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "x" + "\u00a0" * 1_000_000 + "y", "a" * 1_000_000, "ab" + " " * 900_000 + "b" + "\n" * 5000 + " c",
                                  "x" + " \n" * 5000 + "\x1c" * 5000 + "  y", "\t" * 5000 + "\r", " \u3000" * 3000 + "\u2029x"])
def test_long_runs_are_encoded_as_the_tokenizer_does(text):
    assert P.encoder(P.vocabulary())(text) == encoded(text)


def test_pack_of_a_million_spaces(spark):
    texts = {1: " " * 1_000_000, 2: "x" + "\n" * 1_000_000 + "y"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    packed_right(collected(P.pack(docs)), texts)


def test_common_lengths_are_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED", 7)
    docs = spark.createDataFrame([(i, "same words here" if i % 3 else f"w{i} " * (i % 40)) for i in range(400)], "doc_id long, text string")
    rows = collected(P.pack(docs, capacity=64))
    assert sorted({r["doc_id"] for r in rows}) == list(range(400))
    assert gapless(rows, 64) <= 1.05 * sum(r["length"] for r in rows) / 64 + 1


@pytest.mark.parametrize("n", [0, 1, 30, 5000])
def test_configurations_cover_the_histogram(n):
    rng = np.random.default_rng(n)
    count = np.bincount(np.minimum(256, 1 + rng.lognormal(4, 1, n).astype(int)), minlength=257) if n else np.zeros(257, np.int64)
    plan, held = P.configurations(count, 256, rounds=60), np.zeros(257, np.int64)
    for own, times in plan:
        assert sum(l * k for l, k in own.items()) <= 256 and times > 0
        for l, k in own.items():
            held[l] += k * times
    assert (held == count).all()
    used = sum(times for _, times in plan)
    assert used <= 1.05 * (np.arange(257) * count).sum() / 256 + 1


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(1)
    price = np.where(rng.random(13) < 0.7, rng.random(13), -np.inf)
    best = [0.0] * 13
    for c in range(1, 13):
        best[c] = max([best[c - 1], *(price[l] + best[c - l] for l in range(1, c + 1))])
    found = P.knapsack(price, 12)
    assert sum(l * n for l, n in found.items()) <= 12 and np.isclose(sum(price[l] * n for l, n in found.items()), best[12])
