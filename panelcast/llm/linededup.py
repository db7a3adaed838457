"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is its digest after stripping and lower-casing. The *references* say which documents hold a key, and with how many lines;
the *counts* say how many documents do, and which of them has the largest id. Keys held by enough documents are *repeated*: they
are entered into the cuckoo filter of their shard, and taken out again when deletions bring their count down, which is what these
filters allow. Documents are read against the filters: most keys are turned away there, the rest is looked up in the exact table of the shard.

All tables are keyed by digests, so a shard holds about ``SHARD`` repeated keys however the lines are distributed, and the number of
shards grows with their number. Counting combines on the map side. The keys of a shard that many documents ask for are dealt to
``chunks`` by document, each with a copy of the shard's small tables; a line that stands in every document is thus spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage, fresh_folder

LEAST_CHARS, LEAST_DOCS = 20, 3
SHARD = 8192  # repeated keys of a shard, on average
BUCKETS, CELLS = 4096, 4  # of a filter: half full on average
TURNS = 200  # moves before a fingerprint goes to the stash
CHUNK = 16_384  # keys that meet a shard's tables in one group
BLANK = b" \t\n\v\f\r"
KEY = ["hi", "lo"]


def line_keys(text: str, least: int = LEAST_CHARS) -> list[bytes | None]:
    """The 16-byte key of every line; none for one that is too short to count."""
    out = []
    for line in text.encode().lower().split(b"\n"):  # bytes: A-Z only
        line = line.strip(BLANK)
        long = len(line) >= least and (len(line) >= 4 * least or len(line.decode()) >= least)
        out.append(hashlib.blake2b(line, digest_size=16).digest() if long else None)
    return out


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, version, hi, lo, n): the keys of every document and their lines; ``version`` tells apart the texts of one id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, versions, counts, keys = [], [], [], []
            for doc_id, version, text in zip(b["doc_id"], b["version"], b["text"]):
                held: dict[bytes, int] = {}
                for key in line_keys(text, least):
                    if key is not None:
                        held[key] = held.get(key, 0) + 1
                ids += [doc_id] * len(held)
                versions += [version] * len(held)
                counts += held.values()
                keys += held
            both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": ids, "version": versions, "hi": both[:, 0], "lo": both[:, 1], "n": counts}).astype("int64")

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), version(F.col(text_col)), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, version long, hi long, lo long, n long")


def version(text: Column) -> Column:
    return F.xxhash64(text).alias("version")


class Cuckoo:
    """Approximate set of 64-bit keys that allows deletions; fingerprints without a cell are kept in a stash."""

    def __init__(self, cells: bytes | None = None, stash=()):
        self.cells = np.zeros((BUCKETS, CELLS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(-1, CELLS).copy()
        self.stash = [int(x) for x in stash]

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint and first bucket."""
        keys = keys.astype(np.int64).view(np.uint64)
        return np.maximum(keys >> np.uint64(48), 1).astype(np.int64), (keys % np.uint64(len(self.cells))).astype(np.int64)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark * 0x5BD1E995 >> 7 & len(self.cells) - 1)

    def name(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return mark << 32 | np.minimum(bucket, self.other(bucket, mark))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, bucket = self.place(keys)
        held = [(self.cells[b] == mark[:, None]).any(axis=1) for b in (bucket, self.other(bucket, mark))]
        return held[0] | held[1] | np.isin(self.name(mark, bucket), self.stash)

    def settle(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts as many as there are free cells; returns the others, those of one bucket together."""
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        taken = self.cells[bucket] != 0
        fits = rank < CELLS - taken.sum(axis=1)
        at = np.argsort(taken, axis=1, kind="stable")[fits, rank[fits]]
        self.cells[bucket[fits], at] = mark[fits]
        return mark[~fits], bucket[~fits]

    def insert(self, keys: np.ndarray) -> None:
        mark, bucket = self.place(keys)
        for turn in range(TURNS):
            mark, bucket = self.settle(mark, bucket)
            if not len(mark):
                return
            if turn:  # both buckets were full: the first of every bucket moves one out
                first, cell = np.flatnonzero(np.diff(bucket, prepend=-1)), turn % CELLS
                out = self.cells[bucket[first], cell].astype(np.int64)
                self.cells[bucket[first], cell] = mark[first]
                mark[first] = out
            bucket = self.other(bucket, mark)
        self.stash += self.name(mark, bucket).tolist()

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        for mark, bucket in zip(*self.place(keys)):
            for b in (bucket, self.other(bucket, mark)):
                at = np.flatnonzero(self.cells[b] == mark)
                if len(at):
                    self.cells[b, at[0]] = 0
                    break
            else:
                self.stash.remove(int(self.name(mark, bucket)))


FILTERS = "shard long, cells binary, stash array<long>"


@dataclass(frozen=True)
class LineIndex:
    """References, counts and filters, each a table in the shared folder. Insertions and deletions give a new
    index and leave the old one as it is; a document inserted and deleted again leaves the same counts and filters behind, bar the cells
    that fingerprints lie in."""

    refs: DataFrame  # hi, lo, doc_id, n
    counts: DataFrame  # hi, lo, docs, top
    filters: DataFrame  # shard, cells, stash
    shards: int = 1
    least_docs: int = LEAST_DOCS
    least_chars: int = LEAST_CHARS

    @classmethod
    def empty(cls, spark: SparkSession, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> LineIndex:
        table = lambda schema: spark.createDataFrame([], schema)
        refs, counts = table("hi long, lo long, doc_id long, n long"), table("hi long, lo long, docs long, top long")
        return cls(refs, counts, table(FILTERS), 1, least_docs, least_chars)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Adds documents. One whose id is known already adds its lines to that document."""
        return self.changed(keys_of(docs, id_col, text_col, self.least_chars))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Takes out all documents with these ids; unknown and null ones are ignored."""
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        return self.changed(self.refs.join(gone, "doc_id", "left_semi").withColumn("n", -F.col("n")))

    def changed(self, delta: DataFrame) -> LineIndex:
        """The index after ``delta`` (hi, lo, doc_id, n): lines that came (n > 0) or went (n < 0)."""
        spark = delta.sparkSession
        folder = fresh_folder(spark, "lines")

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        delta = written(delta.select(*KEY, "doc_id", "n"), "delta")
        refs = self.refs.unionByName(delta).groupBy(*KEY, "doc_id").agg(F.sum("n").alias("n"))
        refs = written(refs.where("n > 0"), "refs")
        found = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))  # combines on the map side
        counts = written(found, "counts")
        new = replace(self, refs=refs, counts=counts)
        shards = 1 << max(0, (max(1, new.repeated().count() // SHARD) - 1).bit_length())
        if shards > self.shards:  # all filters anew
            new = replace(new, shards=shards)
            moved = new.repeated().select(*KEY, F.lit(True).alias("came"))
            old = self.filters.where("false")
        else:
            before = self.repeated().select(*KEY, F.lit(True).alias("was"))
            after = new.repeated().select(*KEY, F.lit(True).alias("came"))
            moved = before.join(after, KEY, "full").where("was is null or came is null")
            moved = moved.select(*KEY, F.coalesce("came", F.lit(False)).alias("came"))
            old = self.filters
        filters = old.groupBy("shard").cogroup(moved.withColumn("shard", new.shard()).groupBy("shard")).applyInPandas(refilled, FILTERS)
        return replace(new, filters=written(filters, "filters"))

    def shard(self) -> Column:
        return F.pmod(F.col("hi"), F.lit(self.shards).cast("long"))

    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("docs") >= self.least_docs)

    def dropped(self, keys: DataFrame) -> DataFrame:
        """Of ``keys_of`` documents those whose lines go: repeated keys of which another document has the larger id."""
        keys = keys.select("doc_id", "version", *KEY, self.shard().alias("shard"))
        many = keys.groupBy("shard").count().where(F.col("count") > CHUNK)
        many = cut_lineage(many.select("shard", F.ceil(F.col("count") / CHUNK).alias("chunks")))  # shards that many ask for
        chunks = F.coalesce("chunks", F.lit(1).cast("long"))
        keys = keys.join(many, "shard", "left").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "version", "lo"), chunks)).drop("chunks")
        held = F.flatten(F.collect_list(F.array("hi", "lo", "top"))).alias("held")
        exact = self.repeated().withColumn("shard", self.shard()).groupBy("shard").agg(held)
        shards = self.filters.join(exact, "shard").join(many, "shard", "left")
        shards = shards.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).drop("chunks")
        own = ["shard", "chunk"]
        return keys.groupBy(*own).cogroup(shards.groupBy(*own)).applyInPandas(looked_up, "doc_id long, version long, hi long, lo long")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: DataFrame | None = None) -> DataFrame:
        """(id, text, n_lines, n_dropped): every document without the lines that another one keeps.

        A null text is an empty one, and an empty one has one empty line. Rows of a null id take no part: no count, all
        lines kept. Repeated rows and rows of one id are one document to the counts and come back once each. An empty
        table gives an empty result.
        """
        keys = keys_of(docs, id_col, text_col, self.least_chars) if keys is None else keys
        gone = self.dropped(keys).groupBy("doc_id", "version").agg(F.flatten(F.collect_list(F.array(*KEY))).alias("gone"))
        gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version"), "gone")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), version(F.col(text_col)), F.coalesce(text_col, F.lit("")).alias("text"))
        rows = rows.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
        least = self.least_chars

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, gone in zip(b["text"], b["gone"]):
                    lines = text.split("\n")
                    n_lines.append(len(lines))
                    if gone is not None:
                        raw = np.asarray(gone, dtype="<i8").tobytes()
                        out = {raw[i : i + 16] for i in range(0, len(raw), 16)}
                        lines = [line for line, key in zip(lines, line_keys(text, least)) if key not in out]
                        text = "\n".join(lines)
                    n_dropped.append(n_lines[-1] - len(lines))
                    texts.append(text)
                yield pd.DataFrame({"id": b["id"], "text": texts, "n_lines": n_lines, "n_dropped": n_dropped})

        rows = rows.select(F.col("id").cast("string").alias("id"), "text", "gone")  # pandas has no null integers
        rows = rows.mapInPandas(run, "id string, text string, n_lines long, n_dropped long")
        return rows.withColumn("id", F.col("id").cast("long"))


def refilled(old: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
    """The filter of a shard after keys came and went."""
    own = Cuckoo(old["cells"].iloc[0], old["stash"].iloc[0]) if len(old) else Cuckoo()
    came = moved["came"].to_numpy(dtype=bool)
    lo = moved["lo"].to_numpy(dtype=np.int64)
    own.delete(lo[~came])
    own.insert(lo[came])
    shard = (old if len(old) else moved)["shard"].iloc[0]
    return pd.DataFrame({"shard": [shard], "cells": [own.cells.tobytes()], "stash": [own.stash]})


def looked_up(keys: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """The keys that pass the filter, are in the exact table and belong to another document."""
    names = ["doc_id", "version", *KEY]
    if not len(keys) or not len(shard):
        return keys[names].iloc[:0]
    keys = keys[Cuckoo(shard["cells"].iloc[0], shard["stash"].iloc[0]).contains(keys["lo"].to_numpy(dtype=np.int64))]
    held = np.asarray(shard["held"].iloc[0], dtype=np.int64).reshape(-1, 3).tolist()
    top = {(hi, lo): doc for hi, lo, doc in held}
    gone = [top.get((hi, lo), doc) != doc for hi, lo, doc in zip(keys["hi"], keys["lo"], keys["doc_id"])]
    return keys.loc[np.array(gone, dtype=bool), names]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, text, n_lines, n_dropped) of all documents against an index of their own; see ``LineIndex.dedup``."""
    keys = cut_lineage(keys_of(docs, id_col, text_col, least_chars))
    index = LineIndex.empty(docs.sparkSession, least_docs, least_chars).changed(keys)
    return index.dedup(docs, id_col, text_col, keys)
