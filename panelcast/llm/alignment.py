"""Alignment of two tokenizers' tokens over their bytes, with corpus-wide counts of linked id pairs.

Tokens of A and B are linked where their byte ranges overlap. Counting is external: while a task reads documents, the
(pair, document) records of a bounded number of documents, a *flush*, are sorted and dealt by the B id to ``RADIX`` runs, each kept as
zstd frames. The runs of a radix are merged with a heap over their frames, in rounds of at most ``FAN`` runs
to a task, and every pair is counted; in that order all pairs of a B id follow each other, so its highest count is known as soon as
its last pair has passed. The counts then meet the runs again, and what every document gains from its pairs
goes back to the flush that holds it. A pair or a B id that fills a third of the corpus is a record of every flush, never a group of
its own, and a task merges about FAN runs.

Both vocabularies leave off at a space that follows a word, so a text is cut there and equal stretches are tokenised once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import fresh_folder
from panelcast.llm.packing import encoder, vocabulary

RADIX = 64  # runs of a flush
CHARS, DOCS = 4_000_000, 20_000  # of a flush, unless one document has more
FAN = 16  # runs merged by a task, on average
FRAME = 65_536  # records of a zstd frame
HELD = 5_000_000  # characters of stretches that a task remembers beyond a flush
BATCH = 20_000  # stretches tokenised together
WORDS = re.compile(r"(?<=\S)(?= )")


class Aligner:
    """Tokenises stretches with both vocabularies; what a stretch adds to its document is held under a number."""

    def __init__(self, ranks: dict[bytes, int], path_b: str):
        import sentencepiece

        self.encode_a = encoder(ranks)
        self.size_a = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size_a[[*ranks.values()]] = [*map(len, ranks)]
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = self.model.is_byte
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([*map(len, self.bytes_b)], dtype=np.int64)
        self.space = self.model.piece_to_id("▁")
        #: No piece goes on with a space behind something else, so no merge reaches over a cut.
        self.cuts = not any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not byte(i) and not self.model.is_control(i))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.sizes = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links
        self.links = np.zeros(0, dtype=np.uint64)

    def learn(self, fresh: list[str]) -> None:
        """Numbers new stretches; -1 where the joined bytes of either side are not those of the text."""
        joint = [s for s in fresh if not s[-1].isspace()]  # one text, as these are cut where A cuts them
        apart = [s for s in fresh if s[-1].isspace()]
        a = [self.encode_a("".join(joint)), *map(self.encode_a, apart)]
        fresh, a = joint + apart, np.array([i for own in a for i in own], dtype=np.int64)
        b = [[self.space] if s == " " else own for s, own in zip(fresh, self.model.encode([s[1:] for s in fresh], num_threads=1))]  # B sets the space itself
        whole = [s.encode() for s in fresh]
        right = np.array([b"".join([self.bytes_b[i] for i in own]) == s for s, own in zip(whole, b)])
        end = np.cumsum([len(s) for s in whole])
        size_a = self.size_a[a]
        of_a = np.searchsorted(end, np.cumsum(size_a) - size_a, side="right")
        self.known.update((s, -1) for s, good in zip(fresh, right) if not good)
        fresh, a = [s for s, good in zip(fresh, right) if good], a[right[of_a]]
        if fresh:
            b = np.array([i for own, good in zip(b, right) if good for i in own], dtype=np.int64)
            self.add(fresh, a, b, np.cumsum(np.diff(end, prepend=0)[right]))

    def add(self, fresh: list[str], a: np.ndarray, b: np.ndarray, last: np.ndarray) -> None:
        """Tokens overlap once for every byte at which either side has an end."""
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b)
        links = b[np.searchsorted(end_b, ends)] << 32 | a[np.searchsorted(end_a, ends)]
        to_a, to_b = np.searchsorted(end_a, common, "right").tolist(), np.searchsorted(end_b, common, "right").tolist()
        names_a, names_b = [*map(str, a.tolist())], [*map(str, b.tolist())]
        groups = [",".join(names_a[i:x]) + "|" + ",".join(names_b[j:y]) for i, x, j, y in zip([0, *to_a], to_a, [0, *to_b], to_b)]
        cuts = [np.searchsorted(e, last, side="right") for e in (end_a, end_b, common, ends)]
        first = len(self.texts)
        self.texts += [";".join(groups[x:y]).encode() for x, y in zip([0, *cuts[2].tolist()], cuts[2].tolist())]
        self.known.update(zip(fresh, range(first, first + len(fresh))))
        self.sizes = np.concatenate([self.sizes, np.stack([np.diff(c, prepend=0) for c in cuts], axis=1)])
        self.links = np.concatenate([self.links, links.astype(np.uint64)])

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Sizes and digest of every document, and the links of all with the place of theirs."""
        parts = [(WORDS.split(" " + t) if self.cuts else [" " + t]) if t else [] for t in texts]
        known = self.known
        fresh = [s for s in dict.fromkeys(chain.from_iterable(parts)) if s not in known]
        for at in range(0, len(fresh), BATCH):
            self.learn(fresh[at : at + BATCH])
        own = [[known[s] for s in p] for p in parts]
        own = [[] if -1 in o else o for o in own]
        digests = [hashlib.sha256(b";".join([self.texts[i] for i in o])).hexdigest() if o else "" for o in own]
        n = np.array([len(o) for o in own])
        which = np.fromiter(chain.from_iterable(own), dtype=np.int64, count=n.sum())
        size = self.sizes[which]
        each = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(size, axis=0)])[np.append(0, np.cumsum(n))], axis=0)
        start, size = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3], size[:, 3]
        at = np.repeat(start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return each, digests, self.links[at], np.repeat(np.arange(len(own)), each[:, 3])


def frames(*columns: np.ndarray) -> list[bytes]:
    """zstd frames of FRAME records each, column after column."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(b"".join(c[at : at + FRAME].tobytes() for c in columns)) for at in range(0, len(columns[0]), FRAME)]


def thawed(held: Iterable[bytes], *types: str) -> Iterator[tuple[np.ndarray, ...]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for frame in held:
        raw = unpack.decompress(frame)
        n, at = len(raw) // sum(np.dtype(t).itemsize for t in types), 0
        out = []
        for t in types:
            out.append(np.frombuffer(raw, t, n, at))
            at += out[-1].nbytes
        yield tuple(out)


PAIRS, SHARES, COUNTS, GAINS = ("<u8", "<i8", "<i8"), ("<u4", "<u4"), ("<u8", "<i8", "?"), ("<u4", "<i8", "<i8")


def runs(links: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(radix, pairs, shares): the sorted records of a flush, dealt by B id. A pair has its links and its number of
    records; the records themselves, (document, links), follow in the order of the pairs."""
    order = np.argsort(links, kind="stable")
    links, docs = links[order], docs[order]
    new = np.flatnonzero((np.diff(links, prepend=~links[:1]) != 0) | (np.diff(docs, prepend=-1) != 0))
    n = np.diff(np.append(new, len(links)))
    links, docs = links[new], docs[new]
    radix = ((links >> np.uint64(32)) % np.uint64(RADIX)).astype(np.uint8)
    order = np.argsort(radix, kind="stable")
    links, docs, n = links[order], docs[order], n[order]
    edges = np.append(0, np.cumsum(np.bincount(radix, minlength=RADIX)))
    for r, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if lo < hi:
            own = links[lo:hi]
            first = np.flatnonzero(np.diff(own, prepend=~own[:1]) != 0)
            total = np.add.reduceat(n[lo:hi], first).astype(np.int64)
            records = np.diff(np.append(first, len(own))).astype(np.int64)
            yield r, frames(own[first], total, records), frames(docs[lo:hi].astype("<u4"), n[lo:hi].astype("<u4"))


def merged(sources: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted, summed (pair, count) blocks of sorted runs: a heap holds the runs by the last pair of their current
    frame; nothing below the smallest of these pairs can come any more."""
    heap, heads = [], {}

    def pull(i: int) -> None:
        block = next(sources[i], None)
        heads.pop(i, None)
        if block is not None:
            heads[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(sources)):
        pull(i)
    while heap:
        last = heap[0][0]
        pairs, counts = [], []
        for i, (p, c) in heads.items():
            cut = int(np.searchsorted(p, np.uint64(last), side="right"))
            pairs.append(p[:cut])
            counts.append(c[:cut])
            heads[i] = (p[cut:], c[cut:])
        while heap and heap[0][0] == last:
            pull(heapq.heappop(heap)[1])
        pair, where = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(pair), dtype=np.int64)
        np.add.at(total, where, np.concatenate(counts))
        yield pair, total


def highest(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a pair has the highest count of its B id; only the pairs of one B id are held back."""
    held_p, held_c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def marked(p, c):
        first = np.flatnonzero(np.diff(p >> np.uint64(32), prepend=~(p[:1] >> np.uint64(32))) != 0)
        most = np.repeat(np.maximum.reduceat(c, first), np.diff(np.append(first, len(p))))
        return p, c, c == most

    for p, c in blocks:
        p, c = np.concatenate([held_p, p]), np.concatenate([held_c, c])
        cut = int(np.searchsorted(p, (p[-1] >> np.uint64(32)) << np.uint64(32)))
        if cut:
            yield marked(p[:cut], c[:cut])
        held_p, held_c = p[cut:], c[cut:]
    if len(held_p):
        yield marked(held_p, held_c)


def written(blocks: Iterator[tuple[np.ndarray, ...]]) -> list[bytes]:
    return [f for block in blocks for f in frames(*block)]


def gains(shares: pd.DataFrame, counts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(flush, frames of (document, links of a highest count, sum of counts)) of every run of a radix."""
    known = [*thawed(counts, *COUNTS)]
    pair, count, best = (np.concatenate(x) for x in zip(*known))
    for flush, own, records in zip(shares["flush"], shares["pairs"], shares["shares"]):
        own = [*thawed(own, *PAIRS)]
        at = np.searchsorted(pair, np.concatenate([p for p, _, _ in own]))
        at = np.repeat(at, np.concatenate([r for _, _, r in own]))
        docs, n = (np.concatenate(x) for x in zip(*thawed(records, *SHARES)))
        size = int(docs.max()) + 1
        n, sums, tops = n.astype(np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        np.add.at(sums, docs, n * count[at])
        np.add.at(tops, docs, n * best[at])
        docs = np.flatnonzero(sums)
        yield flush, frames(docs.astype("<u4"), tops[docs], sums[docs])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document.

    A reads a space and the text (``path_a``: its ranks), B the text (``path_b``), before which it sets a
    space itself; strings of special tokens are plain text. A text that is null or empty, or that either side does not give back
    byte by byte, has zeros and an empty ``groups_sha256``. Texts are read whole, runs of any length too. Repeated rows count
    and come back once each, null ids stay null; an empty table gives an empty result.
    """
    import public_tokenizers

    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    ranks, spark = vocabulary(path_a), docs.sparkSession

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, flush = Aligner(ranks, path_b), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flushed() -> Iterator[pd.DataFrame]:
            each, digests, links, place = aligner.documents(texts)
            out = pd.DataFrame(each, columns=["n_a", "n_b", "n_groups", "n_links"])
            yield out.assign(flush=flush, place=range(len(ids)), doc_id=ids, groups_sha256=digests, radix=None, pairs=None, shares=None)[columns]
            if len(links):
                dealt = pd.DataFrame([*runs(links, place)], columns=["radix", "pairs", "shares"])
                yield dealt.assign(flush=flush, **dict.fromkeys(names))[columns]

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size >= CHARS or len(ids) >= DOCS:
                    yield from flushed()
                    flush, ids, texts, size = flush + 1, [], [], 0
                    if sum(map(len, aligner.known)) >= HELD:
                        aligner.clear()
        if ids:
            yield from flushed()

    names = ["place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]  # an id is text on its way: pandas has no null integers
    columns = ["flush", *names, "radix", "pairs", "shares"]
    schema = "flush long, place long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, pairs array<binary>, shares array<binary>"
    folder = fresh_folder(spark, "alignment")
    given = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    given.mapInPandas(read, schema).write.parquet(folder)
    held = spark.read.schema(schema).parquet(folder)
    rows, dealt = held.where("radix is null").select("flush", *names), held.where("radix is not null")

    def count(last: bool, types: tuple):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            blocks = merged([((t[0], t[1]) for t in thawed(f, *types)) for f in group["pairs"]])
            out = highest(blocks) if last else blocks
            return pd.DataFrame([(int(group["radix"].iloc[0]), int(group["chunk"].iloc[0]), written(out))], columns=["radix", "chunk", "pairs"])

        return run

    flushes = rows.select("flush").distinct().count()
    chunks = max(1, -(-flushes // FAN))
    chunk = F.pmod(F.xxhash64("flush"), F.lit(chunks)).alias("chunk")
    counts, parts, types = dealt.select("radix", chunk, "pairs"), chunks, PAIRS
    while True:
        counts = counts.groupBy("radix", "chunk").applyInPandas(count(parts == 1, types), "radix int, chunk long, pairs array<binary>")
        if parts == 1:
            break
        parts, types = -(-parts // FAN), PAIRS[:2]
        counts = counts.withColumn("chunk", F.pmod("chunk", F.lit(parts)))
    counts = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.col("pairs").alias("counts"))

    def give(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([*gains(own, known["counts"].iloc[0])] if len(own) else [], columns=["flush", "gains"])

    given_back = dealt.select("flush", "radix", chunk, "pairs", "shares").groupBy("radix", "chunk").cogroup(counts.groupBy("radix", "chunk"))
    given_back = given_back.applyInPandas(give, "flush long, gains array<binary>")

    def close(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        tops, sums = np.zeros((2, len(own)), dtype=np.int64)
        for held in found["gains"]:
            for docs, top, total in thawed(held, *GAINS):
                tops[docs] += top
                sums[docs] += total
        return own.drop(columns=["flush", "place"]).assign(n_best=tops, count_sum=sums)

    kept = names[1:]
    out = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    closed = rows.select("flush", "place", *kept).groupBy("flush").cogroup(given_back.groupBy("flush")).applyInPandas(close, out)
    return closed.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
