"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled text, in which a known
share (the class prior) is toxic too. Numpy classifiers minimise the prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the bracket turns negative, the step is
reversed, so the classifier cannot explain the unlabelled text away. Features are the presence of
words and of five-letter word beginnings, hashed; those that differ most between the two samples
are kept and weighted by the log ratio of their prior-corrected frequencies.

The fit reads all training rows: features are counted over all of them, and rows of equal features, which are one
pattern with a count, are dealt to shards of about UNLABELLED rows and POSITIVES toxic ones. A task trains a shard's
classifiers, which are averaged over the shards.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage, held_out

POSITIVES, UNLABELLED = 4000, 12000  # rows of a shard, about
TOGETHER = 4096  # rows counted together
BROADCAST_IDS = 1 << 20  # toxic ids that are sent to all executors, at most; more are joined by a shuffle
BUCKETS, FEATURES = 1 << 20, 128  # hash range; features kept
LEAST_ROWS, LEAST_Z = 3, 6.0  # rows with a feature, and its z score, to be kept
CLASSIFIERS, STEPS, RATE, DECAY = 3, 900, 0.02, 1e-4
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W_]+")


def buckets_of(word: str) -> tuple[int, ...]:
    """Hashed features of one word: itself, and its first five letters if it is longer."""
    whole = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    return (whole,) if len(word) <= 5 else (whole, zlib.crc32(b"^" + word[:5].encode("utf-8", "replace")) % BUCKETS)


class Buckets(dict):
    """Buckets of the words met lately; of ``kept`` ones only, if given."""

    def __init__(self, kept: dict[int, object] | None = None):
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        own = self[word] = tuple(b for b in buckets_of(word) if self.kept is None or b in self.kept)
        return own

    def features(self, text: str | None) -> set[int]:
        return set().union(*[self[w] for w in set(WORDS.findall((text or "").lower()))])


@dataclass
class Model:
    """Kept buckets with one weight per classifier, and the classifiers' offsets."""

    weights: dict[int, np.ndarray]
    offset: np.ndarray

    def score_texts(self, texts, known: Buckets) -> list[float]:
        out = []
        for text in texts:
            margin = self.offset + sum((self.weights[b] for b in sorted(known.features(text))), np.zeros_like(self.offset))
            out.append(float(np.mean(1 / (1 + np.exp(-np.clip(margin, -30, 30))))))
        return out


def train(p: np.ndarray, u: np.ndarray, prior: float, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weights and offset of one classifier; rows of ``p`` and ``u`` are 0/1 features."""
    rng = np.random.default_rng(seed)
    x_p, x_u = p * ratio, u * ratio
    w = np.concatenate([np.ones(p.shape[1]), [np.log(prior / (1 - prior))]])
    first, second, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, len(u) // 400)
    while t < STEPS:
        parts_p = np.array_split(rng.permutation(max(len(p), batches)) % len(p), batches)
        parts_u = np.array_split(rng.permutation(len(u)), batches)
        for own_p, own_u in zip(parts_p, parts_u):
            a, b = x_p[own_p], x_u[own_u]
            s_p = 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30)))
            s_u = 1 / (1 + np.exp(-np.clip(b @ w[:-1] + w[-1], -30, 30)))
            # sigmoid loss: 1 - s for a positive, s for a negative
            d_p, d_u = s_p * (1 - s_p) / len(s_p), s_u * (1 - s_u) / len(s_u)
            as_negative = np.concatenate([d_u @ b - prior * (d_p @ a), [d_u.sum() - prior * d_p.sum()]])
            as_positive = -prior * np.concatenate([d_p @ a, [d_p.sum()]])
            step = as_positive + as_negative if s_u.mean() >= prior * s_p.mean() else -as_negative
            step[:-1] += DECAY * (w[:-1] - 1)
            t += 1
            first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
            w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1] * ratio, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learnt from the training rows (held_out() is false) alone.

    A document with several labels counts as toxic if one says so; null labels say nothing. Without
    a toxic training row, or without other rows, every score is 0.
    """
    known = labels.where(~held_out(F.col(id_col)) & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    share = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    toxic = cut_lineage(known.where("toxic = 1").select("id", F.lit(1).alias("positive")))
    toxic = F.broadcast(toxic) if toxic.count() <= BROADCAST_IDS else toxic
    rows = texts.where("id is not null").join(toxic, "id", "left").select(F.coalesce("positive", F.lit(0)).alias("positive"), "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = Buckets(), np.zeros((2, BUCKETS + 1), np.int64)  # the last place counts the rows
        for b in batches:
            for start in range(0, len(b), TOGETHER):
                part = b.iloc[start : start + TOGETHER]
                found = [np.fromiter(known.features(t), np.int64) for t in part["text"]]
                toxic = [x for x, positive in zip(found, part["positive"]) if positive]
                for at, own in enumerate((toxic, found)):
                    held[at, :BUCKETS] += np.bincount(np.concatenate([*own, np.zeros(0, np.int64)]), minlength=BUCKETS)
                    held[at, BUCKETS] += len(own)
        at = held[1].nonzero()[0]
        yield pd.DataFrame({"bucket": at, "k_p": held[0, at], "k_u": held[1, at]})

    held = rows.mapInPandas(count, "bucket long, k_p long, k_u long").groupBy("bucket").agg(F.sum("k_p").alias("k_p"), F.sum("k_u").alias("k_u"))
    held = cut_lineage(held)
    n_p, n_u = next(((r["k_p"], r["k_u"]) for r in held.where(F.col("bucket") == BUCKETS).collect()), (0, 0))
    if not n_p or not n_u or not 0 < share < 1:
        return Model({}, np.full(1, -np.inf))
    f_p, f_u = F.col("k_p") / n_p, F.col("k_u") / n_u
    pooled = (F.col("k_p") + F.col("k_u") + 1) / F.lit(float(n_p + n_u + 2))
    z = F.abs(f_p - f_u) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / n_p + 1 / n_u))
    kept = held.where(F.col("bucket") < BUCKETS).withColumn("z", z).where((F.col("k_p") + F.col("k_u") >= LEAST_ROWS) & (F.col("z") >= LEAST_Z))
    kept = kept.orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()
    place = {r["bucket"]: i for i, r in enumerate(kept)}
    k_p, k_u = (np.array([r[c] for r in kept], dtype=float) for c in ("k_p", "k_u"))
    clean = np.maximum(0, k_u / n_u - share * k_p / n_p) / (1 - share)
    ratio = np.log((k_p + 0.5) / (n_p + 1)) - np.log((clean * n_u + 0.5) / (n_u + 1))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets(place)
        for b in batches:
            at = [sorted(place[x] for x in known.features(t)) for t in b["text"]]
            yield pd.DataFrame({"positive": b["positive"], "at": at})

    patterns = rows.mapInPandas(locate, "positive int, at array<int>").groupBy("at").agg(F.sum("positive").alias("1"), F.count("*").alias("0"))
    weights, offset = train_shards(cut_lineage(patterns), n_p, n_u, share, ratio.astype(np.float32))
    return Model({b: weights[i] for b, i in place.items()}, offset)


def train_shards(patterns: DataFrame, n_p: int, n_u: int, prior: float, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of all classifiers, averaged over shards, from rows (at, 1, 0): the features of a pattern, and
    how many toxic and how many unlabelled rows have it. A pattern's unlabelled rows are spread evenly over all shards.
    Its toxic rows are spread over groups of about POSITIVES; a shard takes a whole group, as do others where groups are fewer."""
    groups = -(-n_p // POSITIVES)
    shards = max(groups, -(-n_u // UNLABELLED))
    first = F.xxhash64("at", F.lit(19))

    def spread(positive: int, parts: int) -> DataFrame:
        n = F.col(str(positive))
        own = patterns.where(n > 0).select("at", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(parts)) - 1)).alias("k"))
        copies = F.floor(F.col("n") / parts) + (F.col("k") < F.col("n") % parts).cast("long")
        return own.select("at", F.lit(positive).alias("positive"), copies.alias("copies"), F.pmod(first + F.col("k"), F.lit(parts)).alias("part"))

    toxic = spread(1, groups)
    toxic = toxic.withColumn("part", F.explode(F.sequence(F.col("part"), F.lit(shards - 1).cast("long"), F.lit(groups).cast("long"))))

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        matrix = []
        for positive in (1, 0):
            of = sorted((list(at), n) for at, n in zip(*own.loc[own["positive"] == positive, ["at", "copies"]].T.to_numpy()))
            x = np.zeros((len(of), len(ratio)), np.float32)
            for row, (at, _) in zip(x, of):
                row[at] = 1
            matrix.append(np.repeat(x, [n for _, n in of], axis=0))
        found = [train(*matrix, prior, ratio, seed) for seed in range(CLASSIFIERS)]
        part = int(own["part"].iloc[0])
        return pd.DataFrame({"seed": range(CLASSIFIERS), "part": part, "values": [np.append(w.astype(float), o) for w, o in found]})

    def mean(own: pd.DataFrame) -> pd.DataFrame:
        values = np.mean(np.stack(list(own.sort_values("part")["values"])), axis=0)
        return pd.DataFrame({"seed": own["seed"].iloc[:1], "values": [values]})

    dealt = toxic.unionByName(spread(0, shards)).repartition(shards, "part")
    learnt = dealt.groupBy("part").applyInPandas(learn, "seed int, part long, values array<double>")
    learnt = learnt.groupBy("seed").applyInPandas(mean, "seed int, values array<double>").collect()
    values = np.array([r["values"] for r in sorted(learnt)]).T
    return values[:-1], values[-1]


def score(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of a whole text; null and empty texts score as texts without words."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Buckets(model.weights)
        for texts in batches:
            yield pd.Series(model.score_texts(texts, known), dtype=float)

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; repeated rows each keep a row, a null id is held out."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), score(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
