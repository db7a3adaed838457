"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is expected as often as the source's target over its size. The whole part
of that number is taken for certain. The fractions are rounded against each other: two documents pass
words from one to the other, in a random direction, until one of them is wholly in or out, so the words
taken from a source stay the same while every document keeps its expectation. Blocks of a few dozen
documents are folded first, each leaving one open document; these are folded again, in a reduction tree
whose height grows with the logarithm of the largest source. The random numbers are hashes of ids and
a seed: reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import WORD, cut_lineage, numbered

BLOCK = 64  # documents folded together
WEIGHTS = (5.0, 2.0, 1.0)


def with_row_numbers(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """``docs`` with a number of its own for every row of one id."""
    return numbered(docs, id_col, name, F.col(source_col), F.xxhash64(text_col))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, src, source_size, n, target) from (source, source_size, n): one row per source.

    Sources are ranked by code point, null last; the weights repeat along that order. The targets
    share ``share`` of all sizes by weight, none above ``most`` times its source's size. Handing an
    excess on by weight until none is left ends at min(cap, level * weight), where the level is the
    largest of (total - caps before) / (weights not before) along the sources by cap over weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = sizes.withColumn("src", F.row_number().over(order))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("w", F.element_at(listed, (F.col("src") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    cap_before, w_before = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "w"))
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (total - cap_before) / (F.sum("w").over(whole) - w_before)
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return ranked.select("source", "src", "source_size", "n", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(float(2**53))


def settled(item: Column, bit: int) -> Column:
    return item.withField("copies", item["base"] + F.lit(bit).cast("long"))


def fold(items: Column, item_type: str, seed: int) -> Column:
    """Struct (done, open): all items but one rounded, their words passed on to the open one."""

    def step(state: Column, x: Column) -> Column:
        c = state["open"]
        up_c, down_c = c["size"] * (F.lit(1.0) - c["p"]), c["size"] * c["p"]
        up_x, down_x = x["size"] * (F.lit(1.0) - x["p"]), x["size"] * x["p"]
        to_c, to_x = F.least(up_c, down_x), F.least(up_x, down_c)
        drawn = uniform(F.lit(seed), c["id"], c["dup"], x["id"], x["dup"])
        raise_c = drawn * (to_c + to_x) < to_x

        def leaves(done: Column, left: Column, words: Column) -> Column:
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left["p"] + words / left["size"]))
            return F.struct(F.concat(state["done"], F.array(done)).alias("done"), left.withField("p", p).alias("open"))

        return (
            F.when(c.isNull(), F.struct(state["done"].alias("done"), x.alias("open")))
            .when(raise_c & (up_c <= down_x), leaves(settled(c, 1), x, -up_c))
            .when(raise_c, leaves(settled(x, 0), c, down_x))
            .when(up_x <= down_c, leaves(settled(x, 1), c, -up_x))
            .otherwise(leaves(settled(c, 0), x, down_c))
        )

    start = F.expr(f"struct(cast(array() as array<{item_type}>) as done, cast(null as {item_type}) as open)")
    return F.aggregate(items, start, step)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """(id, dup, size, source_size, target, copies) for every row; ``dup`` numbers the rows of one id.

    Words taken from a source differ from its target by less than one document. A row is taken at
    most ceil(``most``) times. Null texts have size 0 and a null source is a source; sources without
    words have target 0 and are not taken. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("text"),
    )
    rows = cut_lineage(with_row_numbers(rows, "dup", "id", "text", "source").drop("text"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most)
    targets = cut_lineage(targets)
    own = targets.withColumnRenamed("source", "s")
    rows = rows.join(own, rows["source"].eqNullSafe(own["s"])).drop("s", "source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("e", F.least(expected, F.lit(float(most))))
    rows = rows.withColumn("base", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.floor("e"))
    fields = {"id": "long", "dup": "int", "size": "long", "source_size": "long", "target": "double", "base": "long", "p": "double", "copies": "long"}
    item_type = "struct<" + ",".join(f"{k}:{v}" for k, v in fields.items()) + ">"
    rows = rows.withColumn("copies", F.lit(None).cast("long"))
    item = F.struct(*[F.col(k).cast(v).alias(k) for k, v in fields.items()])
    rows = rows.select("src", "n", item.alias("item"))
    is_open = (F.col("item.size") > 0) & (F.col("item.p") > 0)
    rounded = F.col("item.base") + (uniform(F.lit(seed), F.col("item.id"), F.col("item.dup")) < F.col("item.p")).cast("long")
    finished = [rows.where(~is_open).select(F.col("item").withField("copies", rounded).alias("item"))]
    pending = rows.where(is_open)
    largest = targets.agg(F.max("n")).first()[0] or 0
    reach = BLOCK
    while True:
        bucket = F.pmod(F.xxhash64(F.lit(seed + reach), "item.id", "item.dup"), F.ceil(F.col("n") / F.lit(float(reach))))
        ranked = F.struct((-F.col("item.size")).alias("large"), F.xxhash64("item.id", "item.dup").alias("h"), F.col("item"))
        groups = pending.groupBy("src", "n", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(ranked)).alias("ranked"))
        items = F.transform("ranked", lambda r: r["item"])
        groups = cut_lineage(groups.select("src", "n", fold(items, item_type, seed).alias("state")))
        finished.append(groups.select(F.explode("state.done").alias("item")))
        pending = groups.select("src", "n", F.col("state.open").alias("item"))
        if reach >= largest:
            break
        reach *= BLOCK
    finished.append(pending.select(F.col("item").withField("copies", rounded).alias("item")))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(f"item.{c}").alias(c) for c in ("id", "dup", "size", "source_size", "target", "copies")])
