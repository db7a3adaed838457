"""Pipeline stages: each applies one operator to all documents it is given and lets its decisions take effect.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Helper columns
get names that ``docs`` does not have, so further columns of any name pass through unharmed. Null texts, empty texts,
repeated rows and empty tables are handled as the operators' docstrings say.

An operator's decisions are rows of ids. Texts are shuffled once, to meet them; only rows whose id repeats are
numbered besides, and these are found on the ids alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage, numbered, table
from panelcast.session import written_table


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns: these, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    return [next(own for own in (name + "_" * n for n in range(len(taken) + 1)) if own not in taken) for name in names]


def own_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labelled training rows, calls toxic."""
    from panelcast.llm.toxicity import THRESHOLD, fit, score

    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(model, F.col("text")) < THRESHOLD)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of every group of near copies (of equal ids, one text)."""
    from panelcast.llm.simhash import simhash_dedup

    found = cut_lineage(simhash_dedup(docs, shingle=4, radius=4).select("id", "text_hash", "root"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("best")
    key, text, kept_id, kept_text, row = unused(docs, "__key", "__text", "__id", "__hash", "__row")
    kept = found.groupBy("root").agg(best).select(F.col("best.id").alias(kept_id), F.col("best.text_hash").alias(kept_text))
    many = found.groupBy("id", "text_hash").count().where("count > 1").select(F.col("id").alias("i"), F.col("text_hash").alias("t"))
    many = kept.join(many, kept[kept_id].eqNullSafe(F.col("i")) & (kept[kept_text] == F.col("t")), "left_semi")
    many = written_table(many, "repeated")
    rows = docs.withColumns({key: F.col("doc_id").cast("long"), text: F.xxhash64("text")})

    def matching(own: DataFrame) -> DataFrame:
        return rows.join(own, rows[key].eqNullSafe(own[kept_id]) & (rows[text] == own[kept_text]), "left_semi")

    if many.isEmpty():
        return own_columns(matching(kept), docs)
    once = kept.join(many, kept[kept_id].eqNullSafe(many[kept_id]) & (kept[kept_text] == many[kept_text]), "left_anti")
    first = numbered(matching(many), [key, text], row, F.lit(0)).where(F.col(row) == 1)
    return own_columns(matching(once), docs).unionByName(own_columns(first, docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a placeholder; no document is dropped."""
    from panelcast.llm.secrets import fit, redact

    model = fit(docs)
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), redact(model, F.col("text"))))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mix takes it (not at all, once or twice)."""
    from panelcast.llm.mixing import mix, with_row_numbers

    key, dup, taken_id, n, copies, copy = unused(docs, "__key", "__dup", "__id", "__n", "__copies", "__copy")
    taken = mix(docs).select(F.col("id").alias(taken_id), F.col("dup").alias(n), F.col("copies").alias(copies))
    taken = cut_lineage(taken)
    many = taken.groupBy(taken_id).count().where("count > 1").select(F.col(taken_id).alias("i"))
    many = written_table(many, "repeated")
    wanted = taken.where(F.col(copies) > 0)
    rows = docs.withColumn(key, F.col("doc_id").cast("long"))

    def repeated(joined: DataFrame) -> DataFrame:
        return own_columns(joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))), docs)

    if many.isEmpty():
        return repeated(rows.join(wanted, F.col(key).eqNullSafe(F.col(taken_id))))
    once = wanted.join(many, wanted[taken_id].eqNullSafe(many["i"]), "left_anti")
    several = with_row_numbers(own_columns(rows.join(many, rows[key].eqNullSafe(many["i"]), "left_semi"), docs), dup)
    several = several.withColumn(key, F.col("doc_id").cast("long"))
    several = several.join(wanted, F.col(key).eqNullSafe(F.col(taken_id)) & (F.col(dup) == F.col(n)))
    return repeated(rows.join(once, F.col(key).eqNullSafe(F.col(taken_id)))).unionByName(repeated(several))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents; one row per piece."""
    from panelcast.llm.packing import pack

    return pack(docs)
