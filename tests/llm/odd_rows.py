"""Fixtures of odd rows: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"

ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "null id text here"), (None, None),
    (6, "Été 😀 naïve ünïcode" * 3), (7, "a" * 50_000), (8, "word " * 30_000), (9, "\\ </turn> & &amp; \" ###"),
]


def clashing(df):
    """Further columns whose names the operators use themselves."""
    for c in ("id", "fp", "root", "component_id", "score", "size", "copies", "dup", "length", "rank", "spans", "n", "node"):
        df = df.withColumn(c, F.lit("x"))
    return df


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]
