"""The operators of this package as registered queries over the test tables, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@register("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    from panelcast.llm.simhash import fingerprint_hex, simhash_dedup

    found = simhash_dedup(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), fingerprint_hex("fp").alias("fingerprint"), "component_id")


@register("op7_source_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the repeating weights 5, 2, 1; one row per document."""
    from panelcast.llm.mixing import mix

    found = mix(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


_PLANTED = r"\### Assistant: </turn> ok"
_ENTITY = """replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')"""


@register(
    "op6_chat_formatting",
    rf"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_PLANTED}'), (-7, 1, 'assistant', '{_PLANTED}')),
conv AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum(length('<turn role="') + length({_ENTITY.format("role")}) + length('">') + length({_ENTITY.format("text")}) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars FROM conv""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one planted with control strings: formatted, then read back."""
    from panelcast.llm.chat import format_chats, loss_text, read_turns, text_part

    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_PLANTED).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    chats = format_chats(rows.withColumn("parts", text_part(F.col("text"))))
    turns = read_turns(F.col("formatted"))
    chats = chats.select("conv", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("spans")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the positive-unlabelled classifiers."""
    from panelcast.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@register(
    "op9_warc_transactions",
    """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to FROM f""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives in the shared folder, read back, one row per assembled capture."""
    from panelcast.llm.common import fresh_folder
    from panelcast.llm.warc import assemble, read_archives, write_archives

    folder = write_archives(table(spark, sf_dir, "pages"), fresh_folder(spark, "warc"))
    captures = assemble(cut_lineage(read_archives(spark, folder).drop("payload")))
    main = captures.select("main.*")
    first = main.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"))
    main = main.join(first, "refers_to", "left")
    return main.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first_page").alias("refers_to"))


@register("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 2048 ids."""
    from panelcast.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=2048)


@register("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the fixed patterns and what the network adds."""
    from panelcast.llm.secrets import digest, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = digest(F.filter("spans", lambda s: s["kind"] != "cnn"))
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


@register("op2_lattice_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at cosine 0.9 through lattice cells."""
    from panelcast.llm.lattice import lattice_dedup

    return lattice_dedup(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@register(
    "op10_maxscore_top_k",
    """WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
  CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, v.e)]) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows by integer inner product for every vector whose id is divisible by 20."""
    from panelcast.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@register("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    from panelcast.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _codes_sql(entries: int = 16, parts: int = 8, rounds: int = 6) -> str:
    """The rounds of op11 as one statement: assignment (a) and entries (b) of every round by turns."""
    sql = [
        """WITH kept AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""parts AS MATERIALIZED (SELECT vec_id, label, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS v
  FROM kept, (SELECT unnest(range({parts})) AS p))""",
        f"start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT p, j, v FROM parts JOIN start USING (vec_id))",
    ]
    for r in range(rounds + 1):
        sql.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, min([d, j]) AS m FROM (
  SELECT vec_id, parts.p, parts.v, j, CAST(list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(parts.v, b{r}.v)]) AS BIGINT) AS d
  FROM parts JOIN b{r} ON parts.p = b{r}.p) GROUP BY vec_id, p)""")
        if r < rounds:
            sql.append(f"""m{r} AS (SELECT p, j, list(x ORDER BY i) AS v FROM (SELECT p, j, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
  SELECT p, j, i, sum(x) AS s, count(*) AS n FROM (SELECT p, m[2] AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, j, i)) GROUP BY p, j)""")
            sql.append(f"b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.j, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} ON b{r}.p = m{r}.p AND b{r}.j = m{r}.j)")
    sql.append(f"""coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(m[2] AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id)""")
    sql.append(f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b{rounds})")
    return ",\n".join(sql) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest"""


@register("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings coded by eight codebooks of 16 entries, six rounds of integer k-means."""
    from panelcast.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizers, with the corpus-wide counts of their linked ids."""
    from panelcast.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


@register(
    "op12_line_dedup",
    """WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
held AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, coalesce(top <> doc_id, false) AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of at least 20 characters that three or more hold, but for the largest id's."""
    from panelcast.llm.linededup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
