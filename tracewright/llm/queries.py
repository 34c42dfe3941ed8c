"""The thin queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import chat, exact_dedup, line_dedup, mixing, packing, quality, repair, sharding, simhash, spelling, suffix_dedup, urlfilter, vafile
from tracewright.llm.common import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- 2 -----------------------------------------------------------------------------------------------------------

SHARDS = 40


@query
def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.external_shuffle(docs, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# --- 4 -----------------------------------------------------------------------------------------------------------


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)


@query
def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.gathered(chat.examples(chat.format_conversations(conversations(spark, sf_dir))))
    out = out.withColumn("turns", chat.parse(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_examples",
        "context_chars",
    )


SQL["op4_prefix_targets"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\e') AS body,
    replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\e'), ': ', '\c') AS head
  FROM t
), x AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 14) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) + 6 AS context
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples,
  CAST(coalesce(sum(context) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS context_chars
FROM x GROUP BY conv_id
"""


# --- 7 -----------------------------------------------------------------------------------------------------------


@query
def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = mixing.mix(docs, weights=[3, 1, 2], budget_percent=150, max_epochs=2)
    return sized.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


SQL["op7_water_filling"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS cap,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100.0 AS budget,
    coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w
), v AS (
  SELECT *, max(CASE WHEN (budget - cap_before) / weight_left * weight <= cap THEN (budget - cap_before) / weight_left END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > cap THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM v
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(floor(rate) + CASE WHEN 2 * before + size < 2 * (target - floor(rate) * source_size) THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM r
"""


# --- 10 ----------------------------------------------------------------------------------------------------------


@query
def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op10_chunk_recipes"] = """
SELECT doc_id, keep_id, group_size, kept, text_sha256
FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
    count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, sha256(coalesce(text, '')) AS text_sha256
  FROM documents
)
"""


# --- 6 -----------------------------------------------------------------------------------------------------------

CAPACITY = 1024


def tokenizer() -> dict:
    """Where the byte-level BPE lies; the package that ships it is asked, nothing is copied."""
    import public_tokenizers as public

    return {"path": public.path("byte_bpe_50k.json"), "pattern": public.PATTERN, "ranks_path": public.path("byte_bpe_50k.tiktoken")}


def packed(docs: DataFrame) -> DataFrame:
    rows = materialize(packing.pieces(docs, tokenizer(), CAPACITY), "pieces")
    return packing.assign(rows, CAPACITY)


@query
def op6_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 9 -----------------------------------------------------------------------------------------------------------


@query
def op9_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, max_bits=3, seed=42)
    return out.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


# --- 3 -----------------------------------------------------------------------------------------------------------


@query
def op3_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(rows, F.col("vec_id") % 50 == 0, 5)


SQL["op3_va_file"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


# --- 8 -----------------------------------------------------------------------------------------------------------

#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op8_char_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


# --- 1 -----------------------------------------------------------------------------------------------------------


@query
def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


# --- 5 -----------------------------------------------------------------------------------------------------------


@query
def op5_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# --- 11 ----------------------------------------------------------------------------------------------------------


@query
def op11_full_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


# --- 12 ----------------------------------------------------------------------------------------------------------


@query
def op12_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_conversations(repair.damage(rows))


# --- 13 ----------------------------------------------------------------------------------------------------------


@query
def op13_two_blooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL["op13_two_blooms"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS first FROM k WHERE length(key) >= 10 GROUP BY key
  HAVING min(coalesce(doc_id, 9223372036854775807)) <> max(coalesce(doc_id, 9223372036854775807))
), g AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> coalesce(k.doc_id, 9223372036854775807) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r
"""
