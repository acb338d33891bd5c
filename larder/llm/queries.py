"""The registered queries of the text operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, codes, decontaminate, langid, lm, near, pii, resample, sharding, substring, suffix
from .common import tune

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: what is left of its words without windows that start in a document of a smaller id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.deduplicate(docs)
    return out.select("doc_id", "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20, among all rows."""
    return ann.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0, 20)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class of near and exact copies, its copies, and the different texts it is linked to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near.join(docs).select("doc_id", "class_id", "n_copies", "n_links")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds; clean documents have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: ids of its whole text and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.tokenize(docs).drop("text")
    coded = coded.withColumn("decoded", bpe.decode(F.col("ids")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; one in seven, by the digest of its id, is kept from training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, learn=~lm.held_out("doc_id"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: what is left of it without strings of 400 bytes that occur twice.

    n_passage: bytes covered by strings of suffix.PASSAGE bytes that occur twice; passages shorter than 400 bytes show there.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix.drop_repeats(docs, passage=suffix.PASSAGE)
    covered = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        covered("removed").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        covered("passages").alias("n_passage"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; one in four, by the digest of its id, is kept from training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out("doc_id")
    return langid.identify(docs, learn=~out).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation, and one for a conversation whose texts look like the template."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text")
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


SQL_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
    regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') AS head FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its shard of eight, by bytes. The last column belongs to another law and is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs).withColumn("grown_shard", F.lit(None).cast("int"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: personal data that the patterns find, and all spans with what the model adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector: its code by codebooks of sixteen parts, and the squared error."""
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def _assigned(books: str) -> str:
    """SQL: every part with its nearest entry in a codebook table."""
    return f"""SELECT r, part, p, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT v.r, v.part, v.p, e.entry, list_sum(list_transform(list_zip(v.p, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM parts v JOIN {books} e USING (part)) GROUP BY r, part, p"""


def _moved(books: str, assigned: str) -> str:
    """SQL: the codebooks after a round."""
    return f"""SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM {books} e LEFT JOIN (
    SELECT part, entry, list(floor(total::DOUBLE / n)::BIGINT ORDER BY k) AS c FROM (
      SELECT part, entry, k, sum(p[k]) AS total, count(*) AS n FROM {assigned}, range(1, len(p) + 1) t(k) GROUP BY part, entry, k)
    GROUP BY part, entry) m USING (part, entry)"""


SQL_OP12 = f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS p FROM kept, range(16) t(part)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, p AS c FROM parts WHERE r <= 64),
a0 AS MATERIALIZED ({_assigned("b0")}), b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}), b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (SELECT r, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: how much like the benchmark its words are, and its rank among the tenth drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL_OP13 = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))
), lowered AS (
  SELECT doc_id, true AS own, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT item_id, false, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), found AS (SELECT doc_id, own, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM lowered),
counted AS MATERIALIZED (SELECT doc_id, own, w, count(*) AS n FROM found GROUP BY ALL),
bucketed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT w FROM counted), crc
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0)::DOUBLE AS t FROM counted JOIN bucketed USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS g FROM sums
), weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM counted JOIN bucketed USING (w) JOIN gain USING (bucket) WHERE own GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_hilbert_ann, op3_ngram_jaccard, op4_decontaminate, op5_byte_bpe, op6_lm_score, op7_suffix_dedup, op8_language_id, op9_chat_format, op10_sharding, op11_pii, op12_vector_codes, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op9_chat_format": SQL_OP9, "op12_vector_codes": SQL_OP12, "op13_resample": SQL_OP13}
