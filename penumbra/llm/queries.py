"""The operators' queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, cutting, dom, layouts, mixing, packing, preference, quality, repair, simhash, tiered, toxicity, vantage, warc
from .common import doc_crc, table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.swapped_replies(table(spark, sf_dir, "conversations")))


def op2_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding"))
    return vantage.nearest(rows.filter(F.pmod("vec_id", F.lit(20)) == 0), rows, k=20)


def op3_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def fourth_held_out(doc_id):
    return F.pmod(doc_crc(doc_id), F.lit(4)) == 2


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, lambda i: ~fourth_held_out(i))
    return quality.scored(docs, model).select("doc_id", fourth_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer())


#: Labelled pages that the field is fitted to.
LAYOUT_PAGES = 600


def op6_dom_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.extracted(table(spark, sf_dir, "pages"), dom.fit(layouts.pages(LAYOUT_PAGES)))


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.edits(table(spark, sf_dir, "documents"))


def op8_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.captures(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def fifth_held_out(doc_id):
    return F.pmod(doc_crc(doc_id), F.lit(5)) == 0


def op10_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, lambda i: ~fifth_held_out(i))
    return toxicity.scored(docs, model).select("doc_id", fifth_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cutting.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_preference_format, op2_vantage_trees, op3_cube_mixing, op4_rule_ensemble, op5_best_two_fit, op6_dom_field, op7_bottom_k_fingerprints, op8_simhash_balls, op9_warc_index_merge, op10_recurrent_toxicity, op11_tiered_search, op12_turn_repair, op13_cutting_stock)}
ORACLES: dict[str, str] = {
    "op1_preference_format": preference.ORACLE,
    "op2_vantage_trees": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_warc_index_merge": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f ON f.digest = p.digest""",
    "op11_tiered_search": tiered.ORACLE,
    "op12_turn_repair": repair.ORACLE,
}
