"""The registered queries: each operator over its whole table, in the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, centroids, decontam, html, infill, langid, licenses, lm, neardup, packing, tokenstore, topk, toxicity
from .common import crc_mod

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a benchmark item in a document, within 5 % edits."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probabilities along the chain; ``toxic`` from one half on."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.toxic_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by key through the perfect hash index, read back from the shards."""
    store = tokenstore.write_store(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    rows = store.rows(spark)
    ids = tokenstore.read_ids(store, tokenstore.lookup(store, rows, copy="copy"))
    starts = rows.select(F.col("doc_id").alias("of"), F.col("copy").alias("nth"), F.col("start"))
    read = ids.select("doc_id", "copy", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("nth"))
    return read.join(starts, same).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("row")


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 1
    model = lm.train(docs.where(~held_out))
    scored = lm.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_weighted_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "linked")


def op9_topk_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html.extract(pages, html.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's transformed text and of the text rebuilt from it."""
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = infill.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster after three rounds, with the totals of distances."""
    return centroids.with_totals(centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    import public_tokenizers

    path = tokenizer_path(RANKS)
    encoded = bytebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    decoded = bytebpe.decode(encoded, path)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_edit_decontamination": op1_edit_decontamination,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_token_store": op3_token_store,
    "op4_license_scan": op4_license_scan,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_language_id": op6_language_id,
    "op7_trie_scores": op7_trie_scores,
    "op8_weighted_near_duplicates": op8_weighted_near_duplicates,
    "op9_topk_sorted_lists": op9_topk_sorted_lists,
    "op10_main_text": op10_main_text,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.oracle_sql(),
    "op9_topk_sorted_lists": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op11_fill_in_middle": infill.oracle_sql(),
    "op12_centroid_clusters": centroids.oracle_sql(),
}
