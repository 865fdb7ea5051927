"""The registered queries of the operators: thin calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bandwise.llm import audit, chat, decontam, hilbert, html, lsh, packing, runs, simhash, suffixes, tokens, toxicity, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert.hilbert_shards(_table(spark, folder, "documents"))


def op5_snapshot_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render_chats(_table(spark, folder, "conversations"))


def op6_suffix_levels(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.deduplicated(_table(spark, folder, "documents")).drop("kept", "row")


def op7_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return packing.best_fit(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_members(spark: SparkSession, folder: str) -> DataFrame:
    return warc.page_records(_table(spark, folder, "pages")).drop("member_offset", "member_length")


def op9_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    return lsh.embedding_links(_table(spark, folder, "embeddings"))


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return html.main_texts(pages, html.train(pages))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(_table(spark, folder, "documents"), rewrite=runs.planted))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    written = tokens.token_files(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_digests(spark, written)


QUERIES = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_snapshot_chats": op5_snapshot_chats,
    "op6_suffix_levels": op6_suffix_levels,
    "op7_best_fit": op7_best_fit,
    "op8_warc_members": op8_warc_members,
    "op9_embedding_links": op9_embedding_links,
    "op10_main_text": op10_main_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
}
ORACLES: dict[str, str] = {"op5_snapshot_chats": chat.ORACLE, "op8_warc_members": warc.ORACLE, "op11_filter_audit": audit.ORACLE}
