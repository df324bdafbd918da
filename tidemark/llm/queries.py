"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontamination, html_extraction, language_id, neighbours, phrases, secret_scans, sharding, simhash, sql, token_counts, toxicity, url_filters, whitening

#: Rules of the URL query: (verdict, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    seen = fold("doc_id", 3) != 1
    return toxicity.fit(docs.select("doc_id", "text").where(seen), table(spark, sf_dir, "labels").where(seen))


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 4) != 2))


def op1_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op2_language_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = language_id.identify(docs.select("doc_id", "text"), language_model(docs))
    return told.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.template_subtrees(pages))


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_file("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, tokenizer_file("byte_bpe_50k.tiktoken"), pattern()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors, whitening.fit(vectors))
    # a deviation beyond a long is null here; the operator has it as a decimal
    by_component = white.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "identity_error")
    return by_component.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op12_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scans.Ledger(spark)
    secret_scans.scan(docs, ledger)
    kinds = ["assign", "access", "hex"]
    of_kind = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in kinds]
    base = secret_scans.listed(F.filter("found", lambda s: s["kind"].isin(kinds)))
    return secret_scans.findings(docs, ledger).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scans.listed(F.col("found")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity_pu, op2_language_hierarchical, op3_template_removal, op4_jump_sharding, op5_cross_polytope, op6_token_counts, op7_simhash, op8_link_graph, op9_latent_decontamination, op10_byte_bpe, op11_polarisation_whitening, op12_de_bruijn_phrases, op13_blob_ledger]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of what SQL can say; hashes, fitted models, tokenizers and fixed points have no functions in DuckDB, and tests/llm holds them against brute force."""
    return {"op12_de_bruijn_phrases": sql.PHRASES, "op13_blob_ledger": sql.SECRETS}
