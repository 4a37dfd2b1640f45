"""The operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.llm import filteraudit, flac, langid, lexsearch, linededup, mergecodec, mixing, packing, quality, secrets, simhash, tokencounts, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(langid.sample(docs.where(remainder("doc_id", 3) != 1)))
    out = langid.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), keep=["doc_id"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), keep=["doc_id"])
    base = tuple(k.name for k in secrets.KINDS if k.base)
    return found.select("doc_id", *(F.expr(f"bigint(size(filter(found, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in base), F.sha2(secrets.digest(F.col("found"), base), 256).alias("base_sha256"), secrets.digest(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_on(toxicity.sample(docs, labels.where(remainder("doc_id", 5) != 0)))
    out = toxicity.predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.media_features(documents(spark, sf_dir), keep=["doc_id"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), keep=["doc_id"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_common_lines(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mergecodec.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), packed=True, decoded=True, keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=50)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_mixing, op4_secrets, op5_toxicity, op6_simhash, op7_quality, op8_flac, op9_token_counts, op10_line_dedup, op11_sentencepiece, op12_lexical_search, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE_SQL, "op4_secrets": secrets.ORACLE_SQL, "op7_quality": quality.ORACLE_SQL, "op10_line_dedup": linededup.ORACLE_SQL, "op12_lexical_search": lexsearch.ORACLE_SQL, "op13_filter_audit": filteraudit.ORACLE_SQL}
