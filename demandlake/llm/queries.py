"""One registered query per operator of this subpackage; each applies it,
with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlake.llm import bytebpe, dartminhash, hnsw, impact, importance, langid, mixing, pieces, pseudonyms, quality, revisits, shards, suffixes, vafile
from demandlake.llm.common import crc_remainder, table

# a deployment passes its own secret; this one makes the query repeatable
PSEUDONYM_KEY = "demandlake-demonstration-key"
MODEL_FILE = public_tokenizers.path("piece_bpe_32k.model")
RANKS_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op6_dartminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dartminhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "copy_of", "class_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL_FILE, check="texts")
    return out.select("doc_id", "n_tokens", F.sha2("ids_u32le", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_remainder("doc_id", 3) != 1))
    out = langid.predict(docs.drop("lang"), model)
    return out.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"),
                      F.col("nearest").alias("lang_pred"), "score", "rejected")


def op1_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


# domain weights by tokens
MIX_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows of ``docs`` with their language as the domain."""
    return docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "text", F.col("lang").alias("domain"))


def op2_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), MIX_TARGETS)
    return out.select("doc_id", "n_tokens", F.to_json("domains").alias("domains"), "rate", "copies",
                      F.to_json("targets").alias("targets"), F.to_json("reached").alias("reached"))


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def op4_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = revisits.resolve(revisits.records_from_pages(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return out.select("record_id", "canonical_url", "kind", "resolution", "ref_id", "status",
                      F.array_join(lines, "\n").alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


def op5_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder("doc_id", 5) == 0
    model = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = shards.finite("embedding")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(finite, whole).alias("embedding"))
    return impact.topk(rows, F.col("vec_id") % 20 == 0, 20)


def op11_vafile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vafile.digest(*vafile.cluster(table(spark, sf_dir, "embeddings"), vafile.TOP, vafile.ROUNDS, seed=2))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    if public_tokenizers.PATTERN != bytebpe.SPLIT:
        raise ValueError("the tokenizer's split is not the one the automaton carries out")
    out = bytebpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS_FILE)
    return out.select("doc_id", "n_tokens", F.sha2("ids_u32le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hnsw_search, op2_mixing_rates, op3_pii_feistel, op4_revisit_resolution, op5_quality_attention, op6_dartminhash_classes,
                                       op7_suffix_dedup, op8_sentencepiece, op9_language_id,
                                       op10_impact_topk, op11_vafile_clusters, op12_importance_resampling, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op4_revisit_resolution": revisits.RESOLVED_PAGES_SQL, "op11_vafile_clusters": vafile.CLUSTERED_SQL}
