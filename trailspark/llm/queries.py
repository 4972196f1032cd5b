"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.llm.bpe import read_ranks, round_trip
from trailspark.llm.centroids import centroid_digest, cluster_vectors, with_inertia
from trailspark.llm.content import extract_pages
from trailspark.llm.decontaminate import decontaminate
from trailspark.llm.fill_middle import fill_middle, restore_text
from trailspark.llm.language_model import score_documents
from trailspark.llm.licenses import LICENSE_COLUMNS, scan_licenses
from trailspark.llm.paragraphs import remove_repeats
from trailspark.llm.quality import quality_rules
from trailspark.llm.simhash import near_duplicates
from trailspark.llm.suffixes import remove_repeated_strings
from trailspark.llm.tables import read_table, saved, scratch, whole_text
from trailspark.llm.token_counts import count_tokens
from trailspark.llm.warc import page_number, round_trip as archive_round_trip

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode the ids, and keep digests of both."""
    done = round_trip(docs.select("doc_id", "text"), read_ranks(RANKS), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove_repeated_strings(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first: every run encodes what is distinct."""
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(docs, TOKENIZER, scratch(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, passages=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "contaminated", "item_ids", "kinds")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *LICENSE_COLUMNS.names)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = restore_text(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored.cast("binary"), 256).alias("restored_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return records.select(
        page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_number("refers_to").alias("refers_to"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    assigned, centroids = cluster_vectors(vectors)
    assigned = saved(assigned.select("vec_id", "cluster", "distance"), "assigned-vectors")
    digests = F.array(*(F.lit(centroid_digest(c)) for c in centroids), F.lit(None).cast("string"))
    return with_inertia(assigned, centroids).withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_model": op1_language_model,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_html_extraction": op5_html_extraction,
    "op6_simhash": op6_simhash,
    "op7_paragraph_dedup": op7_paragraph_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_fill_middle": op11_fill_middle,
    "op12_warc": op12_warc,
    "op13_centroids": op13_centroids,
}
