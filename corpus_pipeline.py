"""Five stages from raw documents to encoded, clean, distinct ones.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of the documents.

Defined cases, of every stage: an empty table gives an empty one; columns besides `doc_id` and
`text` are passed through whatever their names, and `n_chars` follows a shortened text. A null or
empty text has no words, so the first stage drops it; later stages, given one by themselves, keep
it as it is. Repeated rows: the second stage keeps one row of each id that it keeps. A null id:
kept by the first, third and fourth stage, its text untouched. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailspark.llm.decontaminate import decontaminate
from trailspark.llm.paragraphs import remove_repeats
from trailspark.llm.quality import quality_rules
from trailspark.llm.queries import bpe_digests
from trailspark.llm.simhash import one_of_each
from trailspark.llm.tables import read_table, saved

#: Bytes of a batch that the last stage sends to Python.
BATCH_BYTES = 8 << 20
#: SQL cannot express the stages from the second on; tests compare them with brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """Ids and texts, and all other columns in one, so that no column of a stage has their names."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(True).alias("_")).alias("_rest"))


def _unpacked(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in like.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return _unpacked(quality_rules(_packed(docs)).filter("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return _unpacked(one_of_each(_packed(docs)), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that an earlier document or place has."""
    cleaned = _unpacked(remove_repeats(_packed(docs), passages=True), docs)
    if "n_chars" in docs.columns:
        n_chars = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", n_chars)
    return cleaned


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    judged = decontaminate(_packed(docs), read_table(spark, sf_dir, "benchmark"))
    return _unpacked(judged.filter("NOT contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the token ids and of the bytes decoded from them.

    By now an executor's heap is as large as it gets, so the batches to Python are kept small.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return bpe_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
