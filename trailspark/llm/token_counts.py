"""Token counts from a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, token count) in a folder
that all executors share. `count_tokens` digests each text and the tokenizer's own file, joins
both to the cache, encodes one copy of each text that is missing, appends the new counts and
joins the counts to the rows. Two runs at a time at worst append the same count twice, which
reading the cache undoes. Content is normalised by turning null into the empty text and
nothing else, since any other change could change a count.

Defined cases: a null text counts as empty (0 tokens); equal texts, in any number, are encoded
once: copies meet as (digest, text) after a combine on the map side, so a group of copies that
holds a third of all rows is one row per task; a tokenizer file of another content has another
digest and never finds old counts; an empty table gives no rows and appends nothing; other
columns are passed through.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from trailspark.llm.batches import map_rows
from trailspark.llm.bpe import Memo, chunks
from trailspark.llm.tables import whole_text

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def tokenizer_digest(kind: str, content: bytes) -> str:
    """Stands for the tokenizer and its version: the digest of its file and the kind of library."""
    return hashlib.sha256(kind.encode() + b"\0" + content).hexdigest()


class Counter:
    """Counts as the library does; `kind` is the file's extension.

    Where the tokenizer cuts its input by the byte-level pattern and does not change it first,
    no token crosses a space before a visible character, so the count of a text is the sum over
    its chunks, and the library encodes each distinct chunk once. A text that holds one of the
    tokenizer's added tokens, and any other tokenizer, goes to the library whole.
    """

    def __init__(self, kind: str, content: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.by_chunks, self.added = False, []
        if kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.library = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        rules = json.loads(content)
        tokenizer = Tokenizer.from_buffer(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.library = lambda texts: [
            len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)
        ]
        before = rules.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in rules.get("added_tokens", [])]
        self.by_chunks = (
            rules.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and rules["model"].get("dropout") is None
        )
        self.memo = Memo(lambda new: self.library([" " + chunk for chunk in new]), entries=400_000)

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_chunks:
            return self.library(texts)
        counts: list[int | None] = [None] * len(texts)
        plain = [k for k, text in enumerate(texts) if not any(t in text for t in self.added)]
        cut = [chunks(texts[k]) for k in plain]
        rests = self.memo.look_up([rest for _, *rest in cut])
        for k, head, rest in zip(plain, self.library([first for first, *_ in cut]), rests):
            counts[k] = head + sum(rest)
        whole = [k for k, n in enumerate(counts) if n is None]
        for k, n in zip(whole, self.library([texts[k] for k in whole])):
            counts[k] = n
        return counts


_counters: dict[str, Counter] = {}


def encode_counts(texts: DataFrame, kind: str, content: bytes) -> DataFrame:
    """Add `n_tokens` to rows with a column `text` that has no nulls."""
    digest = tokenizer_digest(kind, content)

    def make():
        if digest not in _counters:
            _counters[digest] = Counter(kind, content)
        counter = _counters[digest]
        return lambda values: [(n,) for n in counter.count(values)]

    added = StructType([StructField("n_tokens", LongType(), False)])
    keep = [c for c in texts.columns if c not in ("text", "n_tokens")]
    return map_rows(texts, keep, ["text"], added, make)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """What the cache holds, each count once; empty before the first append."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)
    return cache


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """Add `n_tokens`; texts not yet in the cache at `cache` are encoded and appended to it."""
    spark = docs.sparkSession
    kind, content = os.path.splitext(tokenizer)[1], tokenizer_bytes(tokenizer)
    version = tokenizer_digest(kind, content)
    docs = docs.drop("n_tokens")

    def digest(column):
        return F.unhex(F.sha2(column.cast("binary"), 256))

    def stored():
        rows = read_cache(spark, cache).filter(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    contents = docs.select(whole_text(text).alias("text"))
    contents = contents.select(digest(F.col("text")).alias("digest"), "text")
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("digest")
    misses = contents.join(known, "digest", "left_anti") if not known.isEmpty() else contents
    misses = misses.groupBy("digest").agg(F.first("text").alias("text"))
    counted = encode_counts(misses, kind, content)
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    found = docs.withColumn("_digest", digest(whole_text(text)))
    lean = stored().withColumnRenamed("digest", "_digest")
    return found.join(lean, "_digest", "left").drop("_digest")
