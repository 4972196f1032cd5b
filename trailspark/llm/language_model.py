"""Scoring documents with a recurrent language model learned from the corpus.

1. Words of all training documents are counted (combined in the task, then by Spark).
2. The model's vocabulary is the most frequent words, the end of a text, and one token for all
   other words. Every training document is learned from once: the documents are dealt to
   rounds of growing size, each task of a round starts from the same weights and learns from
   its own documents, and the weights are averaged in proportion to the tokens seen.
3. Every document is scored whole. A word outside the vocabulary costs the probability of the
   token for other words times the word's smoothed share among them, so probabilities of all
   words, with one for all unseen ones, add up to one.

Counts of the most frequent words go to every task, fewer than `HEAD` of them; counts of
rarer words are joined by word, which no longer can be a hot key.

Defined cases: null and empty texts are the end alone; a null id counts as the text '' when
documents are dealt, and is held out; texts of any length are learned from and scored whole,
state carried across windows; equal rows are scored alike and all returned; without training
documents every word is unseen and the untrained weights score; an empty table gives no rows;
other columns are passed through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType,
)

from trailspark.llm.batches import importable
from trailspark.llm.gru import Model, Trainer
from trailspark.llm.tables import saved, whole_text

#: Words whose counts go to every task.
HEAD = 1 << 17
#: Token types of the model, with the end and the token for other words.
VOCABULARY = 1024
#: Shares of the training documents in the rounds, in 32nds; together all of them.
ROUNDS = (1, 3, 8, 20)
SMOOTHING = 0.1
#: Documents laid out in lanes together, and words counted before they are handed to Spark.
DOCUMENTS = 10_000
COUNTED = 400_000
END, OTHER = 0, 1
#: The end of a text among the words; no word is empty.
END_WORD = ""


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of the words and ends of a column `text`."""
    importable(texts.sparkSession)
    schema = StructType([StructField("word", StringType(), False), StructField("c", LongType(), False)])
    arrow = to_arrow_schema(schema)

    def emit(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        times = np.fromiter(counts.values(), np.int64, len(counts))
        return pa.RecordBatch.from_arrays([words, pa.array(times)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                counts[END_WORD.encode()] += 1
                if len(counts) > COUNTED:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    return texts.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, n: int) -> list[Row]:
    """The end of texts and the most frequent words, fewer than `n` in all.

    How many words lie on each of some thousands of steps of the count says down to which step
    they are few enough, so the driver gets those words and no others, whatever the number of
    tasks. Where that is less than the model's vocabulary, the next most frequent fill it.
    """
    step = F.floor(F.log2("c") * 1000)
    words = counts.filter(F.col("word") != END_WORD)
    steps = words.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    total, least = 0, -1
    for row in sorted(steps, key=lambda r: -r["step"]):
        if total + row["words"] >= n:
            least = row["step"]
            break
        total += row["words"]
    head = counts.filter((F.col("word") == END_WORD) | (step > least)).collect()
    if least >= 0 and total < VOCABULARY:
        head += words.filter(step <= least).orderBy(F.desc("c"), "word").limit(VOCABULARY).collect()
    return head


def numbers(words: list[bytes], ids: dict[bytes, int], other: int) -> np.ndarray:
    return np.fromiter(map(ids.get, words, repeat(other)), np.int32, len(words))


class Vocabulary:
    """Counts of frequent words, and the model's ids of the most frequent ones."""

    def __init__(self, head: list[tuple[str, int]], n: int, types: int):
        counts = {w.encode(): c for w, c in head}
        ends = counts.pop(END_WORD.encode(), 0)
        self.end_count = ends
        ranked = sorted(counts, key=lambda w: (-counts[w], w))
        frequent = ranked[: VOCABULARY - 2]
        #: Of all frequent words; the first of them are the model's ids.
        self.head = {w: k + 2 for k, w in enumerate(ranked)}
        self.ids = {w: k + 2 for k, w in enumerate(frequent)}
        self.words = len(frequent) + 2
        self.n, self.types = n, types
        known = sum(counts[w] for w in frequent) + ends
        self.other_total = n - known + SMOOTHING * (types - len(frequent) - (ends > 0) + 1)
        self.total = n + SMOOTHING * (types + 1)
        self.shares = np.array([ends, n - known, *(counts[w] for w in frequent)], np.float64)
        #: By id of a frequent word; nothing for all other words.
        self.log_counts = np.log10([1.0, 1.0, *(counts[w] + SMOOTHING for w in ranked)])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, DOCUMENTS):
            yield batch.slice(start, DOCUMENTS)


_WEIGHTS = StructType([StructField("weights", BinaryType(), False), StructField("tokens", LongType(), False)])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task: the mean of the weights, by tokens."""
    total, seen, words = None, 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            model = Model.load(row["weights"])
            words, n = model.words, row["tokens"]
            scaled = {k: v.astype(np.float64) * n for k, v in model.p.items()}
            total = scaled if total is None else {k: total[k] + v for k, v in scaled.items()}
            seen += n
    if total is not None:
        model = Model(words)
        model.p = {k: (v / seen).astype(np.float32) for k, v in total.items()}
        yield pa.RecordBatch.from_pylist(
            [{"weights": model.dump(), "tokens": seen}], schema=to_arrow_schema(_WEIGHTS)
        )


def train(texts: DataFrame, vocabulary: Vocabulary) -> bytes:
    """Weights after one pass over all texts, in rounds."""
    weights, start = Model(vocabulary.words, vocabulary.shares).dump(), 0
    arrow = to_arrow_schema(_WEIGHTS)
    share = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(sum(ROUNDS)))
    ids = vocabulary.ids
    for size in ROUNDS:
        chosen = texts.filter((share >= start) & (share < start + size)).select("text")
        start += size

        def learn(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Model.load(weights))
            for pack in _packs(batches):
                texts = pack.column(0).to_pylist()
                trainer.learn([np.append(numbers(tokens(t), ids, OTHER), np.int32(END)) for t in texts], END)
            if trainer.tokens:
                row = {"weights": trainer.model.dump(), "tokens": trainer.tokens}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

        learned = chosen.mapInArrow(learn, _WEIGHTS)
        tasks = learned.rdd.getNumPartitions()
        while tasks > 1:  # a tree: nobody holds the weights of more than sixteen tasks
            tasks = -(-tasks // 16)
            learned = learned.repartition(tasks).mapInArrow(_average, _WEIGHTS)
        rows = learned.collect()
        weights = rows[0]["weights"] if rows else weights
        weights = bytes(weights)
    return weights


_TAIL = StructType([StructField("word", StringType(), False), StructField("tf", LongType(), False)])
_PARTS = [
    StructField("n_tokens", LongType(), False),
    StructField("known", LongType(), False),
    StructField("base", DoubleType(), False),
    StructField("model", DoubleType(), False),
    StructField("tail", ArrayType(_TAIL, False), False),
]


def _score_parts(rows: DataFrame, vocabulary: Vocabulary, weights: bytes) -> DataFrame:
    """Add what a task knows: sums over frequent words, and the rare words for a join."""
    importable(rows.sparkSession)
    keep = [c for c in rows.columns if c != "text"]
    schema = StructType([*(rows.schema[c] for c in keep), *_PARTS])
    arrow, parts = to_arrow_schema(schema), to_arrow_schema(StructType(_PARTS))
    head, log_counts, words_of_model = vocabulary.head, vocabulary.log_counts, vocabulary.words
    end_known, log_end = int(vocabulary.end_count > 0), math.log10(vocabulary.end_count + SMOOTHING)
    log_other, log_total = math.log10(vocabulary.other_total), math.log10(vocabulary.total)

    def part(text: str, tail: list[bytes], times: list[int]) -> tuple[np.ndarray, tuple]:
        """The model's ids, and (n_tokens, known, base, the model's share besides its own score).

        Adds the rare words and how often they occur to the tail.
        """
        words = tokens(text)
        ids = numbers(words, head, OTHER)
        rare = ids == OTHER
        others = Counter(compress(words, rare.tolist()))
        tail.extend(others)
        times.extend(others.values())
        logs, outside = log_counts[ids], ids >= words_of_model
        n, known = len(words) + 1, len(words) - int(rare.sum()) + end_known
        n_other = int(rare.sum()) + int(outside.sum())
        base, model = log_end + float(logs.sum()), float(logs[outside].sum())
        ids[outside] = OTHER
        return np.append(ids, np.int32(END)), (n, known, base - n * log_total, model - n_other * log_other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Model.load(weights)
        for pack in _packs(batches):
            ids, made = [], []
            for start in range(0, pack.num_rows, 1000):
                tail, times, ends, sums = [], [], [0], []
                for t in pack.column("text").slice(start, 1000).to_pylist():
                    known_ids, row = part(t, tail, times)
                    ids.append(known_ids)
                    sums.append(row)
                    ends.append(len(tail))
                rare = pa.StructArray.from_arrays(
                    [pa.array(tail, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], fields=list(parts.field("tail").type.value_type)
                )
                rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare, type=parts.field("tail").type)
                made.append((sums, rare))
            scores = np.array(network.log10(ids, END))
            for start, (sums, rare) in zip(range(0, pack.num_rows, 1000), made):
                n, known, base, model = (np.array(x) for x in zip(*sums))
                columns = [n, known, base, model + scores[start : start + 1000]]
                columns = [pa.array(x, f.type) for x, f in zip(columns, parts)]
                kept = pack.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), *columns, rare], schema=arrow)

    return rows.select(*keep, "text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace the text by `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c not in (text, *added)]
    rows = docs.select(
        F.struct(*others).alias("rest"), whole_text(text).alias("text"), held_out(doc_id).alias("held_out")
    )
    training = rows.filter(~F.col("held_out")).select("text")
    counts = saved(word_counts(training), "word-counts")
    n, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent_words(counts, HEAD)
    vocabulary = Vocabulary([(r["word"], r["c"]) for r in head], n, types)
    weights = train(training, vocabulary)

    parts = saved(_score_parts(rows, vocabulary, weights).withColumn("_row", F.monotonically_increasing_id()), "scores")
    rare = parts.select("_row", F.inline("tail")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("_row").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10(c + SMOOTHING)).alias("more"),
    )
    whole = parts.drop("tail").join(sums, "_row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "rest.*", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
