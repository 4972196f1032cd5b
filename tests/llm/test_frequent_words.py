"""What language-model scoring sends to the driver, and that it does not change scores."""

from __future__ import annotations

import math
import random

import pytest

from trailspark.llm import language_model
from trailspark.llm.language_model import frequent_words, score_documents


@pytest.fixture(scope="module")
def counts(spark):
    rnd = random.Random(4)
    rows = [("", 5)] + [(f"w{k}", int(1 + 10 / rnd.random() ** 0.7)) for k in range(2000)] + [(f"once{k}", 1) for k in range(3000)]
    return spark.createDataFrame(rows, "word string, c long").repartition(7), dict(rows)


@pytest.mark.parametrize("n", [10, 200, 1500, 4000, 10_000])
def test_the_most_frequent_words(counts, n, monkeypatch):
    monkeypatch.setattr(language_model, "VOCABULARY", 5)
    df, every = counts
    head = {r["word"]: r["c"] for r in frequent_words(df, n)}
    assert head.pop("") == 5 and len(head) < n + 5 and all(every[w] == c for w, c in head.items())
    rest = [c for w, c in every.items() if w and w not in head]
    assert not rest or max(rest) <= min(head.values())


def test_ties_fill_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(language_model, "VOCABULARY", 50)
    df = spark.createDataFrame([(f"w{k:03d}", 1) for k in range(500)], "word string, c long")
    assert sorted(r["word"] for r in frequent_words(df, 10)) == [f"w{k:03d}" for k in range(50)]


def test_scores_do_not_depend_on_what_is_sent(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    monkeypatch.setattr(language_model, "VOCABULARY", 40)
    scores = []
    for head in (1 << 17, 100):
        monkeypatch.setattr(language_model, "HEAD", head)
        rows = score_documents(docs.repartition(1)).collect()
        scores.append({r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in rows})
    for k, (n, known, base, score) in scores[0].items():
        other = scores[1][k]
        assert other[:2] == (n, known) and math.isclose(other[2], base, rel_tol=1e-9) and math.isclose(other[3], score, rel_tol=1e-6)
