"""The network against one written out word by word, and how often texts are cut into words."""

from __future__ import annotations

import numpy as np
import pytest

from trailspark.llm import language_model
from trailspark.llm.gru import CLASS_SIZE, HIDDEN, Model, Trainer
from trailspark.llm.language_model import score_documents

WORDS, BEGIN = 70, 0


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def log_shares(logits):
    logits = np.minimum(logits, 80)
    return logits - np.log(np.exp(logits).sum())


def plain(p: dict, text) -> float:
    """The natural log probability of a text."""
    h, before, total = np.zeros(HIDDEN), BEGIN, 0.0
    for y in text:
        (az, ar, an), (gz, gr, gn) = p["input"][before].reshape(3, HIDDEN), (h @ p["state"]).reshape(3, HIDDEN)
        z, r = sigmoid(az + gz), sigmoid(ar + gr)
        n = np.tanh(an + r * gn)
        h = n + z * (h - n)
        k, inner = divmod(y, CLASS_SIZE)
        held = min(CLASS_SIZE, WORDS - k * CLASS_SIZE)
        total += log_shares(h @ p["class"] + p["class_bias"])[k]
        total += log_shares((p["word"][k] @ h + p["word_bias"][k])[:held])[inner]
        before = y
    return total


def double(model: Model) -> dict:
    return {k: v.astype(np.float64) for k, v in model.p.items()}


@pytest.mark.parametrize("large", [False, True])
def test_scores(large):
    random = np.random.default_rng(3)
    model = Model(WORDS, random.integers(1, 100, WORDS))
    if large:  # gates beyond the range of single precision, logits that are cut
        model.p["input"] *= 2000
        model.p["class"] *= 100
        model.p["word"] *= 100
    texts = [random.integers(0, WORDS, n).astype(np.int32) for n in (0, 1, 5, 3000, 40, *random.integers(1, 9, 700))]
    p = double(model)
    for got, text in zip(model.log10(texts, BEGIN), texts):
        assert got == pytest.approx(plain(p, text) / np.log(10), rel=1e-5, abs=1e-3)


def test_gradients():
    random = np.random.default_rng(5)
    # more texts than lanes, so that some lanes hold two
    texts = [random.integers(0, WORDS, n).astype(np.int32) for n in random.integers(1, 7, 600)]
    seen = []

    class Watched(Trainer):
        def _step(self, grads, tokens):
            seen.append((grads, tokens))

    model = Model(WORDS)
    trainer = Watched(model)
    trainer.learn(texts, BEGIN)
    [(grads, tokens)] = seen
    assert tokens == trainer.tokens == sum(map(len, texts))
    p = double(model)
    for name, values in p.items():
        steepest = np.unravel_index(np.argsort(-np.abs(grads[name]), axis=None)[:2], values.shape)
        for place in zip(*steepest):
            kept, losses = values[place], []
            for step in (1e-4, -1e-4):
                values[place] = kept + step
                losses.append(-sum(plain(p, t) for t in texts))
            values[place] = kept
            assert grads[name][place] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3, abs=1e-3), name


def test_a_text_is_cut_into_words_once_a_pass(spark, sf_dir, monkeypatch, tmp_path):
    """Counting, learning, scoring: three times where a document is learned from, else once."""
    cut, log = language_model.tokens, str(tmp_path / "calls")

    def tokens(text):
        with open(log, "a") as calls:
            calls.write(".")
        return cut(text)

    monkeypatch.setattr(language_model, "tokens", tokens)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id < 50")
    rows = score_documents(docs).collect()
    held_out = sum(r["held_out"] for r in rows)
    with open(log) as calls:
        assert len(calls.read()) == 3 * (len(rows) - held_out) + held_out
