"""A small gated recurrent language model in numpy.

The next token is predicted in two factors, its class and the word within the class. Texts
run in lanes next to each other; a lane's state is carried from window to window and set to
zero where a text begins, so a text of any length is scored as a whole. Training cuts the
gradient at the ends of the windows and the state at the ends of long segments (truncated
backpropagation) and uses Adam.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np

HIDDEN = 16
CLASS_SIZE = 32
LANES = 512
WINDOW = 16
SEGMENT = 256
RATE = 0.01
#: Tokens of a window from which on it counts in full.
FULL = 4096
#: Logits are cut here.
LARGEST = 80


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; where the exponential is infinite the result is 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def exponentials(logits: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """(e^logits, their sums by row), in place; the bound keeps single precision from overflowing."""
    if not bounded:
        np.minimum(logits, LARGEST, out=logits)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], logits.dtype)


def _largest(weights: np.ndarray, bias: np.ndarray) -> float:
    return float((np.abs(weights).sum(axis=-1) + np.abs(bias)).max())


class Buffers:
    """Arrays by name whose memory serves every window; what one held is lost with the next."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        flat = self.held.get(name)
        if flat is None or len(flat) < size:
            flat = self.held[name] = np.empty(size, np.float32)
        return flat[:size].reshape(shape)


class Lanes:
    """Texts (arrays of token ids) laid out in lanes of similar length, the longest lane first."""

    def __init__(self, texts: list[np.ndarray], begin: int, lanes: int = LANES):
        order = sorted((k for k in range(len(texts)) if len(texts[k])), key=lambda k: -len(texts[k]))
        heap = [(0, lane) for lane in range(min(lanes, max(1, len(order))))]
        held: list[list[int]] = [[] for _ in heap]
        for k in order:
            size, lane = heapq.heappop(heap)
            held[lane].append(k)
            heapq.heappush(heap, (size + len(texts[k]), lane))
        held = sorted(held, key=lambda ks: -sum(len(texts[k]) for k in ks))
        self.lengths = np.array([sum(len(texts[k]) for k in ks) for ks in held], np.int64)
        steps = int(self.lengths.max(initial=0))
        self.held = held
        self.sizes = [[len(texts[k]) for k in ks] for ks in held]
        self.target = np.zeros((steps, len(held)), np.int32)
        self.input = np.full((steps, len(held)), begin, np.int32)
        self.carry = np.ones((steps, len(held)), np.float32)
        for lane, ks in enumerate(held):
            if not ks:
                continue
            tokens = np.concatenate([texts[k] for k in ks])
            self.target[: len(tokens), lane] = tokens
            self.input[1 : len(tokens), lane] = tokens[:-1]
            starts = np.concatenate(([0], np.cumsum(self.sizes[lane])[:-1]))
            self.input[starts, lane] = begin
            self.carry[starts, lane] = 0
        self.steps = steps

    def windows(self, widest: int = WINDOW):
        """(first step, end, lanes that have tokens there); wider, up to a bound, for fewer lanes."""
        start = 0
        while start < self.steps:
            active = int((self.lengths > start).sum())
            end = min(start + max(WINDOW, min(widest, WINDOW * LANES // active)), self.steps)
            yield start, end, active
            start = end


class Model:
    def __init__(self, words: int, counts: np.ndarray | None = None, seed: int = 11):
        """`words` counts the token types, which are ids from 0 on; at most 65,536.

        With their `counts` the untrained model predicts each by its share.
        """
        random = np.random.default_rng(seed)
        self.words = words
        self.buffer = Buffers()
        self.classes = classes = max(1, -(-words // CLASS_SIZE))
        self.p = {
            "input": random.normal(0, 0.1, (words, 3 * HIDDEN)).astype(np.float32),
            "state": random.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
            "class": random.normal(0, 0.1, (HIDDEN, classes)).astype(np.float32),
            "class_bias": np.zeros(classes, np.float32),
            "word": random.normal(0, 0.1, (classes, CLASS_SIZE, HIDDEN)).astype(np.float32),
            "word_bias": np.zeros((classes, CLASS_SIZE), np.float32),
        }
        self.absent = np.where(np.arange(classes * CLASS_SIZE) < words, 0, -1e9).astype(np.float32)
        self.absent = self.absent.reshape(classes, CLASS_SIZE)
        if counts is not None:
            padded = np.zeros(classes * CLASS_SIZE)
            padded[:words] = np.asarray(counts) + 0.1
            shares = padded.reshape(classes, CLASS_SIZE)
            masses = shares.sum(axis=1)
            self.p["class_bias"] = np.log(masses / masses.sum()).astype(np.float32)
            self.p["word_bias"] = np.log(np.maximum(shares / masses[:, None], 1e-9)).astype(np.float32)

    def dump(self) -> bytes:
        return pickle.dumps((self.words, self.p))

    @classmethod
    def load(cls, data: bytes) -> Model:
        words, p = pickle.loads(data)
        model = cls(words)
        model.p = p
        return model

    def _run(self, x: np.ndarray, carry: np.ndarray, h: np.ndarray):
        """States of a window as rows, the last one, and what going back needs.

        Within, and in the last two, lanes are the last axis: the gates are whole blocks of memory.
        """
        weights = self.p["state"].T.copy()
        steps, lanes = x.shape
        given = self.buffer("given", x.size, 3 * HIDDEN)
        self.p["input"].take(x.ravel(), axis=0, out=given, mode="clip")
        given = given.reshape(steps, lanes, 3 * HIDDEN)
        before, out, new = (self.buffer(k, steps, HIDDEN, lanes) for k in ("before", "out", "new"))
        gates = self.buffer("gates", steps, 3 * HIDDEN, lanes)
        begins = (carry == 0).any(axis=1).tolist()
        with np.errstate(over="ignore"):
            for t in range(steps):
                if begins[t]:
                    h = h * carry[t]
                before[t] = h
                a, g, n = given[t].T.copy(), gates[t], new[t]
                np.matmul(weights, before[t], out=g)
                zr = g[: 2 * HIDDEN]
                zr += a[: 2 * HIDDEN]
                sigmoid(zr)
                np.multiply(g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN :], out=n)
                n += a[2 * HIDDEN :]
                np.tanh(n, out=n)
                h = np.subtract(before[t], n, out=out[t])
                h *= g[:HIDDEN]
                h += n
        flat = self.buffer("states", steps, lanes, HIDDEN)
        flat[:] = out.transpose(0, 2, 1)
        return flat.reshape(-1, HIDDEN), h.copy(), (before, gates, new)

    def _score(self, h: np.ndarray, y: np.ndarray, grads: dict | None):
        """Natural log probabilities of tokens, and the gradient of the states if asked for."""
        p, n = self.p, len(y)
        classes, inner, every = y // CLASS_SIZE, y % CLASS_SIZE, np.arange(n)
        states = self.buffer("rows", n, HIDDEN + 1)
        states[:, :HIDDEN] = h
        states[:, HIDDEN] = 1  # takes the bias
        by_class = np.vstack((p["class"], p["class_bias"]))
        by_word = np.concatenate((p["word"], (p["word_bias"] + self.absent)[..., None]), axis=2)
        # no state is beyond 1, so neither is a logit beyond the sum of its weights
        bounded = max(_largest(p["class"].T, p["class_bias"]), _largest(p["word"], p["word_bias"])) < LARGEST

        logits = np.matmul(states, by_class, out=self.buffer("logits", n, self.classes))
        chosen = np.minimum(logits[every, classes], LARGEST)
        e, total = exponentials(logits, bounded)
        log_p = chosen - np.log(total)
        if grads is not None:
            e *= (1 / total)[:, None]
            e[every, classes] -= 1
            made = states.T @ e
            grads["class"] += made[:HIDDEN]
            grads["class_bias"] += made[HIDDEN]
            dh = np.matmul(e, p["class"].T, out=self.buffer("dh", n, HIDDEN))

        order = np.argsort(classes.astype(np.uint16), kind="stable")
        edges = np.searchsorted(classes[order], np.arange(self.classes + 1)).tolist()
        runs = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        sorted_rows = self.buffer("sorted_rows", n, HIDDEN + 1)
        states, inner = states.take(order, axis=0, out=sorted_rows, mode="clip"), inner[order]
        logits = self.buffer("logits", n, CLASS_SIZE)
        for k, a, b in runs:
            np.matmul(states[a:b], by_word[k].T, out=logits[a:b])
        chosen = np.minimum(logits[every, inner], LARGEST)
        e, total = exponentials(logits, bounded)
        log_p[order] += chosen - np.log(total)
        if grads is None:
            return log_p, None
        e *= (1 / total)[:, None]
        e[every, inner] -= 1
        back = self.buffer("back", n, HIDDEN)
        for k, a, b in runs:
            made = e[a:b].T @ states[a:b]
            grads["word"][k] += made[:, :HIDDEN]
            grads["word_bias"][k] += made[:, HIDDEN]
            np.matmul(e[a:b], p["word"][k], out=back[a:b])
        places = np.empty_like(order)
        places[order] = every
        dh += back.take(places, axis=0, out=self.buffer("unsorted", n, HIDDEN), mode="clip")
        return log_p, dh

    def log10(self, texts: list[np.ndarray], begin: int) -> list[float]:
        """The log10 probability of each whole text."""
        lanes = Lanes(texts, begin)
        scores = np.zeros((lanes.steps, len(lanes.held)), np.float32)
        h = np.zeros((HIDDEN, len(lanes.held)), np.float32)
        for a, b, active in lanes.windows(widest=1024):
            out, h, _ = self._run(lanes.input[a:b, :active], lanes.carry[a:b, :active], h[:, :active])
            y = lanes.target[a:b, :active]
            log_p, _ = self._score(out, y.ravel(), None)
            scores[a:b, :active] = log_p.reshape(y.shape)
        result = [0.0] * len(texts)
        for lane, ks in enumerate(lanes.held):
            if ks:
                starts = np.concatenate(([0], np.cumsum(lanes.sizes[lane])[:-1]))
                column = scores[: lanes.lengths[lane], lane].astype(np.float64)
                sums = np.add.reduceat(column, starts) / np.log(10)
                for k, s in zip(ks, sums.tolist()):
                    result[k] = s
        return result


class Trainer:
    def __init__(self, model: Model):
        self.model = model
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.updates = 0
        self.tokens = 0

    def learn(self, texts: list[np.ndarray], begin: int) -> None:
        """One pass over the texts; long ones are cut into segments, which fill the lanes evenly."""
        segments = [text[k : k + SEGMENT] for text in texts for k in range(0, len(text), SEGMENT)]
        lanes = Lanes(segments, begin)
        h = np.zeros((HIDDEN, len(lanes.held)), np.float32)
        for a, b, active in lanes.windows():
            h = self._window(lanes, a, b, active, h[:, :active])
        self.tokens += int(lanes.lengths.sum())

    def _window(self, lanes: Lanes, a: int, b: int, active: int, h: np.ndarray) -> np.ndarray:
        p = self.model.p
        x, y, carry = (v[a:b, :active] for v in (lanes.input, lanes.target, lanes.carry))
        out, last, (before, gates, new) = self.model._run(x, carry, h)
        real = (np.arange(a, b)[:, None] < lanes.lengths[None, :active]).ravel()
        rows = slice(None) if real.all() else real
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        buffer, size = self.model.buffer, 3 * HIDDEN
        dout = buffer("dout", *out.shape)
        dout.fill(0)
        _, dout[rows] = self.model._score(out[rows], y.ravel()[rows], grads)
        dout = dout.reshape(*x.shape, HIDDEN)
        da = buffer("da", size, *x.shape)
        d, dg = np.empty((size, active), np.float32), np.empty((size, active), np.float32)
        dz, dr, dn = (d[k : k + HIDDEN] for k in range(0, size, HIDDEN))
        dh = np.zeros_like(last)
        for t in range(b - a - 1, -1, -1):
            n, (z, r, inner) = new[t], gates[t].reshape(3, HIDDEN, active)
            dh += dout[t].T
            np.multiply(dh, (1 - z) * (1 - n * n), out=dn)
            np.multiply(dh, (before[t] - n) * z * (1 - z), out=dz)
            np.multiply(dn, inner * r * (1 - r), out=dr)
            da[:, t] = d
            dg[:] = d
            dg[2 * HIDDEN :] *= r
            grads["state"] += (dg @ before[t].T).T
            dh *= z
            dh += p["state"] @ dg
            dh *= carry[t]
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        present, first = np.unique(ids[order], return_index=True)
        da = da.reshape(size, -1).take(order, axis=1, out=buffer("sorted_da", size, ids.size), mode="clip")
        grads["input"][present] = np.add.reduceat(da, first, axis=1).T
        self._step(grads, max(1, int(real.sum())))
        return last

    def _step(self, grads: dict, tokens: int) -> None:
        self.updates += 1
        # a window with few lanes left says little, so it moves the weights little
        rate = RATE * min(1.0, tokens / FULL) * math.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
        for k, g in grads.items():
            g /= tokens
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            self.model.p[k] -= rate * m / (np.sqrt(v) + 1e-6)
