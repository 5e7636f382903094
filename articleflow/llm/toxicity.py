"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is read as words; a word's input is a vector of its own (by hash) beside the mean of vectors of its character
n-grams, so that unknown words with telling parts are understood. The network runs over windows of words that overlap
by half and cover the whole text; attention pools the states of a window into one logit, and a text is as toxic as its
most toxic window. A label belongs to a whole text, so training picks the windows to learn from: the most toxic ones
of toxic texts, and the most toxic and random ones of the others, first by word statistics and then by the network
itself. Scores are calibrated on the training sample.

The network is trained on a sample of labelled texts of bounded size; scoring takes place where the texts lie.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import gives_back, id_bucket, sent_to_tasks, text_slices
from articleflow.session import cut

# Texts of each label that training uses at most, chosen by a hash of their ids.
TRAIN_PER_LABEL = 1000
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS = 1 << 13, 1 << 15
GRAMS = (3, 4)
WIDTH, STATE, ATTENTION = 8, 8, 8
EPOCHS, BATCH, RATE = 8, 128, 0.01
# Words whose input a task remembers; it starts anew when it is full.
MEMORY_WORDS = 200_000
# New words whose inputs are made together.
STEP_WORDS = 4096
# Windows that run through the network together.
STEP_WINDOWS = 2048
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def window_starts(n: int) -> range:
    """Starts of the windows of a text of ``n`` words; the last window may be shorter."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def features(word: str) -> tuple[int, list[int]]:
    """Row of the word, rows of its character n-grams (with marks for its ends)."""
    raw = word.encode("utf-8", "surrogatepass")
    marked = b"^" + raw + b"$"
    grams = [zlib.crc32(marked[i:i + n]) % GRAM_ROWS for n in GRAMS for i in range(len(marked) - n + 1)]
    return zlib.crc32(raw) % WORD_ROWS, grams or [zlib.crc32(marked) % GRAM_ROWS]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Lexicon:
    """Words met so far: their rows, and their n-gram rows one after the other."""

    index: dict[str, int] = field(default_factory=dict)
    rows: array = field(default_factory=lambda: array("i"))
    grams: array = field(default_factory=lambda: array("i"))
    lengths: array = field(default_factory=lambda: array("i"))

    def ids(self, found: list[str]) -> np.ndarray:
        index = self.index
        for word in set(found):
            if word not in index:
                index[word] = len(index)
                row, grams = features(word)
                self.rows.append(row)
                self.grams.extend(grams)
                self.lengths.append(len(grams))
        return np.fromiter((index[w] for w in found), np.int64, len(found))


class Network:
    """Parameters by name; both directions are stacked on the first axis."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        self.p = {
            "word": draw(0.05, WORD_ROWS, WIDTH), "gram": draw(0.05, GRAM_ROWS, WIDTH),
            "input": draw(0.3, 2, 2 * WIDTH, 3 * STATE), "offset": np.zeros((2, 1, 3 * STATE), np.float32),
            "state": draw(0.3, 2, STATE, 3 * STATE), "attend": draw(0.3, 2 * STATE, ATTENTION),
            "query": draw(0.3, ATTENTION), "out": draw(0.3, 2 * STATE), "bias": np.zeros(1, np.float32),
        }
        self.calibration = (1.0, 0.0)
        self.empty = 0.0

    def word_inputs(self, rows: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Inputs of words: own vector, and the n-gram vectors (``flat``, ``lengths`` per word) pooled."""
        starts = np.cumsum(lengths) - lengths
        pooled = np.add.reduceat(self.p["gram"][flat], starts, axis=0) / np.sqrt(lengths)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][rows], pooled], axis=1)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What a word adds to the gates, per direction: (words, 2, 3 x STATE)."""
        return np.stack([inputs @ self.p["input"][d] + self.p["offset"][d] for d in (0, 1)], axis=1)

    def forward(self, gates: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows from (windows, WINDOW, 2, 3 x STATE) gate inputs; ``keep`` returns what training needs."""
        n = len(lengths)
        valid = np.arange(WINDOW)[None, :] < lengths[:, None]
        h = np.zeros((2, n, STATE), np.float32)
        states = np.zeros((WINDOW, 2, n, STATE), np.float32)
        trace = []
        for t in range(WINDOW):
            # The backward direction reads the same window from its end; padding leaves the state as it is.
            at = (t, WINDOW - 1 - t)
            x = np.stack([gates[:, at[0], 0], gates[:, at[1], 1]])
            live = np.stack([valid[:, at[0]], valid[:, at[1]]])[:, :, None]
            u = h @ self.p["state"]
            zr = 1 / (1 + np.exp(-(x[:, :, :2 * STATE] + u[:, :, :2 * STATE])))
            z, r = zr[:, :, :STATE], zr[:, :, STATE:]
            uc = u[:, :, 2 * STATE:]
            c = np.tanh(x[:, :, 2 * STATE:] + r * uc)
            new = np.where(live, h + z * (c - h), h)
            if keep:
                trace.append((h, z, r, uc, c, live))
            h = new
            states[at[0], 0], states[at[1], 1] = h[0], h[1]
        joined = np.concatenate([states[:, 0], states[:, 1]], axis=2).transpose(1, 0, 2)
        hidden = np.tanh(joined @ self.p["attend"])
        energy = np.where(valid, hidden @ self.p["query"], -1e9)
        energy -= energy.max(axis=1, keepdims=True)
        weight = np.exp(energy) * valid
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * joined).sum(axis=1)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, trace, joined, hidden, weight, pooled) if keep else logit

    def gradients(self, inputs: np.ndarray, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray,
                  importance: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weighted cross entropy, and those of the word inputs. ``ids`` index ``inputs``."""
        p, n = self.p, len(labels)
        logit, trace, joined, hidden, weight, pooled = self.forward(self.projected(inputs)[ids], lengths, keep=True)
        g = {}
        d_logit = ((_sigmoid(logit) - labels) * importance / n).astype(np.float32)
        g["out"], g["bias"] = d_logit @ pooled, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        d_joined = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = (joined * d_pooled[:, None, :]).sum(axis=2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["query"] = np.tensordot(d_energy, hidden, ([0, 1], [0, 1]))
        d_hidden = d_energy[:, :, None] * p["query"] * (1 - hidden * hidden)
        g["attend"] = np.tensordot(joined, d_hidden, ([0, 1], [0, 1]))
        d_joined = (d_joined + d_hidden @ p["attend"].T).transpose(1, 0, 2)
        g["state"] = np.zeros_like(p["state"])
        d_gates = np.zeros((n, WINDOW, 2, 3 * STATE), np.float32)
        d_h = np.zeros((2, n, STATE), np.float32)
        for t in reversed(range(WINDOW)):
            at = (t, WINDOW - 1 - t)
            h, z, r, uc, c, live = trace[t]
            d_h = d_h + np.stack([d_joined[at[0], :, :STATE], d_joined[at[1], :, STATE:]])
            d_new = np.where(live, d_h, 0)
            d_c = d_new * z * (1 - c * c)
            d_z = d_new * (c - h) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=2)
            g["state"] += h.transpose(0, 2, 1) @ d_u
            d_x = np.concatenate([d_z, d_r, d_c], axis=2)
            d_gates[:, at[0], 0], d_gates[:, at[1], 1] = d_x[0], d_x[1]
            d_h = np.where(live, d_h * (1 - z), d_h) + d_u @ p["state"].transpose(0, 2, 1)
        flat = d_gates.reshape(-1, 2, 3 * STATE)
        per_word = np.zeros((len(inputs), 2, 3 * STATE), np.float32)
        np.add.at(per_word, ids.ravel(), flat)
        g["input"] = np.stack([inputs.T @ per_word[:, d] for d in (0, 1)])
        g["offset"] = per_word.sum(axis=0)[:, None, :]
        return g, sum(per_word[:, d] @ p["input"][d].T for d in (0, 1))


def _sample_ids(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out: int, per_label: int) -> list:
    """Ids and labels of the training sample: bounded, chosen by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").filter(id_bucket("doc_id", folds) != held_out)
    rows = []
    for label in (0, 1):
        part = usable.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        rows += part.collect()
    return rows


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
          label_col: str = "toxic", folds: int = 5, held_out: int = 0, per_label: int = TRAIN_PER_LABEL) -> Network:
    """The network learned from at most ``per_label`` labelled texts of each label.

    Only rows whose crc32 of the id as text, modulo ``folds``, is not ``held_out`` are learned from. Labels other than
    0 and 1, null included, are left out; a text with several labels counts with each. The label's share among all
    usable labels sets the calibration. Without texts of both labels every text scores the share of label 1 (0.5
    without any label).
    """
    spark = docs.sparkSession
    rows = _sample_ids(labels, label_id, label_col, folds, held_out, per_label)
    shares = {r["label"]: r["count"] for r in labels.select(
        F.col(label_id).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        "doc_id is not null and label in (0, 1)").filter(id_bucket("doc_id", folds) != held_out).groupBy(
        "label").count().collect()}
    total = sum(shares.values())
    share = (shares.get(1, 0) + 0.5) / (total + 1)
    network = Network()
    network.empty = float(np.log(share / (1 - share)))
    network.calibration = (0.0, network.empty)
    if not rows:
        return network
    id_type = labels.schema[label_id].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame(rows, f"_id {id_type}, _label int"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(
        chosen, F.col("_doc") == F.col("_id")).select("_doc", "_label", "_text")
    found = sorted(texts.collect(), key=lambda r: (r["_doc"], r["_label"], r["_text"]))
    target = np.array([r["_label"] for r in found], dtype=np.float32)
    if not len(target) or target.min() == target.max():
        return network
    _learn(network, [r["_text"] for r in found], target, share)
    return network


def _windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded ids, lengths, text number) of all windows of texts; padding is -1."""
    parts, lengths, owner = [], [], []
    for nth, listed in enumerate(ids):
        for start in window_starts(len(listed)):
            part = listed[start:start + WINDOW]
            lengths.append(len(part))
            owner.append(nth)
            parts.append(np.pad(part, (0, WINDOW - len(part)), constant_values=-1))
    return np.array(parts).reshape(-1, WINDOW), np.array(lengths), np.array(owner)


def _learn(network: Network, texts: list[str], target: np.ndarray, share: float) -> None:
    rng = np.random.default_rng(17)
    lexicon = Lexicon()
    ids = [lexicon.ids(words(text)).astype(np.int32) for text in texts]
    rows, gram_flat = np.array(lexicon.rows, dtype=np.int64), np.array(lexicon.grams, dtype=np.int64)
    gram_sizes = np.array(lexicon.lengths, dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(gram_sizes)])
    padded, lengths, owner = _windows(ids)
    some = lengths > 0
    padded, lengths, owner = padded[some], lengths[some], owner[some]

    # Which words speak for a label, by the texts they occur in.
    texts_with = {kind: np.zeros((2, size)) for kind, size in (("word", WORD_ROWS), ("gram", GRAM_ROWS))}
    for listed, label in zip(ids, target.astype(int)):
        distinct = np.unique(listed)
        texts_with["word"][label][np.unique(rows[distinct])] += 1
        if len(distinct):
            every = np.concatenate([gram_flat[bounds[i]:bounds[i + 1]] for i in distinct])
            texts_with["gram"][label][np.unique(every)] += 1
    sizes = np.array([(target == 0).sum(), (target == 1).sum()])[:, None]
    odds = {}
    for kind, seen in texts_with.items():
        rate = (seen + 0.5) / (sizes + 1)
        odds[kind] = (np.log(rate[1]) - np.log(rate[0])) * seen.sum(axis=0) / (seen.sum(axis=0) + 5)
        network.p[kind][:, 0] += (0.3 * np.clip(odds[kind], -1, 5)).astype(np.float32)
    best_gram = np.maximum.reduceat(odds["gram"][gram_flat], bounds[:-1]) if len(gram_flat) else np.zeros(0)
    speaks = np.append(np.maximum(np.maximum(odds["word"][rows], best_gram) - 1, 0), 0.0)
    value = speaks[padded].sum(axis=1)

    def score() -> np.ndarray:
        inputs = network.word_inputs(rows, gram_flat, gram_sizes)
        gates = network.projected(np.concatenate([inputs, np.zeros((1, 2 * WIDTH), np.float32)]))
        return np.concatenate([network.forward(gates[padded[i:i + STEP_WINDOWS]], lengths[i:i + STEP_WINDOWS])
                               for i in range(0, len(padded), STEP_WINDOWS)])

    moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in network.p.items()}
    steps = 0
    label_of = target[owner]
    for epoch in range(EPOCHS):
        if epoch in (2, 4, 6):
            value = score()
        order = np.lexsort((-value, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = order[place < np.where(label_of[order] == 1, 1, 2)]
        harmless = np.flatnonzero(label_of == 0)
        extra = rng.choice(harmless, min(len(harmless), len(top)), replace=False)
        chosen = rng.permutation(np.unique(np.concatenate([top, extra])))
        weight = {1: len(chosen) / (2 * max(1, label_of[chosen].sum())),
                  0: len(chosen) / (2 * max(1, (1 - label_of[chosen]).sum()))}
        for at in range(0, len(chosen), BATCH):
            some = chosen[at:at + BATCH]
            used, place = np.unique(padded[some], return_inverse=True)
            pad = used[0] < 0
            known = used[1:] if pad else used
            if not len(known):
                continue
            sizes_ = gram_sizes[known]
            grams = np.concatenate([gram_flat[bounds[i]:bounds[i + 1]] for i in known])
            inputs = network.word_inputs(rows[known], grams, sizes_)
            if pad:
                inputs = np.concatenate([np.zeros((1, 2 * WIDTH), np.float32), inputs])
            g, d_inputs = network.gradients(inputs, place.reshape(len(some), WINDOW), lengths[some], label_of[some],
                                            np.where(label_of[some] == 1, weight[1], weight[0]))
            d_inputs = d_inputs[1:] if pad else d_inputs
            g["word"] = np.zeros_like(network.p["word"])
            np.add.at(g["word"], rows[known], d_inputs[:, :WIDTH])
            g["gram"] = np.zeros_like(network.p["gram"])
            np.add.at(g["gram"], grams,
                      np.repeat(d_inputs[:, WIDTH:] / np.sqrt(sizes_)[:, None], sizes_, axis=0))
            steps += 1
            for name, gradient in g.items():
                first, second = moments[name]
                first += 0.1 * (gradient - first)
                second += 0.001 * (gradient * gradient - second)
                network.p[name] -= (RATE * (first / (1 - 0.9 ** steps)) / (
                    np.sqrt(second / (1 - 0.999 ** steps)) + 1e-6)).astype(np.float32)
    # Calibration: logistic regression of the label on the text's largest logit, with the labels' true share.
    largest = np.full(len(target), -np.inf)
    np.maximum.at(largest, owner, score())
    usable = np.isfinite(largest)
    x, y = largest[usable].astype(np.float64), target[usable]
    importance = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    a, b = 1.0, 0.0
    for _ in range(300):
        p = _sigmoid(a * x + b)
        slope, curve = importance * (p - y), importance * np.maximum(p * (1 - p), 1e-4)
        gradient = np.array([(slope * x).sum() + 1e-3 * (a - 1), slope.sum()])
        matrix = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-6]])
        step = np.linalg.solve(matrix, gradient)
        a, b = a - 0.3 * step[0], b - 0.3 * step[1]
    network.calibration = (float(max(a, 0.05)), float(b))


class Scorer:
    """Scores texts inside a task; the inputs of words met before are remembered."""

    def __init__(self, network: Network, memory_words: int = MEMORY_WORDS) -> None:
        self.network, self.limit = network, memory_words
        self.index: dict[str, int] = {}
        # Row 0 is padding.
        self.gates = np.zeros((1, 2, 3 * STATE), np.float32)

    def _ids(self, found: list[str]) -> np.ndarray:
        new = [w for w in set(found) if w not in self.index]
        size = len(self.index) + 1
        if size + len(new) > len(self.gates):
            grown = np.zeros((max(len(self.gates) * 5 // 4, size + len(new)), 2, 3 * STATE), np.float32)
            grown[:size] = self.gates[:size]
            self.gates = grown
        for at in range(0, len(new), STEP_WORDS):
            part = new[at:at + STEP_WORDS]
            rows, grams = zip(*map(features, part))
            self.gates[size + at:size + at + len(part)] = self.network.projected(
                self.network.word_inputs(np.array(rows, dtype=np.int64), np.array([i for g in grams for i in g], dtype=np.int64),
                                         np.array([len(g) for g in grams], dtype=np.int64)))
        self.index.update(zip(new, range(size, size + len(new))))
        index = self.index
        return np.fromiter((index[w] for w in found), np.int64, len(found))

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 per text: the calibrated largest logit of all its windows."""
        if len(self.index) > self.limit:
            self.index, self.gates = {}, np.zeros((1, 2, 3 * STATE), np.float32)
        listed = [words(text) for text in texts]
        counts = np.array([len(found) for found in listed], dtype=np.int64)
        ids = self._ids([w for found in listed for w in found])
        base = np.cumsum(counts) - counts
        starts = [np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE) for n in counts.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        start = np.concatenate(starts)
        lengths = np.minimum(counts[owner] - start, WINDOW)
        begin = base[owner] + start
        largest = np.full(len(texts), -np.inf)
        # Windows of like length together would change nothing; order is kept.
        for at in range(0, len(begin), STEP_WINDOWS):
            part = slice(at, at + STEP_WINDOWS)
            cells = begin[part][:, None] + np.arange(WINDOW)
            inside = np.arange(WINDOW) < lengths[part][:, None]
            rows = np.where(inside, ids[np.minimum(cells, max(len(ids) - 1, 0))] if len(ids) else 0, 0)
            some = lengths[part] > 0
            if some.any():
                logit = self.network.forward(self.gates[rows[some]], lengths[part][some])
                np.maximum.at(largest, owner[part][some], logit)
        slope, shift = self.network.calibration
        logit = np.where(counts > 0, slope * np.where(np.isfinite(largest), largest, 0) + shift, self.network.empty)
        return _sigmoid(logit)


def score_texts(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
                held_out: int = 0) -> DataFrame:
    """One row per document: (doc_id, text_hash, held_out, score, predicted).

    A text without letters, null or empty, scores the share of label 1. Every row is scored by its text alone; other
    columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = sent_to_tasks(docs.sparkSession, network)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared())
        for batch in batches:
            scores = [scorer.score(part) for _, part in text_slices(batch.column(2), 1 << 19)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                ["doc_id", "text_hash", "score"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    scored = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, f"doc_id {id_type}, text_hash long, score double")
    return scored.select("doc_id", "text_hash", (id_bucket("doc_id", folds) == held_out).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic; columns stay. Bad rows are told by id and text."""
    from articleflow.llm.common import BROADCAST_BYTES

    bad = cut(score_texts(docs, network, id_col, text_col).filter("predicted = 1").select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct())
    if bad.count() * 16 <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (text_hash == bad["_bad_hash"]), "left_anti")
