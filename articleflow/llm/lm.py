"""Language-model scores of texts: a log-bilinear model over word classes, trained with noise-contrastive estimation.

Words are counted over all training documents. The most frequent words are classes of their own, all others share
classes by their last two bytes. The model predicts the class of a token from the words before it, by the inner
product of a class vector with a weighted sum of context vectors; within a class, words follow their add-one counts:

    P(word | context) = P(class | context) x (count + 1) / (class count + class words + 1), or P(class | context)
    for a class of one word.

Both factors sum to one, over the classes and over the words of a class including unseen ones, so token
probabilities are normalised.

Training reads all training documents: every task runs stochastic gradient steps from the same start over the tokens
it holds, and the parameters, whose number is fixed, are averaged by tokens in a tree of small groups. Then one pass
scores all texts by batched matrix products; words outside the list that tasks hold are joined with their counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import id_bucket, sent_to_tasks, text_slices
from articleflow.session import cut

# Classes of one word, and classes by word ending.
SINGLE, ENDINGS = 128, 128
# Words with a context vector of their own; the others share one per ending.
CONTEXT_WORDS = 4096
# Most frequent words whose counts every task holds; the counts of all others are joined.
HEAD_WORDS = 200_000
DIMENSIONS, ORDER = 16, 3
NOISE, BATCH, RATE = 32, 4096, 0.1
# Tokens whose class scores are computed at once.
SCORED = 512
# Distinct words that a task counts before it hands them on; parameter sets that are averaged at once.
COUNTED_WORDS, AVERAGED = 500_000, 64
END = b""


def words(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of bytes other than ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def endings(found: Collection[bytes]) -> np.ndarray:
    """``ending`` of many words."""
    return np.fromiter(map(zlib.crc32, [word[-2:] for word in found]), np.int64, len(found)) % ENDINGS


def _ending_column(word: str) -> Column:
    """``ending`` as a column expression; the end token has an empty ending."""
    return F.crc32(F.when(F.length(word) <= 2, F.col(word)).otherwise(F.substring(F.col(word), -2, 2))) % ENDINGS


@dataclass
class Vocabulary:
    """Frequent words, most frequent first: their class, context and log counts; and what classes weigh."""

    index: dict[bytes, int]
    log_count: np.ndarray
    class_share: np.ndarray
    class_norm: np.ndarray
    total: int
    types: int

    def codes(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the list or -1, class, context code) of tokens."""
        place = np.fromiter(map(self.index.get, found, repeat(-1)), np.int64, len(found))
        group = place >= SINGLE
        foreign = np.flatnonzero(place < 0)
        cls, context = place.copy(), place.copy()
        ends = self._ends[place]
        cls[group] = SINGLE + ends[group]
        far = place >= CONTEXT_WORDS
        context[far] = CONTEXT_WORDS + ends[far]
        other = endings([found[i] for i in foreign.tolist()])
        cls[foreign] = SINGLE + other
        context[foreign] = CONTEXT_WORDS + other
        return place, cls, context

    def prepare(self) -> Vocabulary:
        self._ends = endings(self.index) if self.index else np.zeros(1, np.int64)
        return self


START_CODE = CONTEXT_WORDS + ENDINGS
CLASSES = SINGLE + ENDINGS


@dataclass
class Model:
    """Context vectors, weights per distance, class vectors and class biases."""

    context: np.ndarray
    distance: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(class_share: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (0.2 * rng.standard_normal(shape)).astype(np.float32)
        return Model(draw(START_CODE + 1, DIMENSIONS), np.ones((ORDER, DIMENSIONS), np.float32),
                     draw(CLASSES, DIMENSIONS), np.log(class_share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.context.ravel(), self.distance.ravel(), self.output.ravel(), self.bias])

    def filled(self, values: np.ndarray) -> Model:
        parts, at = [], 0
        for part in (self.context, self.distance, self.output, self.bias):
            parts.append(values[at:at + part.size].reshape(part.shape).astype(np.float32))
            at += part.size
        return Model(*parts)

    def log_probability(self, contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of classes after contexts, in steps whose numbers stay in the processor cache."""
        out = np.empty(len(classes), dtype=np.float64)
        # The bias is the weight of a last input that is always 1.
        weights, one = np.concatenate([self.output.T, self.bias[None, :]]), np.ones(CLASSES, np.float32)
        every, inputs = np.empty((SCORED, CLASSES), np.float32), np.ones((SCORED, DIMENSIONS + 1), np.float32)
        for at in range(0, len(classes), SCORED):
            own_class = classes[at:at + SCORED]
            n = len(own_class)
            hidden, scores = inputs[:n], every[:n]
            hidden[:, :DIMENSIONS] = _weighted(
                [self.context.take(contexts[at:at + SCORED, k], axis=0) for k in range(ORDER)], self.distance)
            np.matmul(hidden, weights, out=scores)
            own = scores[np.arange(n), own_class]
            total = np.exp(scores, out=scores) @ one
            if not (np.isfinite(total).all() and total.min() > 1e-30):
                # Scores far from zero: shift them.
                np.matmul(hidden, weights, out=scores)
                shift = scores.max(axis=1)
                own, total = own - shift, np.exp(scores - shift[:, None]).sum(axis=1)
            out[at:at + n] = (own - np.log(total)) / np.log(10)
        return out


def _weighted(vectors: list[np.ndarray], distance: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The sum of context vectors, each weighted by its distance."""
    out = np.multiply(vectors[0], distance[0], out=out)
    for k in range(1, ORDER):
        out += vectors[k] * distance[k]
    return out


def _grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that brings equal row numbers together, where each begins, the distinct ones)."""
    # Row numbers fit into 16 bits, which are sorted by radix.
    rows = rows.astype(np.int16)
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return order, firsts, rows.take(firsts)


def _add_rows(target: np.ndarray, squares: np.ndarray, groups: tuple, gradient: np.ndarray) -> None:
    """One adaptive gradient step on the given rows (``_grouped``), repeated rows summed."""
    order, firsts, rows = groups
    summed = np.add.reduceat(gradient.take(order, axis=0), firsts, axis=0)
    grown = squares.take(rows, axis=0) + summed * summed
    squares[rows] = grown
    target[rows] += RATE * summed / np.sqrt(grown)


class Trainer:
    """Noise-contrastive steps: tell a token's class from noise classes drawn by their frequency."""

    def __init__(self, model: Model, class_share: np.ndarray, seed: int = 5) -> None:
        self.model = model
        self.rng = np.random.default_rng(seed)
        self.edges = np.cumsum(class_share)
        self.log_noise = np.log(NOISE * class_share).astype(np.float32)
        self.squares = [np.full(part.shape, 1e-2, np.float32) for part in (
            model.context, model.distance, model.output, model.bias)]
        self.tokens = 0
        self.space = np.empty((ORDER + 3, BATCH, DIMENSIONS), np.float32)
        self.pulled = np.empty((BATCH, NOISE), np.float32)
        self.gradient = np.empty((BATCH + NOISE, DIMENSIONS), np.float32)

    def step(self, contexts: np.ndarray, classes: np.ndarray) -> None:
        model, n = self.model, len(classes)
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE) * self.edges[-1]), CLASSES - 1)
        # Numbers of a step are written where those of the last one were.
        *vectors, hidden, targets, product = self.space[:, :n]
        for k in range(ORDER):
            model.context.take(contexts[:, k], axis=0, out=vectors[k], mode="clip")
        model.output.take(classes, axis=0, out=targets, mode="clip")
        drawn, pull, gradient = model.output[noise], self.pulled[:n], self.gradient[:n + NOISE]
        _weighted(vectors, model.distance, hidden)
        own = np.multiply(hidden, targets, out=product).sum(axis=1) + model.bias[classes] - self.log_noise[classes]
        np.matmul(hidden, drawn.T, out=pull)
        pull += model.bias[noise]
        pull -= self.log_noise[noise]
        # Gradients of the log likelihood of "real" and "noise", per token.
        push = (1 / (1 + np.exp(np.clip(own, -30, 30)))) / n
        np.clip(np.negative(pull, out=pull), -30, 30, out=pull)
        np.exp(pull, out=pull)
        pull += 1
        np.divide(-1, pull, out=pull)
        pull /= n
        scale = np.float32(n) / 64
        np.multiply(push[:, None], hidden, out=gradient[:n])
        gradient[n:] = pull.T @ hidden
        gradient *= scale
        to_hidden = np.multiply(push[:, None], targets, out=targets)
        to_hidden += np.matmul(pull, drawn, out=product)
        groups = _grouped(np.concatenate([classes, noise]))
        _add_rows(model.output, self.squares[2], groups, gradient)
        _add_rows(model.bias, self.squares[3], groups, scale * np.concatenate([push, pull.sum(axis=0)]))
        step = np.stack([np.multiply(v, to_hidden, out=product).sum(axis=0) for v in vectors]) * scale
        to_hidden *= scale
        for k in range(ORDER):
            _add_rows(model.context, self.squares[0], _grouped(contexts[:, k]),
                      np.multiply(to_hidden, model.distance[k], out=product))
        self.squares[1] += step * step
        model.distance += 0.1 * RATE * step / np.sqrt(self.squares[1])
        self.tokens += n


def _stream(texts: list[str], vocabulary: Vocabulary):
    """(words with ends, list places, classes, contexts, token counts) of several texts together."""
    listed = [words(text) + [END] for text in texts]
    counts = np.array([len(found) for found in listed], dtype=np.int64)
    flat = list(chain.from_iterable(listed))
    place, cls, code = vocabulary.codes(flat)
    starts = np.cumsum(counts) - counts
    contexts = np.full((len(flat), ORDER), START_CODE, dtype=np.int64)
    for k in range(1, ORDER + 1):
        contexts[k:, k - 1] = code[:-k]
        for place_in_text in range(k):
            contexts[starts[counts > place_in_text] + place_in_text, k - 1] = START_CODE
    return flat, place, cls, contexts, counts


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``: words and one end token (the empty word) per text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                               ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                for text in part:
                    seen.update(words(text))
                seen[END] += len(part)
                if len(seen) > COUNTED_WORDS:
                    yield flush()
        if seen:
            yield flush()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent words and class totals of a written count table; their number is fixed."""
    frequent = counts.orderBy(F.col("n").desc(), F.col("word").asc()).limit(HEAD_WORDS).toArrow()
    listed, n = frequent["word"].to_pylist(), frequent["n"].to_numpy()
    index = {word: i for i, word in enumerate(listed)}
    by_end = counts.groupBy(_ending_column("word").cast("int").alias("e")).agg(
        F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    total, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in by_end:
        total[row["e"]], types[row["e"]] = row["n"], row["types"]
    sum_n, sum_types = int(total.sum()), int(types.sum())
    for word, c in zip(listed[:SINGLE], n[:SINGLE]):
        total[ending(word)] -= c
        types[ending(word)] -= 1
    single = np.zeros(SINGLE)
    single[:len(n[:SINGLE])] = n[:SINGLE]
    share = np.concatenate([single, total]) + 0.5
    norm = np.concatenate([np.ones(SINGLE), total + types + 1])
    return Vocabulary(index, np.log10(n + 1.0), share / share.sum(), np.log10(norm), sum_n, sum_types)


def _trained(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    spark = texts.sparkSession
    shared = sent_to_tasks(spark, vocabulary)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared().prepare()
        trainer = Trainer(Model.start(known.class_share), known.class_share)
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                _, _, cls, contexts, _ = _stream(part, known)
                order = trainer.rng.permutation(len(cls))
                for at in range(0, len(cls), BATCH):
                    chosen = order[at:at + BATCH]
                    trainer.step(contexts[chosen], cls[chosen])
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(trainer.tokens)]), pa.array([trainer.model.flat().astype("<f4").tobytes()], pa.binary())],
                ["weight", "parameters"])

    def average(group: pa.Table) -> pa.Table:
        weight = group["weight"].to_numpy()
        rows = np.stack([np.frombuffer(v.as_py(), dtype="<f4") for v in group["parameters"]])
        mean = (rows * (weight / weight.sum())[:, None]).sum(axis=0)
        return pa.table({"weight": [float(weight.sum())], "parameters": pa.array([mean.astype("<f4").tobytes()], pa.binary())})

    kind = "weight double, parameters binary"
    found = cut(texts.select("text").mapInArrow(train, kind))
    n = found.count()
    while n > 1:
        groups = -(-n // AVERAGED)
        dealt = found.withColumn("g", F.pmod(F.xxhash64("parameters"), F.lit(groups)))
        found = cut(dealt.groupBy("g").applyInArrow(lambda t: average(t.drop_columns(["g"])), kind))
        n = found.count()
    start = Model.start(vocabulary.class_share)
    last = found.first()
    return start if last is None else start.filled(np.frombuffer(last["parameters"], dtype="<f4"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
                held_out: int = 2) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores in log10.

    Training documents are those whose crc32 of the id as text, modulo ``folds``, is not ``held_out`` (a null id is
    empty text). ``base_score`` is the add-one unigram model over all training tokens, ``score`` the trained model's
    log10 probability of the text with its end. Null or empty text is the end token alone. Repeated rows count as
    often as they occur and get equal results; other columns are ignored. Without training documents the model is
    uniform over classes and the base score 0.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    training = named.filter(id_bucket("doc_id", folds) != held_out).select("text")
    counts = cut(count_words(training))
    vocabulary = _vocabulary(counts)
    shared = sent_to_tasks(spark, (vocabulary, _trained(training, vocabulary)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared()
        known.prepare()
        for batch in batches:
            for start, part in text_slices(batch.column(2)):
                flat, place, cls, contexts, n = _stream(part, known)
                owner = np.repeat(np.arange(len(part)), n)
                listed = place >= 0
                count = np.where(listed, known.log_count[place] if len(known.log_count) else 0.0, 0.0)
                # Parts that need no further counts: class probability, class norms, and counts of listed words.
                single = cls < SINGLE
                rest = model.log_probability(contexts, cls) - known.class_norm[cls] + np.where(single, 0.0, count)
                foreign = np.flatnonzero(~listed)
                rare: Counter = Counter(zip(owner[foreign].tolist(), [flat[i] for i in foreign.tolist()]))
                rows = pa.array(np.concatenate([np.arange(len(part)), [r for r, _ in rare]]).astype(np.int64) + start)
                extra = len(rare)
                whole = lambda values, kind: pa.array([*values, *[None] * extra], kind)
                sums = lambda values: np.bincount(owner, weights=values, minlength=len(part))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array([*[None] * len(part), *[w for _, w in rare]], pa.binary()),
                    pa.array([*[None] * len(part), *rare.values()], pa.int64()),
                    whole(n.tolist(), pa.int64()), whole(sums(listed).astype(int).tolist(), pa.int64()),
                    whole(sums(count).tolist(), pa.float64()), whole(sums(rest).tolist(), pa.float64()),
                ], ["doc_id", "text_hash", "word", "times", "n_tokens", "n_known", "log_counts", "rest"])

    scored = cut(named.mapInArrow(
        score, f"doc_id {id_type}, text_hash long, word binary, times long, n_tokens long, n_known long, "
               "log_counts double, rest double"))
    sums = ["n_tokens", "n_known", "log_counts", "rest"]
    main = scored.filter("word is null").select("doc_id", "text_hash", *sums, F.lit(1).alias("rows"))
    more = F.log10(F.col("n") + 1.0) * F.col("times")
    rare = scored.filter("word is not null").join(counts, "word").select(
        "doc_id", "text_hash", F.lit(0).cast("long").alias("n_tokens"), F.col("times").alias("n_known"),
        more.alias("log_counts"), more.alias("rest"), F.lit(0).alias("rows"))
    # Equal rows have equal sums: their total is divided by their number.
    per_doc = main.unionByName(rare).groupBy("doc_id", "text_hash").agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("rows").alias("rows"))
    share = [(F.col(c) / F.col("rows")).alias(c) for c in ("log_counts", "rest")]
    exact = [F.expr(f"{c} div rows").alias(c) for c in ("n_tokens", "n_known")]
    base = float(np.log10(vocabulary.total + vocabulary.types + 1))
    return per_doc.select(
        "doc_id", *exact, *share, F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))
    ).select(
        "doc_id", (id_bucket("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(base)).alias("base_score"), F.col("rest").alias("score"),
    )
