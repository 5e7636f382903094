"""Line de-duplication with odd columns, the language model token by token, and the pipeline stage by stage."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from articleflow.llm import line_dedup, lm

PASSAGE = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(3))


@pytest.mark.parametrize("max_bytes", [1 << 25, 0])
def test_line_dedup_with_clashing_names(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", max_bytes)
    clash = "_first int, _last int, _cut_id int, _cut_hash int, _kept_text int, n_removed_lines int, run int, fingerprint int"
    texts = ["a\n" + PASSAGE, PASSAGE + "\nb", "c d\n" + PASSAGE.replace(" ", " "), None, ""]
    rows = [(i, t, *[i] * 8) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {clash}")
    out = line_dedup.dedup_lines(frame)
    assert out.columns[:-1] == frame.columns
    got = {r["doc_id"]: (r["text"], r[-1], r["_first"]) for r in out.collect()}
    assert got == {0: (texts[0], 0, 0), 1: ("b", 3, 1), 2: ("c d", 3, 2), 3: (None, 0, 3), 4: ("", 0, 4)}


# ------------------------------------------------------------------------------------------------ language model

LM_ROWS = [(i, t) for i, t in enumerate(
    ["The cat sat on the mat", "the dog sat", "A cat and a dog", "", None, "rare words only here", "the the the", "cat\tdog\x0bmat",
     "Été naïve word", "THE CAT SAT ON THE MAT"] * 3)] + [(7, "the dog sat"), (7, "the dog sat"), (None, "cat"), (None, "new unseen")]


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w] + [""]


def test_lm_equals_brute_force(spark, monkeypatch):
    """Every column but the trained part; and the trained score as the sum of its tokens' log probabilities."""
    trained = {}
    train = lm._trained

    def keep(texts, vocabulary):
        trained["model"], trained["vocabulary"] = train(texts, vocabulary), vocabulary
        return trained["model"]

    monkeypatch.setattr(lm, "_trained", keep)
    monkeypatch.setattr(lm, "HEAD_WORDS", 6)
    frame = spark.createDataFrame([(i, t, 1) for i, t in LM_ROWS], "doc_id long, text string, n long")
    got = lm.score_texts(frame.repartition(3)).collect()

    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in LM_ROWS}
    count = collections.Counter(t for i, text in LM_ROWS if not fold[i] for t in tokens(text))
    total, types = sum(count.values()), len(count)
    want = collections.Counter()
    for i, text in LM_ROWS:
        found = tokens(text)
        base = sum(math.log10((count[t] + 1) / (total + types + 1)) for t in found)
        want[(i, fold[i], len(found), sum(count[t] > 0 for t in found), total, round(base, 8))] += 1
    assert collections.Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in got) == want

    # The model's own probability of each token: its class after its context, and its share of the class.
    model, vocabulary = trained["model"], trained["vocabulary"].prepare()
    listed = list(vocabulary.index)
    singles = set(listed[:lm.SINGLE])
    in_class = collections.defaultdict(lambda: [0, 0])
    for word, n in count.items():
        if word.encode() not in singles:
            in_class[lm.ending(word.encode())][0] += n
            in_class[lm.ending(word.encode())][1] += 1
    scores = collections.defaultdict(list)
    for i, text in LM_ROWS:
        found = [t.encode() for t in tokens(text)]
        _, cls, code = vocabulary.codes(found)
        value = 0.0
        for at, word in enumerate(found):
            context = [code[at - d] if at - d >= 0 else lm.START_CODE for d in range(1, lm.ORDER + 1)]
            hidden = (model.context[context] * model.distance).sum(axis=0)
            logits = (model.output @ hidden + model.bias).astype(float)
            value += (logits[cls[at]] - np.log(np.exp(logits).sum())) / math.log(10)
            if word not in singles:
                n, kinds = in_class[lm.ending(word)]
                value += math.log10((count[word.decode()] + 1) / (n + kinds + 1))
        scores[(i, text)].append(value)
    have = collections.defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(r["score"])
    expect = collections.defaultdict(list)
    for (i, _), values in scores.items():
        expect[i] += values
    for i in expect:
        assert np.allclose(sorted(have[i]), sorted(expect[i]), atol=1e-3)


# ------------------------------------------------------------------------------------------------------ pipeline

def say(rng, n, lead="w"):
    return " ".join(f"{lead}{k}" for k in rng.integers(0, 4000, n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean texts, and cases for every stage: toxic words, a repeated passage, copies, benchmark text."""
    rng = np.random.default_rng(9)
    rows, labels, kind = [], [], {}

    def add(text, what):
        rows.append((len(rows), text, "en", "s", None if text is None else len(text)))
        kind[len(rows) - 1] = what

    for i in range(240):
        toxic = i % 3 == 0
        add(say(rng, 60) + (" vilething" + "abcde"[i % 5] + " " + say(rng, 5) if toxic else ""), "toxic" if toxic else "clean")
        labels.append((i, 0, int(toxic)))
    passage = "\n".join(say(rng, 20, "p") for _ in range(3))
    add(say(rng, 70) + "\n" + passage, "first passage")
    for _ in range(3):
        add("\n\t\n" + passage, "only passage")
        add(say(rng, 70) + "\n" + passage + "\n" + say(rng, 9), "passage")
    base = say(rng, 120, "c")
    add(base, "original")
    # Its one line is a run of its own, so the copy goes as a repeated line too.
    add(base.upper(), "copied line")
    add(base + " one more", "copy")
    items = [(i, say(rng, 30, "b")) for i in range(4)]
    add(items[0][1] + " " + say(rng, 100), "contaminated")
    add(items[1][1], "contaminated")
    add(items[2][1][:40] + " " + say(rng, 400), "clean")
    add(None, "empty")
    add("", "empty")
    root = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows, kind, passage


def test_pipeline_stages_on_planted_cases(spark, planted):
    root, rows, kind, passage = planted
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns

    def ids(frame):
        return sorted(r["doc_id"] for r in frame.select("doc_id").collect())

    def of(*kinds):
        return {i for i, what in kind.items() if what in kinds}

    # Toxicity: the toxic go, the rest stay.
    kept = stages["toxicity"](spark, docs, root)
    assert kept.columns == columns
    left = set(ids(kept))
    assert len(of("toxic") - left) >= 0.9 * len(of("toxic")) and len(of("clean") & left) >= 0.95 * len(of("clean"))

    # Line dedup, on its own input: brute force over all runs of lines.
    out = stages["line dedup"](spark, docs, root)
    assert out.columns == columns
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert set(texts) == {i for i, *_ in rows} - of("only passage", "copied line")
    for i, text, *_ in rows:
        if kind[i] == "passage":
            short = text.replace(passage + "\n", "")
            assert texts[i] == (short, len(short))
        elif i in texts:
            assert texts[i] == (text, None if text is None else len(text))

    # Near-duplicates: one of each group; brute force over five-word shingles.
    def shingles(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t, *_ in rows}
    firsts = [i for i in sets if not any(
        j < i and sets[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)]
    assert ids(stages["near-duplicates"](spark, docs, root)) == firsts
    assert not of("copy", "copied line") & set(firsts) and of("original", "clean") <= set(firsts)

    # Decontamination: brute force is the contract's rule on these few items, 13 words at a time.
    assert ids(stages["decontamination"](spark, docs, root)) == sorted(set(kind) - of("contaminated"))

    # Packing: every token of every document once, and the whole run goes through.
    pieces = stages["packing"](spark, docs, root)
    per_doc = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert len(per_doc) == len(rows) and all(r["n"] == r["whole"] for r in per_doc)
    through = set(ids(corpus_pipeline.run(spark, root).select("doc_id").distinct()))
    assert not through & of("copy", "copied line", "contaminated", "only passage") and len(of("toxic") & through) <= 0.1 * len(of("toxic"))
    assert len(of("clean", "first passage", "original", "passage", "empty") & through) >= 0.95 * len(
        of("clean", "first passage", "original", "passage", "empty"))


def test_lm_numbers_in_steps(monkeypatch):
    """Class probabilities and a training step, computed in reused space, against plain formulas."""
    rng = np.random.default_rng(1)
    share = rng.random(lm.CLASSES)
    share /= share.sum()
    model = lm.Model.start(share)
    contexts, classes = rng.integers(0, lm.START_CODE + 1, (700, lm.ORDER)), rng.integers(0, lm.CLASSES, 700)
    assert lm.endings([b"", b"a", b"abc"]).tolist() == [lm.ending(w) for w in (b"", b"a", b"abc")]
    for factor in (1, 400):
        big = lm.Model(model.context, model.distance, model.output * factor, model.bias)
        monkeypatch.setattr(lm, "SCORED", 256)
        got = big.log_probability(contexts, classes)
        hidden = (big.context[contexts].astype(np.float64) * big.distance).sum(axis=1)
        scores = hidden @ big.output.T.astype(np.float64) + big.bias
        scores -= scores.max(axis=1, keepdims=True)
        plain = scores[np.arange(700), classes] - np.log(np.exp(scores).sum(axis=1))
        assert np.allclose(got, plain / np.log(10), rtol=1e-4, atol=1e-3 * factor)
    # A short step after a long one must not see what the long one left behind.
    used, fresh = (lm.Trainer(lm.Model.start(share), share) for _ in range(2))
    used.step(contexts, classes)
    fresh.model, fresh.squares = lm.Model.start(share).filled(used.model.flat()), [s.copy() for s in used.squares]
    fresh.rng.bit_generator.state = used.rng.bit_generator.state
    used.step(contexts[:50], classes[:50])
    fresh.step(contexts[:50], classes[:50])
    assert np.array_equal(used.model.flat(), fresh.model.flat())


def test_pipeline_sends_texts_in_small_batches(spark, monkeypatch):
    """The stages' tasks meet batches of bounded size, and the session keeps its own bound."""
    from articleflow.llm import packing, toxicity

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    seen = spark.sparkContext.accumulator(0)
    bound = 3 << 20

    def watched(task, keeps=("sent",)):
        def run(batches):
            def passed():
                for batch in batches:
                    seen.add(int(batch.nbytes > bound))
                    yield batch
            return task(passed())
        return run

    text = " ".join(f"w{i % 7}" for i in range(9_000))
    docs = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(packing, "gives_back", watched)
    monkeypatch.setattr(toxicity, "gives_back", watched)
    monkeypatch.setattr(toxicity, "train", lambda *a: toxicity.Network())
    pieces = corpus_pipeline.pack(spark, docs, "/root/testdata/sf0.001")
    assert pieces.select("doc_id").distinct().count() == 200
    corpus_pipeline.reject_toxic(spark, docs, "/root/testdata/sf0.001").count()
    assert seen.value == 0
    assert spark.conf.get(name) == before
