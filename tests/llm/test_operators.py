"""Every operator of the subpackage on small fixtures: odd rows, ties, clashing columns, empty tables, brute force."""

import hashlib
import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.llm import ann, chat, decontam, licenses, line_dedup, lm, near_dup, packing, token_index, toxicity
from articleflow.llm.components import components
from articleflow.llm.encoder import Encoder, vocabulary_path, worker_encoder
from articleflow.session import scratch

LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [
    (1, "One two three four five six."), (2, None), (3, ""), (4, "  odd\t white \n\n space  "), (5, LONG),
    (6, LONG), (7, "<|endoftext|> it's 12,5 été"), (7, "<|endoftext|> it's 12,5 été"), (None, "no id here"), (8, "x"),
]
SCHEMA = "doc_id long, text string, words string, score double, cls long, place long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", 0.5, 1, 2) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, end):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_path())
    plain.encode_special_tokens = True
    return plain.encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_equals_plain_encoding():
    texts = [t or "" for _, t in ROWS] + ["a b", " a", "a ", "a  b", "a\nb c\n", "\n", " x  y"]
    got = Encoder(vocabulary_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(t, 0)[:-1] for t in texts]


def test_encoder_cuts_punctuation_off_words():
    texts = ["a,b.c d,.e f's g're, h_i, 's. é, ü! 日本, x²,y a1,b", ", a", "A,\nB. C", "a, \x1f,", "it's 1,2\x1f,"]
    encoder = Encoder(vocabulary_path())
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [ids_of(t, 0)[:-1] for t in texts]
    known = len(encoder._inner)
    encoder.encode(["x word, word. word! word"])
    assert len(encoder._inner) <= known + 3  # the word, and marks not met before
    assert encoder.encode([]) == []


def test_full_encoder_keeps_words_that_come_often():
    encoder = Encoder(vocabulary_path(), 40)
    texts = [" ".join(f"often rare{chr(97 + i)}" for i in range(26)), " ".join(f"often odd{chr(97 + i)}" for i in range(26))]
    assert [np.frombuffer(g, "<u4").tolist() for t in texts for g in encoder.encode([t])] == [ids_of(t, 0)[:-1] for t in texts]
    assert "often" in encoder._inner and len(encoder._inner) < 40


def test_token_index(spark, docs, none):
    store = token_index.write_store(docs, scratch(spark, "tokens"))
    places = token_index.locate(store, docs).unionByName(token_index.keyless(store))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_index.digest(store, places).collect())
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(ids_of(t, 2), "<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_index.get(store, 1)[0].tolist() == ids_of(ROWS[0][1], 2)
    assert len(token_index.get(store, 7)) == 2 and token_index.get(store, 99) == []
    assert token_index.locate(store, spark.createDataFrame([(99,)], "doc_id long")).count() == 0
    empty = token_index.write_store(none, scratch(spark, "tokens"))
    assert token_index.locate(empty, docs).count() == 0


def test_perfect_hash():
    keys = np.arange(5000, dtype=np.int64) * 7919 - 10000
    copy = np.zeros(5000, np.int64)
    table = token_index.PerfectHash.build(keys, copy)
    assert sorted(table.slots(keys, copy).tolist()) == list(range(5000))


def test_packing(docs, none):
    rows = packing.packed(docs).collect()
    for text in {t for _, t in ROWS}:
        whole = ids_of(text, 0)
        found = [r for r in rows if dict(ROWS).get(r["doc_id"]) == text and r["doc_id"] not in (7,)]
        for doc in {r["doc_id"] for r in found}:
            pieces = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found if r["doc_id"] == doc)
            assert sum((p for _, p in pieces), []) == whole
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.packed(none).count() == 0


def test_pack_pool_fills_all_windows_but_one():
    rng = np.random.default_rng(1)
    stock = [(int(n), i, 0) for i, n in enumerate(rng.integers(1, 3000, 400))]
    full, rest = packing.pack_pool(stock)
    assert all(sum(p[0] for p in window) == tier for tier, window in full)
    assert sum(p[0] for _, w in full for p in w) + sum(p[0] for p in rest) == sum(s[0] for s in stock)


def test_line_dedup(spark, docs, none):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(3))
    rows = [(1, f"first\n{passage}\nend"), (2, f"Other\n{passage.upper()}\ntail"), (3, "short line\nshort line"),
            (4, passage.replace("p00", "q00")), (5, None), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("n", "n")
    got = sorted((r["doc_id"], r["text"] or "", r["n_removed_lines"]) for r in line_dedup.dedup_lines(frame).collect())
    assert got == sorted([(1, rows[0][1], 0), (2, "Other\ntail", 3), (3, rows[2][1], 0), (4, rows[3][1], 0),
                          (5, "", 0), (5, "", 0)])
    assert line_dedup.dedup_lines(none).count() == 0
    kept = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[5] == 0 and kept[6] == 1


def test_near_dups(spark, docs, none):
    base = [f"t{i}" for i in range(100)]
    edit = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    rows = [(10, edit()), (11, edit(3)), (12, edit(3, 50)), (13, edit(1, 2, 9, 30, 40, 60, 70, 80)), (14, edit()),
            (15, "a"), (16, "A"), (17, None), (17, None), (None, edit())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
           for r in near_dup.near_dup_components(frame, size=2).collect()}
    sets = {i: {tuple((t or "").lower().split()[k:k + 2]) for k in range(max(len((t or "").split()) - 1, bool(t)))}
            for i, t in rows if i}
    links = [(a, b) for a in sets for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    want = {(i, len(s), comp[i], comp[i] == i) for i, s in sets.items()} | {(None, len(sets[10]), None, True)}
    assert got == want
    assert near_dup.near_dup_components(none).count() == 0
    assert sorted(r["doc_id"] or 0 for r in near_dup.drop_near_dups(docs, size=2).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 4), (5, 5), (20, 30), (4, 30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 30: 1, 7: 7, 8: 7, 9: 7}


def test_decontamination(spark, docs, none):
    item = " ".join(f"k{i}" for i in range(20))
    items = spark.createDataFrame([("b", item), ("a", "Rare Pair"), ("n", None), (None, "zz")], "item_id string, text string")
    rows = [(1, f"Intro {item.upper()} end"), (2, "a rare, PAIR of x"), (3, " ".join(item.split()[:12])), (4, None), (4, None),
            (5, "zz top"), (None, item)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1 << 20, 0):
        hits = decontam.benchmark_hits(frame, items, max_bytes=limit).collect()
        got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], ",".join(r["items"])) for r in hits))
        assert got == [(0, 20, 20, "b"), (1, 22, 20, "b"), (2, 5, 2, "a"), (3, 12, 0, ""), (4, 0, 0, ""), (4, 0, 0, ""),
                       (5, 2, 1, "")]
    digest = {r["doc_id"]: r["items_sha256"] for r in decontam.digest(decontam.benchmark_hits(frame, items)).collect()}
    assert digest[1] == hashlib.sha256(b"b").hexdigest() and digest[3] == hashlib.sha256(b"").hexdigest()
    assert decontam.clean(docs, items).count() == len(ROWS)
    assert decontam.benchmark_hits(docs, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.clean(none, items).count() == 0


@pytest.mark.parametrize("size", [40, 30_000])
def test_codes_within_a_radius(size):
    """Both ways of probing, by values within reach and by values that occur, find every code within the radius."""
    rng = np.random.default_rng(size)
    codes = rng.integers(0, 1 << 16, (size, 3)).astype(np.uint16)
    codes[size // 2:] = codes[0] ^ (rng.random((size - size // 2, 3)) < 0.3).astype(np.uint16)
    index = ann.MultiIndex(codes)
    for radius in (0, 1, 2, 7, 20, 48):
        rows, distance = index.within(codes[0], radius)
        every = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
        assert rows.tolist() == np.flatnonzero(every <= radius).tolist() and (distance == every[rows]).all()


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 30, rng.normal(size=6).tolist()) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn(
        "shard", F.lit("x"))
    found = [sorted(map(tuple, ann.nearest(frame.repartition(n), "vec_id % 10 = 0", k=5).collect())) for n in (1, 7)]
    assert found[0] == found[1]
    for query in (0, 10, 20):
        asked = np.array(min(v for i, v in rows if i == query))
        # The search may miss some, but it asks with the id's first vector.
        scores = {(i, round(float(np.dot(asked, v)), 9)) for i, v in rows if i != query}
        got = [(r[2], round(r[3], 9)) for r in found[0] if r[0] == query]
        assert len(got) == 5 and set(got) <= scores and max(scores, key=lambda s: s[1]) in got


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v * s]) for i, (v, s) in enumerate(zip(rng.standard_normal((300, 8)), rng.uniform(0.5, 2, 300)))]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [1.0])]
    same = [(2000 + i, rows[0][1]) for i in range(30)]
    frame = spark.createDataFrame(rows + odd + same, "vec_id long, embedding array<double>")
    usable = rows + same
    matrix, ids = np.array([v for _, v in usable]), np.array([i for i, _ in usable])
    hits = asked = 0
    for key, group in itertools.groupby(sorted(ann.nearest(frame, "vec_id % 20 = 0").collect(), key=lambda r: (r[0], r[1])), lambda r: r[0]):
        group = list(group)
        score = (matrix * matrix[list(ids).index(key)]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != key][:20]
        assert [r["rank"] for r in group] == list(range(1, 21))
        hits += len({r["vec_id"] for r in group} & set(ids[order].tolist()))
        asked += 20
    assert hits >= 0.9 * asked
    assert ann.nearest(frame.limit(0), "vec_id % 20 = 0").count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:3], frame.schema), "vec_id = 0").count() == 2


def test_licenses(spark, none):
    mit = " ".join(w.capitalize() + "." for w in [dict((s, t) for s, t in licenses.SENTENCES)[i] for i in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")])
    rows = [(1, f"Code.\nCopyright (c) 2020 Someone\n{mit}"), (2, "Released under the MIT License. All rights reserved."), (3, None), (4, "nothing")]
    got = {r["doc_id"]: (r["licenses"], r["n_matches"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1), 2: ("MIT,All-rights-reserved", 2), 3: ("", 0), 4: ("", 0)}
    assert licenses.scan(none).count() == 0


def test_chat(spark):
    tricky = "\\### Assistant: </turn> ok <turn user>\n\\l \\\\"
    talks = {1: [("user", "hi"), ("assistant", tricky)], 2: [("user", "hi"), ("assistant", "b"), ("user>\n", "c")],
             3: [("user", "hi"), ("assistant", tricky)], 4: [("assistant", "")]}
    rows = [(c, n, r, t or None) for c, turns in talks.items() for n, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sequences, digests = chat.formatted_conversations(frame)
    got = {r["conv_id"]: r for r in digests.collect()}
    for key, turns in talks.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    nodes = [n for s in sequences.collect() for n in s["nodes"]]
    assert sum(n["parent"] == -1 for n in nodes) <= 4 and len(nodes) <= 6
    assert chat.formatted_conversations(frame.limit(0))[1].count() == 0


def test_lm(spark, docs, none):
    got = lm.score_texts(docs).collect()
    assert len(got) == len(ROWS) and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    model = lm.Model.start(np.full(lm.CLASSES, 1 / lm.CLASSES))
    contexts = np.full((lm.CLASSES, lm.ORDER), lm.START_CODE)
    assert np.isclose((10 ** model.log_probability(contexts, np.arange(lm.CLASSES))).sum(), 1)
    assert lm.score_texts(none).count() == 0


def test_toxicity(spark, none):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 200, n))
    rows = [(i, say(60) + (" vilething" + "abcde"[i % 5] + " " + say(5) if i % 3 == 0 else "")) for i in range(240)]
    frame = spark.createDataFrame(rows + [(None, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    network = toxicity.train(frame, labels)
    got = toxicity.score_texts(frame, network).collect()
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["held_out"]]
    assert np.mean(right) >= 0.9 and all(0 <= r["score"] <= 1 for r in got) and len(got) == 242
    assert toxicity.score_texts(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and os.path.isdir("/root/testdata/sf0.001")


def test_a_worker_remembers_few_words_and_gives_memory_back():
    from articleflow.llm.common import gives_back

    text = " ".join(f"word{i}" for i in range(300))
    small, usual = worker_encoder(vocabulary_path(), 20), worker_encoder(vocabulary_path())
    assert small is worker_encoder(vocabulary_path(), 20) and small is not usual
    assert [small.encode([text, "a b"]) for _ in range(3)] == [usual.encode([text, "a b"])] * 3
    small.encode(["a b"])
    assert len(small._inner) < 20 < len(usual._inner)
    assert list(gives_back(lambda batches: (b for b in batches))(iter([1, 2]))) == [1, 2]


def test_task_drops_tools_of_other_operators():
    from articleflow.llm.common import _worker_home, gives_back, kept_in_worker

    kept_in_worker("encoder:x", dict), kept_in_worker("other:x", dict), kept_in_worker("sent", dict)
    held = lambda: {n for n in vars(_worker_home()) if n in ("encoder:x", "other:x", "sent")}
    list(gives_back(lambda batches: batches, keeps=("encoder:",))(iter([1])))
    assert held() == {"encoder:x"}
    kept_in_worker("sent", dict)
    list(gives_back(lambda batches: batches)(iter([1])))
    assert held() == {"sent"}


def test_toxicity_inputs_of_many_new_words(monkeypatch):
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(k, k + 90)) for k in range(0, 400, 40)]
    at_once = toxicity.Scorer(toxicity.Network()).score(texts)
    monkeypatch.setattr(toxicity, "STEP_WORDS", 7)
    assert np.allclose(toxicity.Scorer(toxicity.Network()).score(texts), at_once, atol=1e-6)
