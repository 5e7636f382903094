"""Capture index, tokenizer alignment and ranked search on small fixtures against brute force."""

import base64
import collections
import gzip
import hashlib
import math
import re

import numpy as np
import pytest

from articleflow.llm import alignment, bag_search, warc
from articleflow.llm.encoder import vocabulary_path
from articleflow.session import scratch

# ------------------------------------------------------------------------------------------------ capture index

LONG_PAGE = "<p>" + "lang é " * 40_000
PAGES = [
    (5, "http://www.Example.org/a?b=1#top", "<p>x</p>"), (2, "https://example.org:443/a", "<p>x</p>"),
    (9, None, "<p>x</p>"), (3, "http://example.org/a", None), (4, "http://example.org/a", ""),
    (None, "http://u:p@example.org:8080", "<p>y</p>"), (7, "not a url\twith blanks\n", "<p>y</p>"),
    (6, "http://example.org/a", "<p>z</p>"), (6, "http://example.org/a", "<p>z</p>"), (6, None, "<p>z</p>"),
    (8, "ftp://h", LONG_PAGE), (1, "http://example.org/a b", "été\x00"),
]
PAGE_SCHEMA = "page_id long, url string, html string, file string, key string, copy int, row int"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*row, "f", "k", 1, 2) for row in PAGES], PAGE_SCHEMA)


def page_facts(rows, min_bytes=0):
    """Expected digest rows. Rows that cannot be told apart: one of them can be the response."""
    groups, out, taken = collections.defaultdict(list), [], set()
    for i, (page, url, html) in enumerate(rows):
        groups[html or ""].append((page is None, page or 0, url is not None, url or "", i))
    for i, (page, url, html) in enumerate(rows):
        data = (html or "").encode()
        first = min(groups[html or ""])
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        alone = len(groups[html or ""]) == 1 or first[0] or len(data) < min_bytes or first[4] == i
        out.append((page, len(data), digest, "response" if alone else "revisit", None if alone else first[1]))
    return collections.Counter(out)


@pytest.mark.parametrize("min_bytes, max_bytes, block_lines", [(0, 1 << 20, 3000), (0, 1, 2), (5, 1 << 20, 1)])
def test_archive_equals_brute_force(spark, pages, min_bytes, max_bytes, block_lines):
    archive = warc.write_archive(pages.repartition(3), scratch(spark, "warc"), min_bytes=min_bytes, max_bytes=max_bytes,
                                 block_lines=block_lines)
    records = warc.read_records(archive, warc.lookup(archive, pages)).collect()
    got = collections.Counter(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records)
    assert got == page_facts(PAGES, min_bytes)
    for r in records:
        if r["record_type"] == "response":
            assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["payload_digest"]
    assert collections.Counter((r["page_id"], r["url"]) for r in records) == collections.Counter(p[:2] for p in PAGES)


def test_archive_files_are_members_of_their_own(spark, pages):
    archive = warc.write_archive(pages.coalesce(1), scratch(spark, "warc"))
    captures = warc.lookup(archive, pages).collect()
    files, base = warc.open_fs(f"{archive.root}/records")
    raw = {c["file"]: files.open_input_file(f"{base}/{c['file']}").read() for c in captures}
    assert sum(c["length"] for c in captures) == sum(map(len, raw.values()))
    names = []
    for c in captures:
        headers, _ = warc.parse_record(gzip.decompress(raw[c["file"]][c["offset"]:c["offset"] + c["length"]]))
        assert headers["WARC-Type"] == c["type"]
        names.append(headers)
    ids = collections.Counter(n["WARC-Record-ID"] for n in names)
    assert max(ids.values()) == 1
    assert {n["WARC-Refers-To"] for n in names if "WARC-Refers-To" in n} <= set(ids)


def test_lookup_reads_few_blocks(spark):
    rows = [(i, f"http://h{i % 40}.example.org/{i}", f"body {i}") for i in range(2000)]
    rows += [(5000 + i, "http://hot.example.org/", f"hot {i}") for i in range(1000)]
    many = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(many, scratch(spark, "warc"), block_lines=50)
    assert [c["url"] for c in warc.get(archive, "http://h7.example.org/47#x")] == ["http://h7.example.org/47"]
    assert warc.get(archive, "http://h7.example.org/nowhere") == []
    assert len(warc.get(archive, "http://hot.example.org")) == 1000
    asked = spark.createDataFrame([("http://h7.example.org/47",), ("http://none",), (None,)], "url string")
    assert [r["page_id"] for r in warc.read_records(archive, warc.lookup(archive, asked)).collect()] == [47]
    number = next(n for n in warc._shards_of([(a.encode(), b.encode(), c) for a, b, c in archive.shards],
                                             warc.surt("http://h7.example.org/47")))
    shard = warc.Shard(f"{archive.root}/index", archive.shards[number][2])
    assert len(list(shard.find(warc.surt("http://h7.example.org/47")))) == 1 and shard.unpacked <= 2


def test_reversed_host_keys():
    assert warc.surt("https://WWW.example.org:443/A?b=%20 c#d") == "org,example,www)/A?b=%20%20c"
    assert warc.surt("http://u@h:81?x") == "h:81)/?x" and warc.surt("http://[::1]/") == "[::1])/"
    assert warc.surt(None) == warc.surt("") == ")" and " " not in warc.surt("no url\n at all")


def test_empty_archive(spark, pages):
    archive = warc.write_archive(pages.limit(0), scratch(spark, "warc"))
    assert archive.shards == [] and warc.lookup(archive, pages).count() == 0 and warc.get(archive, "http://h/") == []


def test_changed_records_are_refused():
    record = warc._record(1, "http://h/", b"body", warc._digest(b"body"), 0, warc.NO_DATE, None)
    assert warc.parse_record(record)[0]["X-Page-ID"] == "1"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"body", b"bodz"))


# ----------------------------------------------------------------------------------------------------- alignment

TEXTS = [
    (1, "The cat sat on the mat. It's 12,5 degrees\nand rising été naïve"), (2, "The cat sat on the mat."), (3, None),
    (4, ""), (5, "<s> </s> <|endoftext|> <unk>"), (6, "a▁b"), (7, "  lead  and\ttab \r\n tail "), (8, "x"), (8, "x"),
    (None, "no id ① 漢字 🙂"), (9, "\n"), (10, "w" * 300 + " " + "long word " * 800), (11, "the the the\nthe the"),
]


def plain_sides():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as ranks:
        a_bytes = {int(i): base64.b64decode(token) for token, i in map(bytes.split, ranks)}
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in range(b.get_piece_size())]
    return (lambda t: a.encode(t, add_special_tokens=False).ids), a_bytes, b.encode, b_bytes


def brute_alignment(texts):
    encode_a, a_bytes, encode_b, b_bytes = plain_sides()
    listed, counts = [], collections.Counter()
    for _, text in texts:
        a, b = encode_a(" " + (text or "")), encode_b(text or "")
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(b_bytes[i] for i in b) != raw:
            listed.append(([], [], [], []))
            continue
        ends_a = np.cumsum([len(a_bytes[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(b_bytes[i]) for i in b]).tolist()
        groups, links, x, y = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((b[j - 1], a[i - 1]))
            x, y = i, j
        counts.update(links)
        listed.append((a, b, groups, links))
    best = collections.Counter()
    for (b, _), n in counts.items():
        best[b] = max(best[b], n)
    rows = [
        (doc, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
         sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for (doc, _), (a, b, groups, links) in zip(texts, listed)
    ]
    return collections.Counter(rows), counts


@pytest.mark.parametrize("options", [{}, {"run_links": 20, "unit_records": 15, "radixes": 3}])
def test_alignment_equals_brute_force(spark, options):
    docs = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in TEXTS], "doc_id long, text string, row int, task int, radix string")
    per_doc, pairs = alignment.aligned_counts(docs.repartition(3), **options)
    rows, counts = brute_alignment(TEXTS)
    assert collections.Counter(tuple(r) for r in per_doc.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == rows
    assert {(r["b"], r["a"]): r["n"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    per_doc, pairs = alignment.aligned_counts(docs)
    assert per_doc.count() == 0 and pairs.count() == 0


def test_words_and_whole_texts_align_alike():
    aligner = alignment.Aligner(vocabulary_path(), vocabulary_path("piece_bpe_32k.model"), memory_words=5)
    texts = [t for _, t in TEXTS if t] + ["a b", "a\nb", "\na b", "a b\n", "a\n\nb", "don't stop", "A b A b A b"]
    for _ in range(2):
        assert aligner.align(texts) == [aligner.whole(t) for t in texts]


def test_merge_counts_pairs_in_order():
    runs = [np.array([3, 5, 9], "<u8"), np.array([5, 6], "<u8"), np.array([], "<u8")]
    frames = [alignment._pair_frame(r, np.arange(1, len(r) + 1, dtype="<u8")) for r in runs]
    assert list(alignment._merged(frames)) == [(3, 1), (5, 3), (6, 2), (9, 3)]


# ------------------------------------------------------------------------------------------------- ranked search

DOCS = [
    (1, "the cat sat, the CAT ran"), (2, "the dog"), (3, None), (4, ""), (5, "the cat sat, the cat ran"), (6, "a_cat été"),
    (7, "cat " * 3000), (8, "x y z"), (8, "x y z"), (None, "the cat sat, the cat ran"), (9, "... ---"), (0, "the cat ran sat the cat"),
] + [(i, "copies of one dog") for i in range(100, 140)] + [(i, f"dog word{i % 7} tail{i}") for i in range(200, 260)]
ITEMS = [(1, "the cat cat"), (2, "Dog word3"), (3, None), (4, "nothing known"), (5, "été"), (None, "x"), (2, "Dog word3"),
         (2, "cat"), (6, "of the one")]


def brute_search(docs, items, k):
    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    listed = [(doc, collections.Counter(words(text)), len(words(text))) for doc, text in docs if words(text)]
    n_docs, n_terms = len(listed), sum(n for _, _, n in listed)
    df = collections.Counter(word for _, bag, _ in listed for word in bag)
    out = collections.Counter()
    for item, text in set(items):
        scored = []
        for doc, bag, n in listed:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 12 * m))
                for w in words(text) if bag[w])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1):
            out[(item, rank, None if none else doc, -score)] += 1
    return out


@pytest.mark.parametrize("k, max_item_bytes", [(20, 1 << 20), (3, 100), (1, 1 << 20)])
def test_search_equals_brute_force(spark, k, max_item_bytes):
    docs = spark.createDataFrame([(*row, 1, 2, "s") for row in DOCS], "doc_id long, text string, m int, n int, spot string")
    items = spark.createDataFrame([(*row, 1) for row in ITEMS], "item_id long, text string, rank int")
    found = bag_search.ranked_search(docs.repartition(4), items, k=k, max_item_bytes=max_item_bytes)
    assert collections.Counter(tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(
        DOCS, ITEMS, k)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bag_search.ranked_search(docs.limit(0), items).count() == 0
    assert bag_search.ranked_search(docs, items.limit(0)).count() == 0
    assert bag_search.ranked_search(docs, items.filter("text is null")).count() == 0


def test_search_with_text_identifiers(spark):
    named = [("" if i is None else f"d{i:03d}", t) for i, t in DOCS]
    docs = spark.createDataFrame(named, "doc_id string, text string")
    items = spark.createDataFrame([("q", "sat")], "item_id string, text string")
    found = bag_search.ranked_search(docs, items, k=4).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["", "d000", "d001", "d005"]
