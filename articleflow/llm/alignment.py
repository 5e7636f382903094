"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of aligned id pairs.

Both tokenizers' tokens are byte ranges of the same text. Offsets where a token of A and a token of B end cut them into
groups; the two tokens that end there are linked. How often an id pair is linked is counted by external spills:

1. one pass over the documents aligns each one and collects records (B id, A id, document, times). Whenever enough have
   come together, a task sorts them and writes them out as runs, one for each radix of the B id. A run is two zstd
   frames: the pairs with their totals, and the documents of each pair. Runs are rows of a written table, so a lost
   executor costs no more than its own tasks;
2. the runs of a radix are dealt in units of bounded size. A task merges the pair frames of its unit through a heap, in
   the order of B id and then A id, and counts each pair; counts of a radix that needs several units are summed up;
3. a unit's records meet the counts of their radix. Those lie in the order of the B side, so the highest count of each
   B id is known once its pairs have gone by, and every record's share flows back to its document.

Units are cut by size, not by key, so a pair that stands in every document is spread like any other.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import kept_in_worker, text_slices
from articleflow.llm.encoder import vocabulary_path
from articleflow.session import cut

# Links after which a task writes its runs, and records of one unit, on average.
RUN_LINKS, UNIT_RECORDS = 2_000_000, 4_000_000
# Radixes: half as many as the input has splits, within these bounds. They change the layout, not the result.
MIN_RADIXES, MAX_RADIXES = 8, 1_024
# Words whose alignment a worker remembers. It only saves time: the memory starts anew when it is full.
MEMORY_WORDS = 400_000
# Words that are encoded in one call.
_JOINED = 50
# A sort key holds B id, A id and the number of the document since the last spill.
_ID_BITS, _DOC_BITS = 20, 24
_ID_MASK, _DOC_MASK = (1 << _ID_BITS) - 1, (1 << _DOC_BITS) - 1


# ---- tokens as bytes ------------------------------------------------------------------------------------------------


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself where it is one, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


class ByteTokens:
    """Side A: byte-level BPE from a vocabulary file; special strings are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        known, codes = self._tokenizer.get_vocab(with_added_tokens=True), _byte_of_char()
        self.bytes_of = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            if all(c in codes for c in token):
                self.bytes_of[i] = bytes(codes[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """Side B: sentence pieces with byte fallback. The model puts a space before every text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        # Words can be encoded apart if no piece runs on over a space or holds a line end.
        self.words_apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


Aligned = tuple[int, int, bytes, str]
_EMPTY: Aligned = (0, 0, b"", "")


def _listed(groups_a: np.ndarray, groups_b: np.ndarray, strings: tuple[np.ndarray, ...], a: np.ndarray,
            b: np.ndarray) -> list[str]:
    """Groups in writing, token by token: the ids of A, the ids of B, group after group, each with what follows it.

    ``groups_a`` and ``groups_b`` are the numbers of the tokens that end the groups.
    """
    a_comma, a_bar, b_comma, b_end = strings
    out = np.empty(len(a) + len(b), dtype=object)
    # Tokens of the other side that stand before: those of earlier groups, and for B also those of its own group.
    of_a = np.searchsorted(groups_a, np.arange(len(a)))
    of_b = np.searchsorted(groups_b, np.arange(len(b)))
    at_a = np.arange(len(a)) + np.append(0, groups_b + 1)[of_a]
    at_b = np.arange(len(b)) + (groups_a + 1)[of_b]
    out[at_a], out[at_b] = a_comma[a], b_comma[b]
    out[at_a[groups_a]], out[at_b[groups_b]] = a_bar[a[groups_a]], b_end[b[groups_b]]
    return out.tolist()


class Aligner:
    """Alignments of whole texts, with a space before each.

    Both sides cut before a space or line end that follows a word, so texts whose words stand apart by single spaces or
    line ends are aligned word by word and words are remembered; other texts are aligned in one piece. Both ways give
    the same result.
    """

    def __init__(self, a_path: str, b_path: str, memory_words: int = MEMORY_WORDS) -> None:
        self._a, self._b = ByteTokens(a_path), PieceTokens(b_path)
        self._lengths = [np.array([len(t) for t in side.bytes_of], dtype=np.int64) for side in (self._a, self._b)]
        self._strings = tuple(
            np.array([f"{i}{mark}" for i in range(len(side.bytes_of))], dtype=object)
            for side, marks in ((self._a, ",|"), (self._b, ",;")) for mark in marks)
        self._limit = memory_words
        # By word; groups end with a semicolon. A word that cannot be aligned alone has None.
        self._words: dict[str, Aligned | None] = {}

    def whole(self, text: str) -> Aligned:
        """Alignment of one text in one piece; no tokens where a side's bytes differ from the text's."""
        raw = (" " + text).encode("utf-8")
        found = self._spans([raw], self._a.encode([" " + text]), self._b.encode([text]), [np.array([len(raw)])])
        if not text or found[0] is None:
            return _EMPTY
        n_a, n_b, links, groups = found[0][0]
        return n_a, n_b, links, groups[:-1]

    def _spans(self, raws: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]],
               ends: list[np.ndarray]) -> list[list[Aligned] | None]:
        """Alignments of the spans of each text that end at ``ends``; None for a text that a side does not cover, or
        in which a span does not end with tokens of both sides."""
        sure = [
            b"".join(map(self._a.bytes_of.__getitem__, a)) == raw == b"".join(map(self._b.bytes_of.__getitem__, b))
            for raw, a, b in zip(raws, ids_a, ids_b)
        ]
        chosen = [i for i, ok in enumerate(sure) if ok and raws[i]]
        out: list[list[Aligned] | None] = [None] * len(raws)
        if not chosen:
            return out
        # All covered texts as one: offsets run on.
        a = np.array([t for i in chosen for t in ids_a[i]], dtype=np.int64)
        b = np.array([t for i in chosen for t in ids_b[i]], dtype=np.int64)
        end_a, end_b = np.cumsum(self._lengths[0][a]), np.cumsum(self._lengths[1][b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        links = (b[last_b] << _ID_BITS | a[last_a]).astype("<u8").tobytes()
        written = _listed(last_a, last_b, self._strings, a, b)
        bases = np.cumsum([0, *(len(raws[i]) for i in chosen)])
        wanted = np.concatenate([base + ends[i] for base, i in zip(bases, chosen)])
        group = np.searchsorted(common, wanted)
        met = common[group] == wanted
        until = np.stack([group, last_a[group], last_b[group]], axis=1) + 1
        before = np.concatenate([np.zeros((1, 3), np.int64), until[:-1]])
        rows = np.concatenate([before, until], axis=1).tolist()
        at = 0
        for i in chosen:
            n = len(ends[i])
            if met[at:at + n].all():
                out[i] = [
                    (a1 - a0, b1 - b0, links[8 * g0:8 * g1], "".join(written[a0 + b0:a1 + b1]))
                    for g0, a0, b0, g1, a1, b1 in rows[at:at + n]
                ]
            at += n
        return out

    def _learn(self, words: list[str]) -> None:
        """Align words that begin with a space or a line end, many in one call."""
        parts = [words[i:i + _JOINED] for i in range(0, len(words), _JOINED)]
        # A text before the first word, as a line end may begin the words; the model puts the space before it.
        joined = ["x" + "".join(part) for part in parts]
        raws = [(" " + text).encode("utf-8") for text in joined]
        ends = [2 + np.cumsum([0, *(len(word.encode("utf-8")) for word in part)]) for part in parts]
        found = self._spans(raws, self._a.encode([" " + text for text in joined]), self._b.encode(joined), ends)
        alone: list[str] = []
        for part, spans in zip(parts, found):
            if spans is not None:
                self._words.update(zip(part, spans[1:]))
            elif len(part) > 1:
                alone += part
            else:
                self._words[part[0]] = None
        for word in alone:
            self._learn([word])

    def align(self, texts: list[str]) -> list[Aligned]:
        if len(self._words) > self._limit:
            self._words = {}
        listed: list[list[str] | None] = []
        for text in texts:
            words = text.split()
            if self._b.words_apart and words and " ".join(words) == text.replace("\n", " "):
                # Long words are no words: they are not worth remembering.
                pieces = (" " + text.replace("\n", " \n")).split(" ")[1:] if "\n" in text else words
                pieces = [w if w[0] == "\n" else " " + w for w in pieces]
                listed.append(pieces if max(map(len, pieces)) < 100 else None)
            else:
                listed.append(None)
        new = set().union(*(pieces for pieces in listed if pieces)).difference(self._words)
        if new:
            self._learn(list(new))
        out = []
        for text, pieces in zip(texts, listed):
            spans = list(map(self._words.__getitem__, pieces)) if pieces else [None]
            if None in spans:
                # Rare: what a word alone cannot decide, the whole text does.
                out.append(self.whole(text))
                continue
            n_a, n_b, links, groups = zip(*spans)
            out.append((sum(n_a), sum(n_b), b"".join(links), "".join(groups)[:-1]))
        return out


def worker_aligner(a_path: str, b_path: str) -> Aligner:
    """The worker process's aligner for two vocabulary files."""
    return kept_in_worker(f"aligner:{a_path}:{b_path}", lambda: Aligner(a_path, b_path))


# ---- runs -----------------------------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 64- or 32-bit numbers as one zstd frame, each as differences with its length."""
    parts = []
    for column in columns:
        parts += [np.array([len(column)], "<u8").tobytes(), np.diff(column, prepend=column.dtype.type(0)).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(frame: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(frame), 0, []
    for kind in types:
        n, size = int(np.frombuffer(raw, "<u8", 1, at)[0]), np.dtype(kind).itemsize
        out.append(np.cumsum(np.frombuffer(raw, kind, n, at + 8), dtype=kind))
        at += 8 + n * size
    return out


def _pair_frame(pairs: np.ndarray, totals: np.ndarray) -> bytes:
    return _pack(pairs, totals)


def _radix_of(b: np.ndarray, radixes: int) -> np.ndarray:
    """Radix of B ids; neighbouring ids, which are of like frequency, fall apart."""
    return (b % np.uint64(radixes)).astype(np.uint16)


def _runs(links: np.ndarray, docs: np.ndarray, first_doc: int, radixes: int) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(radix, pair frame, document frame, records) of the links collected so far, each run in the order of the pairs."""
    keys = np.sort(links << np.uint64(_DOC_BITS) | docs)
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    times = np.diff(starts, append=len(keys)).astype("<u8")
    keys = keys[starts]
    pairs, docs = keys >> np.uint64(_DOC_BITS), (keys & np.uint64(_DOC_MASK)) + np.uint64(first_doc)
    radix = _radix_of(pairs >> np.uint64(_ID_BITS), radixes)
    order = np.argsort(radix, kind="stable")
    ends = np.cumsum(np.bincount(radix, minlength=radixes))
    for r, (x, y) in enumerate(zip([0, *ends], ends)):
        if x == y:
            continue
        own = order[x:y]
        pair, doc, n = pairs[own], docs[own], times[own]
        heads = np.flatnonzero(np.diff(pair, prepend=~pair[:1]) != 0)
        yield (r, _pair_frame(pair[heads], np.add.reduceat(n, heads)),
               _pack(np.append(heads, len(own)).astype("<u8"), doc, n), len(own))


_STAGE = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, task int, row long, radix int, "
          "pairs binary, records binary, size long")


def _aligned(docs: DataFrame, a_path: str, b_path: str, radixes: int, run_links: int) -> DataFrame:
    """Two kinds of rows: documents with their own figures (radix null), and runs (doc_id and row null)."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL(_STAGE).fields])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_path, b_path)
        task = TaskContext.get().partitionId()
        links, counts = [], []
        row = first = held = 0
        arrow = None

        def batch_of(columns: dict, n: int) -> pa.RecordBatch:
            kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            fields = [("doc_id", arrow)] + [(name, kinds[kind]) for name, kind in map(str.split, _STAGE.split(", "))]
            filled = {"task": pa.array([task] * n, pa.int32())} | columns
            return pa.RecordBatch.from_arrays(
                [filled[name] if name in filled else pa.nulls(n, kind) for name, kind in fields],
                [name for name, _ in fields])

        def spilled() -> Iterator[pa.RecordBatch]:
            # The joined links and their documents' numbers since the last spill.
            joined = np.frombuffer(b"".join(links), "<u8")
            docs = np.repeat(np.arange(len(counts), dtype="<u8"), counts)
            for r, pairs, records, size in _runs(joined, docs, first, radixes) if len(joined) else ():
                yield batch_of({"radix": pa.array([r], pa.int32()), "pairs": pa.array([pairs], pa.binary()),
                                "records": pa.array([records], pa.binary()), "size": pa.array([size], pa.int64())}, 1)

        for batch in batches:
            arrow = batch.column(0).type
            for start, texts in text_slices(batch.column(1)):
                found = aligner.align(texts)
                n = len(texts)
                n_links = [len(f[2]) // 8 for f in found]
                digests = [hashlib.sha256(f[3].encode()).hexdigest() if f[0] else "" for f in found]
                yield batch_of({
                    "doc_id": batch.column(0).slice(start, n), "n_a": pa.array([f[0] for f in found], pa.int64()),
                    "n_b": pa.array([f[1] for f in found], pa.int64()), "n_groups": pa.array(n_links, pa.int64()),
                    "n_links": pa.array(n_links, pa.int64()), "groups_sha256": pa.array(digests, pa.string()),
                    "row": pa.array(range(row, row + n), pa.int64()),
                }, n)
                links += [f[2] for f in found]
                counts += n_links
                row, held = row + n, held + sum(n_links)
                if held >= run_links or len(counts) >= _DOC_MASK // 2:
                    yield from spilled()
                    links, counts, first, held = [], [], row, 0
        if links:
            yield from spilled()

    return docs.mapInArrow(align, schema)


# ---- counting -------------------------------------------------------------------------------------------------------


def _merged(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, count) over all runs in the order of the pairs: a heap holds the next pair of each run."""
    def run(frame: bytes) -> Iterator[tuple[int, int]]:
        pairs, totals = _unpack(frame, "<u8", "<u8")
        return zip(pairs.tolist(), totals.tolist())

    for pair, same in groupby(heapq.merge(*map(run, frames)), key=itemgetter(0)):
        yield pair, sum(n for _, n in same)


def _count_unit(runs: pa.Table) -> pa.Table:
    found = list(_merged(runs["pairs"].to_pylist()))
    return pa.table({
        "radix": pa.array([runs["radix"][0].as_py()] * len(found), pa.int32()),
        "pair": pa.array([pair for pair, _ in found], pa.int64()), "n": pa.array([n for _, n in found], pa.int64()),
    })


def _shares(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document and run: links whose pair is a best one, and the sum of the pairs' counts."""
    order = np.argsort(counts["pair"].to_numpy())
    pair, n = counts["pair"].to_numpy()[order].astype("<u8"), counts["n"].to_numpy()[order]
    # The pairs of a B id lie together.
    side = pair >> np.uint64(_ID_BITS)
    heads = np.flatnonzero(np.diff(side, prepend=~side[:1]) != 0)
    highest = np.repeat(np.maximum.reduceat(n, heads), np.diff(heads, append=len(side)))
    best = n == highest
    out = []
    for task, frame, records in zip(runs["task"].to_pylist(), runs["pairs"], runs["records"]):
        pairs, _ = _unpack(frame.as_py(), "<u8", "<u8")
        ends, docs, times = _unpack(records.as_py(), "<u8", "<u8", "<u8")
        spot = np.repeat(np.searchsorted(pair, pairs), np.diff(ends.astype(np.int64)))
        times = times.astype(np.int64)
        rows, own = np.unique(docs, return_inverse=True)
        n_best, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        np.add.at(n_best, own, times * best[spot])
        np.add.at(count_sum, own, times * n[spot])
        out.append(pa.table({"task": pa.array([task] * len(rows), pa.int32()), "row": rows.astype(np.int64),
                             "n_best": n_best, "count_sum": count_sum}))
    return pa.concat_tables(out)


def aligned_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None,
                   b_path: str | None = None, radixes: int | None = None, run_links: int = RUN_LINKS,
                   unit_records: int = UNIT_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(one row per document, counts of the linked pairs).

    Documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). Every row is a document of its
    own: repeated rows and null identifiers are kept and count each. Texts that are null, empty or not covered alike
    by both sides have zeros and an empty digest. Pairs: (b, a, n). Whole texts are aligned; other columns are
    ignored. No rows give empty results.
    """
    a_path, b_path = a_path or vocabulary_path(), b_path or vocabulary_path("piece_bpe_32k.model")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    splits = named.rdd.getNumPartitions()
    radixes = radixes or min(MAX_RADIXES, max(MIN_RADIXES, splits // 2))
    stage = cut(_aligned(named, a_path, b_path, radixes, run_links))
    runs = stage.filter("radix is not null").select("radix", "task", "size", "pairs", "records")

    # Units of a radix: as many as its records need.
    sizes = cut(runs.groupBy("radix").agg(F.ceil(F.sum("size") / unit_records).cast("int").alias("units")))
    sizes = F.broadcast(sizes)
    unit = F.pmod(F.xxhash64("task", F.crc32("pairs")), F.col("units")).cast("int")
    dealt = runs.join(sizes, "radix").withColumn("unit", unit)
    counted = dealt.select("radix", "unit", "pairs").groupBy("radix", "unit").applyInArrow(
        _count_unit, "radix int, pair long, n long")
    counts = cut(counted.groupBy("radix", "pair").agg(F.sum("n").alias("n")))

    # Counts go to every unit of their radix; there are no more of them than pairs of vocabulary entries.
    needed = counts.join(sizes, "radix").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    shares = dealt.select("radix", "unit", "task", "pairs", "records").groupBy("radix", "unit").cogroup(
        needed.select("radix", "unit", "pair", "n").groupBy("radix", "unit")).applyInArrow(
        _shares, "task int, row long, n_best long, count_sum long")
    shares = shares.groupBy("task", "row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = stage.filter("radix is null").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "task", "row")
    zero = F.lit(0).cast("long")
    per_doc = own.join(shares, ["task", "row"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    pairs = counts.select(
        F.shiftright("pair", _ID_BITS).cast("int").alias("b"), F.col("pair").bitwiseAND(_ID_MASK).cast("int").alias("a"), "n")
    return per_doc, pairs
