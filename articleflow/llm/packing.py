"""Hierarchical packing of documents into context windows of several sizes.

A document is routed by its length: whole longest windows are cut off first, and what is left goes to the smallest
tier that holds it. Tiers are packed from the longest down; the gap of a window is filled with whole documents of
shorter tiers, the largest that fits first, and what then remains with a piece cut off a shorter document. So all
windows are full except the last one of a task. Windows of one tier are dealt into step groups of equal tokens in
an order that evens out their attention cost.

Packing takes place where the text lies: no document, id or length is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import gives_back, text_slices
from articleflow.llm.encoder import MEMORY_WORDS, vocabulary_path, worker_encoder

CONTEXT = 1024
TIERS = (128, 256, 512, 1024)
END_ID = 0
# Documents are packed together until they hold this many tokens.
POOL_TOKENS = 1_000_000
# Tokens of a step group: 16 windows of 1024, or 128 of 128.
GROUP_TOKENS = 16 * 1024

# A piece on stock: (length, document number in the pool, first token).
Piece = tuple[int, int, int]
Window = list[Piece]


def pack_pool(stock: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, Window]], Window]:
    """Full windows (tier, pieces in order) and the pieces of the one window that stayed incomplete."""
    context = tiers[-1]
    full: list[tuple[int, Window]] = []
    rest: list[Piece] = []
    for length, doc, start in stock:
        while length >= context:
            full.append((context, [(context, doc, start)]))
            length, start = length - context, start + context
        if length:
            rest.append((length, doc, start))
    rest.sort()
    while rest:
        window = [rest.pop()]
        tier = next(t for t in tiers if t >= window[0][0])
        gap = tier - window[0][0]
        while gap and rest:
            at = bisect_right(rest, gap, key=lambda piece: piece[0])
            if at:
                piece = rest.pop(at - 1)
            else:
                # The shortest document on stock is still too long: cut its beginning off.
                length, doc, start = rest.pop(0)
                piece = (gap, doc, start)
                insort(rest, (length - gap, doc, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            return full, window
        full.append((tier, window))
    return full, []


def step_groups(windows: list[tuple[int, Window]], group_tokens: int = GROUP_TOKENS) -> list[int]:
    """The step group of each window: one tier per group, equal tokens, even attention cost (sum of squares).

    Windows of a tier, costliest first, are dealt to the groups back and forth.
    """
    groups = [0] * len(windows)
    base = 0
    for tier in sorted({tier for tier, _ in windows}):
        members = [i for i, (t, _) in enumerate(windows) if t == tier]
        members.sort(key=lambda i: (-sum(p[0] * p[0] for p in windows[i][1]), i))
        count = -(-len(members) // max(1, group_tokens // tier))
        for nth, i in enumerate(members):
            lap, place = divmod(nth, count)
            groups[i] = base + (place if lap % 2 == 0 else count - 1 - place)
        base += count
    return groups


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS,
           group_tokens: int = GROUP_TOKENS, memory_words: int = MEMORY_WORDS) -> DataFrame:
    """One row per piece: (doc_id, start, length, doc_tokens, sequence_id, offset, tier, step_group, ids).

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit bytes. ``start`` counts the document's ids
    before the piece, ``offset`` the sequence's. ``tier`` is the window size a sequence was packed for; the one
    incomplete sequence of a task is to be padded to the longest tier, which it then carries.

    Null or empty text: a document of only the end id. Repeated rows, null or repeated ids: each row is packed on its
    own. Other columns of ``docs`` are ignored. No rows: no pieces. Ties in length are packed in the order of the rows.
    ``memory_words`` bounds the words whose ids a worker remembers; it changes no result.
    """
    where = path or vocabulary_path()
    context = tiers[-1]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(where, memory_words)
        end = np.array([end_id], dtype="<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[bytes] = []
        stock: list[Piece] = []
        sequences = groups = tokens = 0
        key_type = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal keys, ids, stock, sequences, groups, tokens
            full, open_window = pack_pool(stock, tiers)
            if last and open_window:
                full.append((context, open_window))
            dealt = step_groups(full, group_tokens)
            rows: list[tuple] = []
            for n, (tier, window) in enumerate(full):
                offset = 0
                for length, doc, start in window:
                    rows.append((keys[doc], start, length, len(ids[doc]) // 4, base + sequences + n, offset, tier,
                                 base + groups + dealt[n], ids[doc][4 * start:4 * (start + length)]))
                    offset += length
            sequences += len(full)
            groups += max(dealt, default=-1) + 1
            # The incomplete window goes on with the next pool.
            carried = [] if last else open_window
            keys, ids = [keys[d] for _, d, _ in carried], [ids[d] for _, d, _ in carried]
            stock = [(length, n, start) for n, (length, _, start) in enumerate(carried)]
            tokens = sum(piece[0] for piece in stock)
            columns = list(zip(*rows)) or [()] * 9
            types = [key_type, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids"],
            )

        for batch in batches:
            key_type = batch.column(0).type
            for first, texts in text_slices(batch.column(1)):
                names = batch.column(0).slice(first, len(texts)).to_pylist()
                for name, found in zip(names, encoder.encode(texts)):
                    found += end
                    stock.append((len(found) // 4, len(keys), 0))
                    keys.append(name)
                    ids.append(found)
                    tokens += len(found) // 4
                if tokens >= pool_tokens:
                    yield flush(False)
        if stock:
            yield flush(True)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        gives_back(run, keeps=("encoder:",)),
        f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, "
        "step_group long, ids binary",
    )


def piece_digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the unsigned crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier",
        "step_group",
    )
