"""Conversations as prefix trees for training.

Conversations that begin with the same turns share them: a turn is emitted once for all conversations that have it
after the same turns before it. Trees are emitted depth-first. Every token gets the position it has in its own
conversation, and every turn the intervals of the emitted sequence that it may attend to: its ancestors and itself.

Conversations are sorted by the digests of their turns, so that those with common beginnings are neighbours, and the
order is cut into ranges, whatever the size of a tree; a range is emitted in sequences of bounded length. A tree that
spans several sequences repeats the turns on the path to where it goes on. Equal conversations are emitted once.

A turn is written ``<turn role>``, a line end, the text, ``</turn>`` and a line end. Inside texts and roles backslashes
are doubled and the ``<`` of a control string is written ``\\l``, so no text can hold a control string, and all of it
can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import kept_in_worker
from articleflow.llm.encoder import vocabulary_path, worker_encoder
from articleflow.session import cut

# Tokens of a sequence, unless a single conversation is longer.
MAX_TOKENS = 8192
LOSS_ROLE = "assistant"
_TURN = re.compile(r"<turn ([^>\n]*)>\n(.*?)</turn>\n", re.DOTALL)
_CODES = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}

SEQUENCE = (
    "sequence_id long, ids binary, position_ids binary, loss_mask binary, "
    "nodes array<struct<start:int,length:int,parent:int,position:int,spans:array<struct<from:int,to:int>>>>, "
    "leaves array<struct<path:binary,node:int>>"
)


def escape(text: str) -> str:
    return re.sub(r"<(/?turn)", r"\\l\1", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _CODES[m[1]], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Opening mark, escaped text, closing mark."""
    return f"<turn {escape_role(role)}>\n", escape(text), "</turn>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, at = [], 0
    for match in _TURN.finditer(formatted):
        if match.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, path, turns): turns in order, null role or text as empty; ``path`` holds 16 bytes per turn."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [
                b"".join(hashlib.blake2b(f"{len(t['role'])}:{t['role']}{t['text']}".encode("utf-8", "surrogatepass"),
                                         digest_size=16).digest() for t in listed)
                for listed in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.binary()), batch.column(1)],
                                             ["conv_id", "path", "turns"])

    listed = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                 F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    listed = listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias(
        "text"))).alias("turns"))
    kind = turns.schema[conv_id].dataType.simpleString()
    return listed.mapInArrow(sign, f"conv_id {kind}, path binary, turns array<struct<role:string,text:string>>")


class _Forest:
    """One sequence in the making."""

    def __init__(self) -> None:
        self.ids: list[bytes] = []
        self.positions: list[np.ndarray] = []
        self.loss: list[bytes] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.tokens = 0

    def add(self, parent: int, coded: tuple[bytes, bytes, bytes], learned: bool) -> int:
        """Emit a turn below ``parent`` (-1: a root); its number."""
        sizes = [len(part) // 4 for part in coded]
        length = sum(sizes)
        above = self.nodes[parent] if parent >= 0 else None
        position = above["position"] + above["length"] if above else 0
        spans = [dict(span) for span in above["spans"]] if above else []
        if spans and spans[-1]["to"] == self.tokens:
            spans[-1]["to"] += length
        else:
            spans.append({"from": self.tokens, "to": self.tokens + length})
        self.nodes.append({"start": self.tokens, "length": length, "parent": parent, "position": position, "spans": spans})
        self.ids += coded
        self.positions.append(np.arange(position, position + length, dtype="<u4"))
        self.loss.append(bytes(sizes[0]) + (b"\x01" if learned else b"\x00") * sizes[1] + bytes(sizes[2]))
        self.tokens += length
        return len(self.nodes) - 1

    def row(self, sequence_id: int) -> dict:
        return {
            "sequence_id": sequence_id, "ids": b"".join(self.ids),
            "position_ids": b"".join(p.tobytes() for p in self.positions), "loss_mask": b"".join(self.loss),
            "nodes": self.nodes, "leaves": self.leaves,
        }


_NODE = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()),
                   ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])
_ROW = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("position_ids", pa.binary()),
                  ("loss_mask", pa.binary()), ("nodes", pa.list_(_NODE)),
                  ("leaves", pa.list_(pa.struct([("path", pa.binary()), ("node", pa.int32())])))])


def format_trees(talks: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS,
                 loss_role: str = LOSS_ROLE) -> DataFrame:
    """Sequences of prefix trees over the distinct conversations of ``talks`` (see ``conversations``).

    ``nodes`` are the emitted turns: place and length in the sequence, number of the parent (-1: none), first
    position, and ``spans``, the half-open intervals that the turn attends to (causally within itself). ``leaves``
    names the turn where each conversation ends. ``loss_mask`` holds one byte per token, 1 for texts of ``loss_role``.
    Ids and positions are little-endian unsigned 32-bit integers. Every opening mark, text and closing mark is encoded
    on its own, so that shared turns have equal ids in all conversations.
    """
    where = path or vocabulary_path()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(where)
        base, made = TaskContext.get().partitionId() << 40, 0
        forest, trail, before = _Forest(), [], []

        def done() -> pa.RecordBatch:
            nonlocal forest, trail, before, made
            row = forest.row(base + made)
            forest, trail, before, made = _Forest(), [], [], made + 1
            return pa.RecordBatch.from_pylist([row], schema=_ROW)

        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [(t["role"], t["text"]) for t in listed]
                shared = 0
                while shared < min(len(turns), len(before)) and turns[shared] == before[shared]:
                    shared += 1
                flat = encoder.encode([part for turn in turns for part in turn_parts(*turn)])
                coded = [tuple(flat[i:i + 3]) for i in range(0, len(flat), 3)]
                fresh = sum(len(p) for parts in coded[shared:] for p in parts) // 4
                if forest.tokens and forest.tokens + fresh > max_tokens:
                    yield done()
                    shared = 0
                trail = trail[:shared]
                for turn, parts in zip(turns[shared:], coded[shared:]):
                    trail.append(forest.add(trail[-1] if trail else -1, parts, turn[0] == loss_role))
                before = turns
                forest.leaves.append({"path": name, "node": trail[-1]})
        if forest.leaves:
            yield done()

    # Equal conversations meet on the map side; ranges of the sorted paths split even a very popular first turn.
    distinct = cut(talks.select("path", "turns").dropDuplicates(["path"]))
    return distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(emit, SEQUENCE)


def read_back(sequences: DataFrame, path: str | None = None) -> DataFrame:
    """(path, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from emitted sequences alone.

    The ids on the way from a root to a leaf are decoded and parsed; the texts under the loss mask are decoded from
    the masked ids.
    """
    where = path or vocabulary_path()

    def load():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(where)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = kept_in_worker(f"decoder:{where}", load)
        for batch in batches:
            rows = []
            for sequence in batch.to_pylist():
                ids = np.frombuffer(sequence["ids"], dtype="<u4")
                mask = np.frombuffer(sequence["loss_mask"], dtype=np.uint8).astype(bool)
                nodes = sequence["nodes"]
                texts: list[tuple[str, str]] = []
                for node in nodes:
                    span = slice(node["start"], node["start"] + node["length"])
                    part = ids[span]
                    texts.append((tokenizer.decode(part.tolist(), skip_special_tokens=False),
                                  tokenizer.decode(part[mask[span]].tolist(), skip_special_tokens=False)))
                for leaf in sequence["leaves"]:
                    way, at = [], leaf["node"]
                    while at >= 0:
                        way.append(at)
                        at = nodes[at]["parent"]
                    formatted = "".join(texts[n][0] for n in reversed(way))
                    learned = "".join(unescape(texts[n][1]) for n in reversed(way))
                    turns = parse(formatted)
                    said = "".join(f"{role}\n{text}\n" for role, text in turns)
                    rows.append((leaf["path"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned),
                                 hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return sequences.mapInArrow(
        digest, "path binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_conversations(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(sequences, digests per conversation). Turns of a conversation are ordered by turn, role, text.

    Null role or text counts as empty, a null turn comes first, a null conversation id is one conversation; repeated
    turns are turns. Other columns are ignored; no rows give no sequences.
    """
    talks = cut(conversations(turns, **columns))
    sequences = cut(format_trees(talks))
    digests = read_back(sequences)
    named = talks.select("conv_id", "path")
    return sequences, named.join(cut(digests), "path").drop("path")
