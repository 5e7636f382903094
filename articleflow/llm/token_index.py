"""Token ids in raw shard files, with a minimal perfect hash index from document key to place.

Layout of a store (``root`` is a folder that all executors see, by any path pyarrow's file systems can open):

* ``ids/*.ids``: raw ids without any framing, little-endian, 16 bits where the vocabulary fits and 32 otherwise, in
  ascending order of the key over the shards. Each shard is the output of one task.
* ``entries``: Parquet, one row per document: key, shard, row, offset, n_tokens, start.
* ``index/*.mph``: one file per hash part of the keys, layout in ``_pack_part``.

A key is looked up by hash: part, then the level bits give its slot, then one fixed-size record at that slot gives
shard, offset and length, and a stored 32-bit fingerprint tells foreign keys from known ones. The number of steps does
not depend on the number of keys.

Tasks write under names of their own, and only the names that a finished stage reports belong to the store, so lost
executors and repeated tasks leave at most unreferenced files, which are deleted once the store is complete.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.llm.common import text_slices
from articleflow.llm.encoder import vocabulary_path, worker_encoder
from articleflow.session import cut

END_ID = 2
# Slots per remaining key and level: more slots, fewer levels.
GAMMA = 2.0
# Keys of one index part at most, on average; small stores get up to SMALL_PARTS parts of MIN_KEYS keys.
PART_KEYS, SMALL_PARTS, MIN_KEYS = 1_000_000, 64, 4_096
# Neighbouring documents are read together up to this many bytes.
READ_BYTES = 8 << 20
_MAGIC = b"IDXMPH01"
_RECORD = np.dtype([("print", "<u4"), ("copies", "<u4"), ("shard", "<u4"), ("n", "<u8"), ("offset", "<u8")])


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as absolute path or URI."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


# ---- minimal perfect hash -------------------------------------------------------------------------------------------


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit bijection of ``x`` for every seed (multiply and xor-shift rounds)."""
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _names(keys: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit name per (key, copy)."""
    return _mix(keys.astype(np.int64).view(np.uint64) ^ _mix(copy.astype(np.uint64), seed + 1), seed)


@dataclass
class PerfectHash:
    """Slots 0..n-1 for n keys: a key is placed at the first level where no other remaining key meets it."""

    seed: int
    sizes: list[int]
    bits: np.ndarray
    ranks: np.ndarray

    @staticmethod
    def build(keys: np.ndarray, copy: np.ndarray) -> PerfectHash:
        seed = 1
        while True:
            left = _names(keys, copy, seed)
            if len(np.unique(left)) == len(left):
                break
            seed += 1000
        sizes, levels = [], []
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            place = (_mix(left, seed + 2 + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        return PerfectHash.of(seed, sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    @staticmethod
    def of(seed: int, sizes: list[int], bits: np.ndarray) -> PerfectHash:
        ranks = np.zeros(len(bits) + 1, dtype=np.int64)
        np.cumsum(bits, out=ranks[1:])
        return PerfectHash(seed, sizes, bits, ranks)

    def slots(self, keys: np.ndarray, copy: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level holds it. A foreign key may get a slot: compare fingerprints."""
        names = _names(keys, copy, self.seed)
        found = np.full(len(names), -1, dtype=np.int64)
        open_, base = np.arange(len(names)), 0
        for level, size in enumerate(self.sizes):
            place = base + (_mix(names[open_], self.seed + 2 + level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[place]
            found[open_[hit]] = self.ranks[place[hit]]
            open_ = open_[~hit]
            base += size
            if not len(open_):
                break
        return found

    def prints(self, keys: np.ndarray, copy: np.ndarray) -> np.ndarray:
        return (_mix(_names(keys, copy, self.seed), self.seed + 999) >> np.uint64(32)).astype(np.uint32)


def _pack_part(keys: np.ndarray, copy: np.ndarray, records: np.ndarray) -> bytes:
    """Index file: magic, seed, number of keys and levels, level sizes, packed bits, records in slot order."""
    table = PerfectHash.build(keys, copy)
    records["print"] = table.prints(keys, copy)
    ordered = np.empty(len(keys), dtype=_RECORD)
    ordered[table.slots(keys, copy)] = records
    head = struct.pack("<8sQQQ", _MAGIC, table.seed, len(keys), len(table.sizes))
    return b"".join([head, np.array(table.sizes, dtype="<u8").tobytes(),
                     np.packbits(table.bits, bitorder="little").tobytes(), ordered.tobytes()])


class Part:
    """An index file opened for lookups; records stay on disk until they are asked for."""

    def __init__(self, source: pa.NativeFile) -> None:
        magic, seed, self.keys, levels = struct.unpack("<8sQQQ", source.read_at(32, 0))
        if magic != _MAGIC:
            raise ValueError("not an index file")
        sizes = np.frombuffer(source.read_at(8 * levels, 32), dtype="<u8").astype(np.int64).tolist()
        n_bits = sum(sizes)
        raw = np.frombuffer(source.read_at(-(-n_bits // 8), 32 + 8 * levels), dtype=np.uint8)
        self.hash = PerfectHash.of(seed, sizes, np.unpackbits(raw, count=n_bits, bitorder="little").astype(bool))
        self._source, self._base = source, 32 + 8 * levels + len(raw)

    def find(self, keys: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the known keys, their records)."""
        slots = self.hash.slots(keys, copy)
        asked = np.flatnonzero(slots >= 0)
        if len(asked) == 1:
            raw = self._source.read_at(_RECORD.itemsize, self._base + _RECORD.itemsize * int(slots[asked[0]]))
            records = np.frombuffer(raw, dtype=_RECORD)
        else:
            raw = self._source.read_at(_RECORD.itemsize * self.keys, self._base)
            records = np.frombuffer(raw, dtype=_RECORD)[slots[asked]]
        same = records["print"] == self.hash.prints(keys[asked], copy[asked])
        return asked[same], records[same]


# ---- writing --------------------------------------------------------------------------------------------------------


@dataclass
class Store:
    """A written store: one line per shard and per index part is kept here, nothing per document."""

    spark: SparkSession
    root: str
    width: int
    shards: dict[int, tuple[str, int]]
    parts: list[str]
    entries: DataFrame


def _part_of(parts: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(parts)).cast("int")


def write_store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                end_id: int = END_ID) -> Store:
    """Encode all documents, append ``end_id`` to each, and write shards, entries and index below ``root``.

    Documents are ordered by key; rows with the same key by a hash of the text and the text, so a key with very many
    rows is spread over shards and the order is still defined. Null or empty text: only the end id. Rows with a null
    key come first; they are stored and found by ``keyless``, not by key. The key must be an integer column. Other
    columns are ignored; no rows give an empty store.
    """
    spark = docs.sparkSession
    where = path or vocabulary_path()
    folder = f"{root}/ids"
    files, inner = open_fs(folder)
    files.create_dir(inner, recursive=True)
    width = 2 if _largest_id(where, end_id) < 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(where)
        end = np.array([end_id], dtype="<u4").tobytes()
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        target, base = open_fs(folder)
        row = offset = 0
        out = None
        try:
            for batch in batches:
                if out is None:
                    out = target.open_output_stream(f"{base}/{name}", compression=None)
                lengths: list[int] = []
                for _, texts in text_slices(batch.column(1)):
                    found = [ids + end for ids in encoder.encode(texts)]
                    out.write(np.frombuffer(b"".join(found), dtype="<u4").astype(f"<u{width}").tobytes())
                    lengths += [len(ids) // 4 for ids in found]
                n = np.array(lengths, dtype=np.int64)
                ends = offset + np.cumsum(n)
                size = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(size, shard, np.int32)),
                     pa.array(row + np.arange(size, dtype=np.int64)), pa.array(ends - n), pa.array(n),
                     pa.array([name] * size, pa.string())],
                    ["doc_id", "shard", "row", "offset", "n_tokens", "file"],
                )
                row, offset = row + size, int(ends[-1]) if size else offset
        finally:
            if out is not None:
                out.close()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
    )
    written = cut(ordered.mapInArrow(write, "doc_id long, shard int, row long, offset long, n_tokens long, file string"))
    listed = written.groupBy("shard", "file").agg(F.sum("n_tokens").alias("ids"), F.count("*").alias("rows")).orderBy(
        "shard").collect()
    shards, bases, ids, rows = {}, [], 0, 0
    for line in listed:
        shards[line["shard"]] = (line["file"], ids)
        bases.append((line["shard"], ids, rows))
        ids, rows = ids + line["ids"], rows + line["rows"]
    known = {name for name, _ in shards.values()}
    for item in files.get_file_info(pafs.FileSelector(inner)):
        if item.base_name not in known:
            files.delete_file(item.path)
    base = F.broadcast(spark.createDataFrame(bases, "shard int, before long, rows_before long"))
    placed = written.drop("file").join(base, "shard").select(
        "doc_id", "shard", (F.col("rows_before") + F.col("row")).alias("ordinal"), "offset", "n_tokens",
        (F.col("before") + F.col("offset")).alias("start"),
    )
    # Rows of one key follow each other, so a row's copy number is its distance to the first of them.
    runs = placed.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("ordinal").alias("first"), F.count("*").alias("copies"))
    repeated = cut(runs.filter("copies > 1"))
    entries = placed.join(repeated, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("ordinal") - F.col("first"), F.lit(0)).cast("long").alias("copy"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "shard", "offset", "n_tokens", "start",
    )
    entries.write.parquet(f"{root}/entries")
    entries = spark.read.parquet(f"{root}/entries")
    return Store(spark, root, width, shards, _write_index(entries, root, rows), entries)


def _largest_id(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1)


def _write_index(entries: DataFrame, root: str, rows: int) -> list[str]:
    folder = f"{root}/index"
    files, inner = open_fs(folder)
    files.create_dir(inner, recursive=True)
    parts = max(-(-rows // PART_KEYS), min(SMALL_PARTS, -(-rows // MIN_KEYS)), 1)

    def build(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        records = np.zeros(group.num_rows, dtype=_RECORD)
        for field, column in (("copies", "copies"), ("shard", "shard"), ("n", "n_tokens"), ("offset", "offset")):
            records[field] = group[column].to_numpy()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.mph"
        target, base = open_fs(folder)
        with target.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(_pack_part(group["doc_id"].to_numpy(), group["copy"].to_numpy(), records))
        return pa.table({"part": pa.array([part], pa.int32()), "file": [name]})

    keyed = entries.filter("doc_id is not null").withColumn("part", _part_of(parts)).drop("start")
    done = {r["part"]: r["file"] for r in cut(keyed.groupBy("part").applyInArrow(build, "part int, file string")).collect()}
    for item in files.get_file_info(pafs.FileSelector(inner)):
        if item.base_name not in done.values():
            files.delete_file(item.path)
    return [done.get(part, "") for part in range(parts)]


# ---- reading --------------------------------------------------------------------------------------------------------

_PLACE = "doc_id long, copy long, copies long, shard int, offset long, n_tokens long"


def locate(store: Store, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Places of the given keys by index: (doc_id, copy, copies, shard, offset, n_tokens).

    Keys that the store does not hold, and null, give no row; a key with several documents gives one row each. Keys
    travel once, to the tasks of their index parts.
    """
    folder, parts = f"{store.root}/index", store.parts

    def find(group: pa.Table) -> pa.Table:
        name = parts[group["part"][0].as_py()]
        key, copy = group["doc_id"].to_numpy(), group["copy"].to_numpy()
        if name:
            target, base = open_fs(folder)
            with target.open_input_file(f"{base}/{name}") as source:
                known, records = Part(source).find(key, copy)
        else:
            known, records = np.zeros(0, np.int64), np.zeros(0, _RECORD)
        return pa.table({
            "doc_id": pa.array(key[known]), "copy": pa.array(copy[known]),
            "copies": pa.array(records["copies"].astype(np.int64)), "shard": pa.array(records["shard"].astype(np.int32)),
            "offset": pa.array(records["offset"].astype(np.int64)), "n_tokens": pa.array(records["n"].astype(np.int64)),
        })

    def search(asked: DataFrame) -> DataFrame:
        return cut(asked.withColumn("part", _part_of(len(parts))).groupBy("part").applyInArrow(find, _PLACE))

    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    first = search(wanted.withColumn("copy", F.lit(0).cast("long")))
    several = first.filter("copies > 1")
    if several.isEmpty():
        return first
    further = several.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1)).alias("copy"))
    return first.unionByName(search(further))


def keyless(store: Store) -> DataFrame:
    """Places of the documents without a key, from the entries."""
    return store.entries.filter("doc_id is null").select("doc_id", "copy", "copies", "shard", "offset", "n_tokens")


def payloads(store: Store, places: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) read from the shard files; ``ids`` as little-endian unsigned 32-bit bytes.

    Places are sorted by shard and offset, so that neighbours are fetched with one read.
    """
    folder, shards, width = f"{store.root}/ids", store.shards, store.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = open_fs(folder)
        number, source = None, None
        for batch in batches:
            shard, offset, n = (batch.column(i).to_pylist() for i in (1, 2, 3))
            start = 0
            while start < batch.num_rows:
                stop, end = start + 1, offset[start] + n[start]
                while (stop < batch.num_rows and shard[stop] == shard[start] and offset[stop] == end
                       and (end - offset[start]) * width < READ_BYTES):
                    end += n[stop]
                    stop += 1
                if shard[start] != number:
                    if source is not None:
                        source.close()
                    number = shard[start]
                    source = target.open_input_file(f"{base}/{shards[number][0]}")
                raw = source.read_at((end - offset[start]) * width, offset[start] * width)
                wide = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4").tobytes()
                cuts = [4 * (offset[i] - offset[start]) for i in range(start, stop)] + [len(wide)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start),
                     pa.array([shards[number][1] + offset[i] for i in range(start, stop)], pa.int64()),
                     batch.column(3).slice(start, stop - start),
                     pa.array([wide[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                start = stop
        if source is not None:
            source.close()

    ordered = places.select("doc_id", "shard", "offset", "n_tokens").repartitionByRange("shard", "offset")
    return ordered.sortWithinPartitions("shard", "offset").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")


def digest(store: Store, places: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents at the given places."""
    return payloads(store, places).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def get(store: Store, key: int) -> list[np.ndarray]:
    """Ids of the documents of one key, by index and direct reads, without a Spark job."""
    def place(copy: int):
        name = store.parts[_driver_part(store, key, copy)]
        if not name:
            return None
        target, base = open_fs(f"{store.root}/index")
        with target.open_input_file(f"{base}/{name}") as source:
            known, records = Part(source).find(np.array([key], np.int64), np.array([copy], np.int64))
        return records[0] if len(known) else None

    first = place(0)
    if first is None:
        return []
    found = [first] + [place(copy) for copy in range(1, int(first["copies"]))]
    target, base = open_fs(f"{store.root}/ids")
    out = []
    for record in found:
        with target.open_input_file(f"{base}/{store.shards[int(record['shard'])][0]}") as source:
            raw = source.read_at(int(record["n"]) * store.width, int(record["offset"]) * store.width)
        out.append(np.frombuffer(raw, dtype=f"<u{store.width}"))
    return out


def _driver_part(store: Store, key: int, copy: int) -> int:
    """The part that ``_part_of`` gives, evaluated by Spark itself on one row held in the plan."""
    row = store.spark.range(1).select(
        F.pmod(F.xxhash64(F.lit(key).cast("long"), F.lit(copy).cast("long")), F.lit(len(store.parts))).alias("p"))
    return int(row.first()["p"])


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
