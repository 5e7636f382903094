"""Ranked lexical search over documents that share their bag of words with many others.

Only an item's own words can change a document's score, so a document is first restricted to the vocabulary of all
items: its bag is the sorted list of those words with their numbers of occurrences. Together with the length measure m
the bag decides every score. The steps:

1. one pass over the documents writes each one's term count and bag; sums over that table give N, L and the df;
2. documents are dealt by a hash of (bag, m), and those whose bag and m are equal in full form a class;
3. each class is scored once, for all items, inside the tasks; a task hands on its best classes of each item. Classes
   are ordered by score and then by their smallest document, so the classes of the k best documents are among the k
   best classes;
4. the winning classes are expanded to their members by ascending document, and an item's k best documents remain.

Items whose words exceed a measured number of bytes are searched in blocks, each like the whole.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.llm.common import bounded_side
from articleflow.operators.joins import first_per_key
from articleflow.session import cut

TOP = 20
# Words of the items of one block, as bytes; they and their lists are sent to every task.
ITEM_BYTES = 16 << 20
# Documents handled by one step inside a task; cells of one item x class score block, and of what is added up in it.
_ROWS, _CELLS = 1_000, 1_000_000
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _byte_table() -> bytes:
    """A-Z to a-z; other ASCII characters that are no digit or letter to a space; the rest, non-ASCII included, stays."""
    table = bytearray(range(256))
    for code in range(128):
        char = chr(code)
        table[code] = ord(char.lower()) if char.isalnum() else 0x20
    return bytes(table)


def terms(text: str | None, table: bytes = _byte_table()) -> list[bytes]:
    """Terms of a whole text as UTF-8 bytes, in order; null has none."""
    return (text or "").encode("utf-8").translate(table).split()


def _blocks(items: DataFrame, max_bytes: int) -> list[DataFrame]:
    """The distinct items in hash blocks of at most about ``max_bytes``."""
    size = items.agg(F.sum(F.lit(64) + F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    if blocks == 1:
        return [items]
    spot = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.filter(spot == i) for i in range(blocks)]


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, codes, tfs) of every document with at least one term; codes ascend and may be empty."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = {word: code for code, word in enumerate(shared.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                kept, n, codes, tfs = [], [], [], []
                for row, text in enumerate(part.column(1)):
                    words = terms(text.as_py())
                    if not words:
                        continue
                    found = sorted((code_of[word], tf) for word, tf in Counter(words).items() if word in code_of)
                    kept.append(row)
                    n.append(len(words))
                    codes.append([code for code, _ in found])
                    tfs.append([tf for _, tf in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()),
                     pa.array(codes, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                    ["doc_id", "n", "codes", "tfs"],
                )

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n", T.LongType()),
        T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType())),
    ])
    return docs.mapInArrow(restrict, schema)


def _weights(bags: DataFrame, words: int, n_docs: int) -> np.ndarray:
    """Weight of every vocabulary word from its number of documents."""
    df = np.zeros(words, dtype=np.int64)
    # One row per word of the block's vocabulary.
    for row in bags.select(F.explode("codes").alias("code")).groupBy("code").count().toLocalIterator():
        df[row["code"]] = row["count"]
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class _Leaders:
    """The k best classes of every item inside one task: higher score first, then the smaller first document."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.bar = np.ones(items, dtype=np.int64)
        self.hits: list[list[tuple]] = [[] for _ in range(items)]

    def offer(self, scores: np.ndarray, firsts: list, rows: list) -> None:
        """``scores`` is items x classes, ``rows`` stands for the classes. A score below the bar cannot be among the k."""
        if scores.shape[1] > self.k:
            cut_off = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            bar = np.maximum(self.bar, cut_off)
        else:
            bar = self.bar
        passed = scores >= bar[:, None]
        for item in np.flatnonzero(passed.any(axis=1)):
            found = [(-int(scores[item, c]), firsts[c] is None, firsts[c], rows[c]) for c in np.flatnonzero(passed[item])]
            order = lambda hit: (hit[0], hit[1], 0 if hit[1] else hit[2])
            best = heapq.nsmallest(self.k, self.hits[item] + found, key=order)
            self.hits[item] = best
            if len(best) == self.k:
                self.bar[item] = max(1, -best[-1][0])


def _winners(classes: DataFrame, postings: tuple[np.ndarray, np.ndarray, np.ndarray], weights: np.ndarray,
             n_items: int, k: int) -> DataFrame:
    """The best classes of every item: (item, score, first, spot, codes, tfs, m)."""
    shared = classes.sparkSession.sparkContext.broadcast((*postings, weights))

    def steps(fan: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of classes whose words stand in at most ``_CELLS`` places of the items' lists, one class at least."""
        until, start, most = np.append(0, np.cumsum(fan)), 0, max(1, _CELLS // n_items)
        while start < len(fan):
            stop = int(np.searchsorted(until, until[start] + _CELLS, side="right")) - 1
            stop = min(max(stop, start + 1), start + most)
            yield start, stop
            start = stop

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, users, times, weight = shared.value
        width = np.diff(offsets)
        leaders = _Leaders(n_items, k)
        for batch in batches:
            ends = np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy()))
            placed = np.append(0, np.cumsum(width[batch.column(2).flatten().to_numpy()]))
            for start, stop in steps(np.diff(placed[ends])):
                part = batch.slice(start, stop - start)
                size = part.num_rows
                lists, tf = part.column(2), part.column(3).flatten().to_numpy()
                code = lists.flatten().to_numpy()
                row = np.repeat(np.arange(size), lists.value_lengths().to_numpy())
                m = part.column(4).to_numpy()
                gain = weight[code] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                # Every item that holds the word gets the gain, once for each time it holds it.
                fan = width[code]
                cell = np.repeat(np.arange(len(code)), fan)
                nth = np.arange(len(cell)) - np.repeat(np.cumsum(fan) - fan, fan)
                use = offsets[code[cell]] + nth
                scores = np.zeros(n_items * size, dtype=np.int64)
                np.add.at(scores, users[use] * size + row[cell], gain[cell] * times[use])
                at = [(part, i) for i in range(size)]
                leaders.offer(scores.reshape(n_items, size), part.column(0).to_pylist(), at)
        flat = [(item, -hit[0], hit[3]) for item, hits in enumerate(leaders.hits) for hit in hits]
        if flat:
            of_class = [pa.concat_arrays([part.column(c).slice(i, 1) for _, _, (part, i) in flat]) for c in range(5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.int64()), *of_class],
                ["item", "score", "first", "spot", "codes", "tfs", "m"],
            )

    listed = classes.select("first", "spot", "codes", "tfs", "m")
    schema = T.StructType([
        T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), *listed.schema.fields])
    return listed.mapInArrow(score, schema)


def _search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    listed = items.toArrow()
    per_item = [Counter(terms(text)) for text in listed["text"].to_pylist()]
    vocabulary = sorted(set().union(*per_item))
    code_of = {word: code for code, word in enumerate(vocabulary)}
    uses = sorted((code_of[word], item, n) for item, words in enumerate(per_item) for word, n in words.items())
    codes, users, times = (np.array([use[i] for use in uses], dtype=np.int64) for i in range(3))
    offsets = np.searchsorted(codes, np.arange(len(vocabulary) + 1))

    # 1. Bags of all documents, and what is counted over them.
    bags = cut(_bags(docs, vocabulary))
    n_docs, n_terms = bags.agg(F.count("*"), F.sum("n")).first()
    result = T.StructType([
        items.schema["item_id"], T.StructField("rank", T.IntegerType()), docs.schema["doc_id"],
        T.StructField("score", T.LongType())])
    if not n_docs or not vocabulary:
        return spark.createDataFrame([], result)
    weights = _weights(bags, len(vocabulary), n_docs)

    # 2. Classes. Decimals, so that 25 n N cannot overflow.
    product = (F.lit(25) * F.col("n")).cast("decimal(19,0)") * F.lit(n_docs).cast("decimal(19,0)")
    share = F.floor((product - product % F.lit(n_terms)) / F.lit(n_terms)).cast("long")
    known = bags.filter(F.size("codes") > 0).withColumn("m", F.lit(75) + share)
    known = known.withColumn("spot", F.xxhash64("codes", "tfs", "m")).select("doc_id", "spot", "codes", "tfs", "m")
    same = ["spot", "codes", "tfs", "m"]
    classes = known.groupBy(*same).agg(F.min("doc_id").alias("first"))

    # 3. The best classes.
    won = cut(_winners(classes, (offsets, users, times), weights, len(per_item), k))
    won = first_per_key(won, ["item"], [F.col("score").desc(), F.col("first").asc_nulls_last()], k)
    won = cut(won)

    # 4. Their members; a class needs no more than its k smallest documents.
    wanted = won.select(*same).distinct()
    bag_bytes = won.agg(F.max(F.lit(64) + 12 * F.size("codes"))).first()[0] or 0
    members = known.join(bounded_side(cut(wanted), bag_bytes), same, "left_semi")
    members = first_per_key(members, same, [F.col("doc_id").asc_nulls_last()], k)
    hits = won.select("item", "score", *same).join(bounded_side(cut(members), bag_bytes + 16), same)
    best = first_per_key(hits, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, "rank")
    ids = pa.table({"item": pa.array(range(len(per_item)), pa.int32()), "item_id": listed["item_id"].combine_chunks()})
    names = spark.createDataFrame(ids, T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", k: int = TOP,
                  max_item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: (item_id, rank, doc_id, score).

    Terms are runs of ASCII digits and letters and of all characters outside ASCII, A-Z lower-cased, over whole texts.
    A null or empty text has none: such a document counts nowhere, such an item finds nothing. Every row of ``docs``
    is a document of its own, repeated rows included; a null identifier comes after all others. Equal scores are
    ordered by ascending identifier. Rows of ``items`` that agree in identifier and text count once; other rows with
    one identifier are searched each for itself, and null is an identifier like any other. Other columns are ignored.
    Without documents or items the result is empty.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = cut(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct())
    blocks = _blocks(asked, max_item_bytes)
    found = _search(named, blocks[0], k)
    for block in blocks[1:]:
        found = found.unionByName(_search(named, block, k))
    return found
