"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of consecutive words, a window into shingles of a few words. A document can hold
a window only if it holds all its shingles, so one shingle is a sufficient prefix; the one that is rarest over all
documents is taken. The steps:

1. one pass over the documents keeps the places of the benchmark's shingles (compared as words, not only as hashes);
2. shingles are ordered by how often they were found, and each window's rarest one becomes its prefix;
3. places of prefix shingles give candidate windows, subject to the bounds of position and length;
4. a candidate is verified exactly: the shingles that together cover the window must stand at their places;
5. the verified windows of a document are united to the words that are hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import BROADCAST_BYTES
from articleflow.session import cut

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of digits, a-z and characters outside ASCII. Null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _GAPS), "")


def word_count(text: Column) -> Column:
    """Number of ``words``, without the cost of lower-casing."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _RAW_GAPS), "")).cast("long")


def windows(items: DataFrame, id_col: str, text_col: str, size: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, words) per window: ``size`` consecutive words, or all words of a shorter item that has any."""
    listed = cut(items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("all")))
    last = F.greatest(F.size("all") - size, F.lit(0))
    starts = listed.filter(F.size("all") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), last)))
    return starts.select("item_id", F.slice("all", F.col("at") + 1, size).alias("words"))


def _shingles(listed: Column, width: int) -> Column:
    """Hashes of the ``width``-word shingles in order; null where there is none. The words are evaluated once."""
    def hashed(found: Column) -> Column:
        starts = F.when(F.size(found) >= width, F.sequence(F.lit(0), F.size(found) - width))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(width)]))

    return F.get(F.transform(F.array(listed), hashed), F.lit(0))


def _cover(length: Column, width: int) -> Column:
    """Offsets of the fewest shingles that cover a window: every ``width``-th one and the last."""
    last = length - width
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(width)), F.array(last)))


def _union_length(spans: Column) -> Column:
    """Words covered by a sorted array of (start, length) spans."""
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, span: Column) -> Column:
        end = F.greatest(acc["end"], span["start"] + span["length"])
        return F.struct(
            end.alias("end"), (acc["total"] + end - F.greatest(acc["end"], F.least(span["start"], end))).alias("total"))

    return F.aggregate(spans, state, step, lambda acc: acc["total"])


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS,
                   width: int = SHINGLE_WORDS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: (doc_id, text_hash, n_words, n_hit, items), ``items`` the sorted ids of occurring items.

    Rows are matched to their documents by (id, hash of the text): repeated rows each get the same result, null ids
    are an id of their own, and rows with one id and different texts are told apart. Null or empty text has no words.
    Items with null id hit words but are not listed. Other columns are ignored. Without items nothing is hit.

    The shingles of the benchmark are sent to every task while they stay below ``max_bytes``; beyond that, shingles
    of documents are shuffled to them.
    """
    spark = docs.sparkSession
    named = windows(items, item_id, item_text, size)
    named = cut(named.withColumn("window", F.monotonically_increasing_id()).withColumn("length", F.size("words")))
    shortest = named.agg(F.min("length")).first()[0]
    key = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    counted = key.select("doc_id", "text_hash", word_count(F.col("text")).alias("n_words"))
    if shortest is None:
        none = F.array().cast("array<string>")
        return counted.select("*", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    width = min(width, shortest)

    placed = named.select("window", F.posexplode(_shingles(F.col("words"), width)).alias("at", "hash"), "words")
    placed = placed.withColumn("gram", F.slice("words", F.col("at") + 1, width)).drop("words")
    grams = cut(placed.select("hash", "gram").distinct().withColumn("gram_id", F.monotonically_increasing_id()))
    placed = cut(placed.join(grams, ["hash", "gram"]).select("window", "at", "gram_id"))

    # 1. Places of benchmark shingles. explode_outer, so that no filter on the array is moved below its evaluation.
    listed = key.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    spread = listed.select("doc_id", "text_hash", "words", F.posexplode_outer(_shingles(F.col("words"), width)).alias(
        "place", "hash"))
    here = F.slice("words", F.col("place") + 1, width)
    size_bytes = grams.agg(F.sum(64 + F.octet_length(F.concat_ws(" ", "gram")))).first()[0]
    if size_bytes <= max_bytes:
        found = spread.join(F.broadcast(grams), "hash").filter(here == F.col("gram"))
        found = found.select("doc_id", "text_hash", "place", "gram_id", F.size("words").alias("n"))
    else:
        found = spread.filter("hash is not null").select(
            "doc_id", "text_hash", "place", "hash", here.alias("gram"), F.size("words").alias("n"))
        found = found.join(grams, ["hash", "gram"]).select("doc_id", "text_hash", "place", "gram_id", "n")
    found = cut(found)

    # 2. The rarest shingle of each window; a window with a shingle that was nowhere found cannot occur.
    often = found.groupBy("gram_id").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "at", "gram_id")
    prefix = placed.join(often, "gram_id", "left").groupBy("window").agg(F.min(rarity).alias("rare"))
    prefix = prefix.filter("rare.count > 0").join(named.select("window", "length"), "window").select(
        "window", F.col("rare.gram_id").alias("gram_id"), F.col("rare.at").alias("at"), "length")
    prefix = cut(prefix)

    # 3. Candidates within the bounds of position and length.
    candidates = found.join(prefix, "gram_id").select(
        "doc_id", "text_hash", "window", "length", "n", (F.col("place") - F.col("at")).alias("start"),
    ).filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))).drop("n")

    # 4. Every covering shingle must stand at its place. Repeated rows find theirs more than once, hence the set.
    covering = candidates.withColumn("at", F.explode(_cover(F.col("length"), width)))
    needed = covering.join(placed, ["window", "at"]).withColumn("place", F.col("start") + F.col("at"))
    a, b = needed.alias("a"), found.select("doc_id", "text_hash", "place", "gram_id").alias("b")
    met = a.join(
        b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))
        & (F.col("a.place") == F.col("b.place")) & (F.col("a.gram_id") == F.col("b.gram_id")), "left_semi")
    verified = met.groupBy("doc_id", "text_hash", "window", "length", "start").agg(
        F.size(F.collect_set("at")).alias("met")).filter(F.col("met") == F.size(_cover(F.col("length"), width)))

    # 5. Per document: the words under any window, and the items.
    per_doc = verified.join(named.select("window", "item_id"), "window").groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct(
            F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")))).alias("spans"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    ).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
             _union_length(F.col("spans")).alias("n_hit"), "items")
    per_doc = cut(per_doc)
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    return counted.join(per_doc, same, "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """At least one word is hit, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def digest(hits: DataFrame) -> DataFrame:
    """Hits with the number of items and the SHA-256 of their comma-joined ids."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = cut(benchmark_hits(docs, items, id_col, text_col, **options).filter(contaminated()).select(
        F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct())
    if bad.count() * 16 <= BROADCAST_BYTES:
        bad = F.broadcast(bad)
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(bad["_bad_id"]) & (text_hash == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")
