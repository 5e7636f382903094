"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

Sketch (t coordinates): in round i = 0..t-1 every shingle of a set falls by a hash of its own into one of the t
coordinates; in round t+i every shingle falls into coordinate i. A coordinate keeps the smallest (round, hash), and
rounds stop once all coordinates are filled, so none stays empty, even for a single shingle. Two sets agree in a
coordinate with probability equal to their Jaccard similarity, with the concentration of t draws.

Groups are found without pairing bucket members:

1. documents with equal shingle sets form one class, which goes on alone;
2. a class enters one bucket per band of coordinates; buckets with one class are dropped;
3. every bucket has a hub, the member that meets most others over all its buckets, and the others are verified
   against it on full sets;
4. verified links give components; a bucket whose members all share one needs no more work;
5. in the remaining buckets, members of different components are compared by sketch, in blocks, each pair in the
   first band where it meets; inside the task, pairs that could reach the threshold are verified on full sets, the
   likeliest first, and a pair that verified ones have joined meanwhile needs no more. Only links leave the task, and
   components are final.

So each pair that meets in a bucket and could be linked is either verified or already joined by other links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import BROADCAST_BYTES, bounded_side, fresh, gives_back, text_slices
from articleflow.llm.components import components
from articleflow.operators.joins import first_per_key, salted_join
from articleflow.session import cut

# 32 bands of 4 coordinates: a pair at similarity 0.8 misses all bands with probability 5e-8.
BANDS, ROWS = 32, 4
SKETCH = BANDS * ROWS
# Sketches that agree in fewer coordinates are no link: 4.5 standard deviations below the mean at 0.8.
SLACK = 4.5
# Members of one block when a bucket's members are compared by sketch.
BLOCK = 256


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1F83D9ABFB41BD6B) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct ``size``-word shingles.

    A-Z is lower-cased; words are runs of characters other than ASCII white space. A text of fewer words gives its
    whole word sequence as one shingle, a text without words the empty set.
    """
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(size, len(found))
    count = len(found) - size + 1
    joined = np.full(count, size, dtype=np.uint64)
    for k in range(size):
        joined = _mix(joined * np.uint64(0x9DDFEA08EB382D69) ^ hashes[k:k + count], 7)
    return np.unique(joined)


def sketches(sets: list[np.ndarray], t: int = SKETCH) -> np.ndarray:
    """Fast similarity sketches (one row of ``t`` 16-bit coordinates per set); zeros for an empty set."""
    n = len(sets)
    values = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), lengths)
    for i in range(2 * t):
        if not len(items):
            break
        h = _mix(items, i + 11)
        place = (h % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(values, owner * t + place, (np.uint64(i) << np.uint64(48)) | (_mix(h, 5) >> np.uint64(16)))
        full = (values.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
        open_ = ~full[owner]
        items, owner = items[open_], owner[open_]
    out = (_mix(values, 3) >> np.uint64(48)).astype(np.uint16).reshape(n, t)
    out[lengths == 0] = 0
    return out


def _signed(docs: DataFrame, size: int, id_type: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch); the key is a 128-bit hash of the set, null for an empty one."""

    @gives_back
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                sets = [shingle_set(text, size) for text in texts]
                rows = sketches(sets)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array([row.astype("<u2").tobytes() for row in rows], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "sketch"],
                )

    return docs.mapInArrow(sign, f"doc_id {id_type}, n_shingles long, set_key binary, sketch binary")


def _full_sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(cls, shingles) of the needed classes (cls, rep, set_key), made anew from their first documents' texts."""

    @gives_back
    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, texts in text_slices(batch.column(2)):
                rows, sets = [], []
                for nth, text in enumerate(texts, start):
                    found = shingle_set(text, size)
                    if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == keys[nth]:
                        rows.append(nth)
                        sets.append(found)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(rows, pa.int64())),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cls", "shingles"])

    asked = bounded_side(needed.select(F.col("rep").alias("doc_id"), "cls", "set_key"), 64)
    texts = docs.join(asked, "doc_id").select("set_key", "cls", "text")
    # Repeated rows would give a class twice.
    return cut(texts.mapInArrow(rebuild, "cls long, shingles array<long>").dropDuplicates(["cls"]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 x intersection >= percent x union on full sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    total = F.size("sa") + F.size("sb")
    # Sets this different in size cannot be linked, whatever they share.
    bound = 100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))
    return cut(sized.filter(F.when(bound, 100 * shared >= percent * (total - shared)).otherwise(False)).select("a", "b"))


def _links_in_rest(members: DataFrame, sketched: DataFrame, sets: DataFrame, least: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, as many as join what can be joined.

    Members of a bucket are dealt to blocks, and every two blocks are compared in one task. A pair is looked at in the
    first band where it meets, and verified on full sets if its sketches agree in at least ``least`` coordinates.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sketched.select("cls", "n_shingles", "sketch"), "cls").join(sets, "cls")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                         "own", "cls", "comp", "n_shingles", "sketch", "shingles")

    def link(group: pa.Table) -> pa.Table:
        band, lo, hi = (group[c][0].as_py() for c in ("band", "lo", "hi"))
        own, cls, comp, n = (group[c].to_numpy() for c in ("own", "cls", "comp", "n_shingles"))
        rows = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype="<u2").reshape(-1, SKETCH)
        full = group["shingles"].combine_chunks()
        ends, flat = full.offsets.to_numpy(), full.values.to_numpy()
        pairs: list[np.ndarray] = []
        for i in np.flatnonzero(own == lo):
            others = np.flatnonzero(own == hi)
            if lo == hi:
                others = others[others > i]
            others = others[(comp[others] != comp[i])
                            & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            if not len(others):
                continue
            equal = rows[others] == rows[i]
            agreed = equal.sum(axis=1)
            met = (agreed >= least) & ~equal.reshape(-1, BANDS, ROWS).all(axis=2)[:, :band].any(axis=1)
            pairs.append(np.stack([np.full(met.sum(), i), others[met], agreed[met]], axis=1))
        above: dict[int, int] = {}

        def root(name: int) -> int:
            while name in above:
                name = above[name]
            return name

        found = []
        every = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        for i, j, _ in every[np.argsort(-every[:, 2], kind="stable")].tolist():
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a == b:
                continue
            shared = len(np.intersect1d(flat[ends[i]:ends[i + 1]], flat[ends[j]:ends[j + 1]], assume_unique=True))
            if 100 * shared >= percent * (int(n[i]) + int(n[j]) - shared):
                above[max(a, b)] = min(a, b)
                found.append((int(comp[i]), int(comp[j])))
        left, right = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return cut(dealt.groupBy("band", "bucket", "lo", "hi").applyInArrow(link, "a long, b long"))


def near_dup_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                        percent: int = 80) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Documents are linked if their sets of ``size``-word shingles have 100 x intersection >= ``percent`` x union;
    ``component_id`` is the smallest id reachable over links, the own id included; ``kept`` marks the documents whose
    id it is. Null, empty or wordless text: an empty set, linked with nothing. A row without id is linked with
    nothing, its component is null and it is kept. Rows with one id are one document with several texts; repeated rows
    get equal results. Other columns are ignored; no rows give no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(_signed(narrow, size, id_type))
    groups = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key", "n_shingles")
    classes = cut(groups.agg(F.min("doc_id").alias("rep")).withColumn("cls", F.monotonically_increasing_id()))

    # Buckets of classes.
    first = signed.join(classes.drop("n_shingles"), (signed["doc_id"] == classes["rep"]) & (
        signed["set_key"] == classes["set_key"])).select("cls", "n_shingles", "sketch")
    sketched = cut(first.dropDuplicates(["cls"]))
    bands = F.array(*[
        F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * ROWS * i, 2 * ROWS)).alias(
            "bucket")) for i in range(BANDS)])
    slots = sketched.select("cls", F.explode(bands).alias("slot")).select("cls", "slot.band", "slot.bucket")
    sizes = slots.groupBy("band", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(salted_join(slots, sizes, ["band", "bucket"], ["cls"]))

    # Every bucket's hub against the other members.
    weight = shared.groupBy("cls").agg(F.sum("size").alias("weight"))
    weighed = cut(shared.join(weight, "cls"))
    hubs = weighed.groupBy("band", "bucket").agg(
        F.max(F.struct("weight", (-F.col("cls")).alias("minus"))).alias("top")).select(
        "band", "bucket", (-F.col("top.minus")).alias("hub"))
    stars = salted_join(weighed, hubs, ["band", "bucket"], ["cls"]).filter("cls <> hub")
    pairs = cut(stars.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct())
    used = shared.select("cls").distinct()
    sets = _full_sets(narrow, cut(used.join(classes, "cls").select("cls", "rep", "set_key")), size)
    links = _verified(pairs, sets, percent)
    found = components(links)

    # Buckets that still hold several components.
    labelled = cut(shared.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "comp", F.coalesce("component", "cls")).drop("component"))
    mixed = labelled.groupBy("band", "bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter(
        "low <> high").select("band", "bucket", F.lit(True).alias("mixed"))
    rest = salted_join(labelled, mixed, ["band", "bucket"], ["cls"]).drop("mixed")
    share = percent / 100
    least = int(np.floor(SKETCH * share - SLACK * np.sqrt(SKETCH * share * (1 - share))))
    more = _links_in_rest(rest, sketched, sets, least, percent)
    if not more.isEmpty():
        # A component is named after one of its classes, so that its links are links of classes too.
        links = links.unionByName(more)
        joined = components(more).select(F.col("node").alias("comp"), F.col("component").alias("joined"))
        names = labelled.select("cls", "comp").distinct().join(joined, "comp", "left")
        found = cut(names.select(F.col("cls").alias("node"), F.coalesce("joined", "comp").alias("component")))

    # Back to documents: the smallest id of all classes of a component. Rows with one id are one document.
    twins = signed.filter("set_key is not null and doc_id is not null").join(classes.select("set_key", "cls"), "set_key")
    names = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "comp", F.coalesce("component", "cls"))
    several = twins.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b")
    several = cut(several)
    if not several.isEmpty():
        same = twins.join(several.select("doc_id", F.col("a").alias("low")), "doc_id").filter("cls <> low")
        every = links.unionByName(same.select(F.col("low").alias("a"), F.col("cls").alias("b")))
        names = classes.join(components(cut(every)).withColumnRenamed("node", "cls"), "cls", "left").withColumn(
            "comp", F.coalesce("component", "cls"))
    smallest = names.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_set = cut(names.join(smallest, "comp").select("set_key", "component_id"))
    rows = signed.select("doc_id", "n_shingles", "set_key")
    linked = rows.filter("set_key is not null").join(by_set, "set_key", "left").unionByName(
        rows.filter("set_key is null").withColumn("component_id", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return linked.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                   percent: int = 80) -> DataFrame:
    """``docs`` with one document per near-duplicate group, its row with the smallest id; columns stay.

    Of several rows with one id, the one whose text has the smallest hash stays. Rows without id all stay.
    """
    gone = near_dup_components(docs, id_col, text_col, size, percent).filter("not kept").select(
        F.col("doc_id").alias("_gone")).distinct()
    gone = cut(gone)
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    left = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    repeated = cut(left.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col))
    if repeated.isEmpty():
        return left
    several = left.join(F.broadcast(repeated) if repeated.count() * 16 <= BROADCAST_BYTES else repeated, id_col,
                        "left_semi")
    (order,) = fresh(docs, "_order")
    once = first_per_key(several.withColumn(order, F.xxhash64(text_col)), [id_col], [F.col(order)]).drop(order)
    single = left.filter(F.col(id_col).isNull()).unionByName(
        left.filter(F.col(id_col).isNotNull()).join(repeated, id_col, "left_anti"))
    return single.unionByName(once.select(*docs.columns))
