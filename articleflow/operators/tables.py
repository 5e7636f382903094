"""Article and chunk tables: insert-if-absent, upsert, recency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from articleflow.functions import text as X
from articleflow.operators import keyfilter
from articleflow.operators.joins import first_per_key, small_side
from articleflow.session import cut


def keep_first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First record per key in the given order (ties must be broken by the last order column)."""
    return first_per_key(df, [key], [F.col(c).asc() for c in order])


def exact_url_dedup(articles: DataFrame, order: list[str]) -> DataFrame:
    """Same link, same article id, one article: the first in ``order``, which must tell the rows of a link apart.

    Only links that occur more than once are ranked, by identifier and order columns; all other rows, and the texts of
    these, stay where they are.
    """
    named = articles.withColumn("article_id", X.url_uuid(F.col("url")))
    place = F.struct(*order)
    firsts = named.groupBy("article_id").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    repeated = small_side(cut(firsts.filter("_n > 1").select("article_id", "_first")))
    marked = named.join(repeated, "article_id", "left")
    # Only rows that share a link and its first place are left to be ranked.
    chosen = keep_first_by_key(marked.filter(F.col("_first") == place), "article_id", order)
    return marked.filter(F.col("_first").isNull()).unionByName(chosen).drop("_first")


def _first_per_repeated_key(batch: DataFrame, key: str, order: list[Column], *columns: str) -> tuple[DataFrame, DataFrame]:
    """(first row of every key, its ``key`` and ``columns`` as a written table).

    Repeats are found by hashes of the keys: only rows whose key comes again are shuffled and ranked, and a batch
    without repeats is not written. It must give the same keys each time it is computed.
    """
    hashed, narrow = F.xxhash64(F.col(key)), list(dict.fromkeys([key, *columns]))
    keys = cut(batch.select(*narrow))
    repeated = cut(keys.groupBy(hashed.alias("_hash")).count().filter("count > 1").select("_hash"))
    if repeated.isEmpty():
        return batch, keys
    marked, asked = cut(batch.withColumn("_hash", hashed)), small_side(repeated)
    chosen = first_per_key(marked.join(asked, "_hash", "left_semi"), [key], order)
    fresh = marked.join(asked, "_hash", "left_anti").unionByName(chosen).drop("_hash")
    return fresh, cut(fresh.select(*narrow))


def absent_rows(batch: DataFrame, target: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``batch`` to append: first per key, and the key not in ``target`` yet.

    Only the key column of the target is read. It is first reduced to the batch's keys, which are broadcast while
    they are few, so that the table is scanned but not shuffled.
    """
    return _not_stored(cut(keep_first_by_key(batch, key, order)), target, key)


def _not_stored(fresh: DataFrame, target: DataFrame, key: str) -> DataFrame:
    taken = target.select(key).join(small_side(fresh.select(key)), key, "left_semi")
    return fresh.join(taken, key, "left_anti")


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after the insert; existing rows stay as they are."""
    return target.unionByName(absent_rows(batch, target, key, order))


def upsert(batch: DataFrame, target: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The table after insert-or-replace; within the batch the first row in ``order`` wins."""
    fresh = first_per_key(batch, [key], order)
    return target.join(small_side(fresh.select(key)), key, "left_anti").unionByName(fresh)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one of that layout before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def drop_partitions_before(spark: SparkSession, path: str, column: str, day: str) -> list[str]:
    """Delete the day partitions (``column=YYYY-MM-DD``) of a table that lie before ``day``; their days.

    Partitions are listed, not scanned. Deleting them again, as a replay does, changes nothing.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [status.getPath().getName() for status in files.listStatus(root) if status.isDirectory()]
    days = sorted(name.split("=", 1)[1] for name in names if name.startswith(f"{column}="))
    gone = [found for found in days if found < day and found[:1].isdigit()]
    for found in gone:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{column}={found}"), True)
    return gone


def replace_batch(batch: DataFrame, path: str, batch_id: int, run: str = "run") -> None:
    """Write the rows of one micro-batch as its own partition (``run``, ``batch_id``): a replay overwrites only itself."""
    (
        batch.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")})
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch_id").parquet(path)
    )


def append_absent(batch: DataFrame, path: str, key: str, order: list[str], batch_id: int, run: str = "run") -> None:
    """Insert-if-absent into a Parquet table partitioned by ``run`` and ``batch_id``; the first write of a key stays.

    ``run`` names the stream that counts the batches: another one, as after a fresh checkpoint, starts at 0 again. A
    replayed batch ignores only what it wrote itself and overwrites that, so the outcome is the same. Of the table only
    partitions whose key filter lets one of the batch's keys pass are read, and of those only the key column.
    """
    spark = batch.sparkSession
    fresh, keys = _first_per_repeated_key(batch, key, [F.col(c).asc() for c in order])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields) + ", run string, batch_id bigint"
    own = (F.col("run") == run) & (F.col("batch_id") == batch_id)
    target = read_or_empty(spark, path, schema).filter(~own)
    wanted = keyfilter.partitions_to_read(keys, key, path)
    if wanted is not None:
        name = F.concat_ws("/", "run", F.col("batch_id").cast("string"))
        target = target.filter(name.isin([f"{a}/{b}" for a, b in sorted(wanted)])) if wanted else target.limit(0)
    # Without its filter a partition is read whole, so one that is being rewritten has none.
    keyfilter.drop_filter(spark, path, batch_id, run)
    added = fresh
    if wanted is None or wanted:
        taken = cut(target.select(key).join(small_side(keys), key, "left_semi"))
        added = fresh if taken.isEmpty() else fresh.join(small_side(taken), key, "left_anti")
    replace_batch(added, path, batch_id, run)
    stored = spark.read.schema(schema).parquet(path).filter(own)
    keyfilter.write_filter(stored.select(key), path, key, batch_id, run)


def upsert_into(batch: DataFrame, path: str, key: str, order: list[Column], part: str = "day",
                group: str | None = None) -> None:
    """Insert-or-replace into a Parquet table partitioned by ``part``.

    A key stays in the partition where it was first stored, so no partition is left with an outdated copy. Partitions
    in which a stored row is replaced are rewritten; new keys of other partitions are appended, and files there stay as
    they are. With ``group`` the batch's rows of a group replace all stored rows of it, also those whose key does not
    come again. Finding the stored rows reads the key columns alone; ``batch`` must give the same keys when it is computed again. Replaying a batch replaces its rows by themselves.
    """
    spark = batch.sparkSession
    by = group or key
    fresh, keys = _first_per_repeated_key(batch, key, order, by, part)
    table = read_or_empty(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields))
    named = cut(keys.select(by).distinct())
    stored = cut(table.select(*dict.fromkeys([key, by]), F.col(part).alias("_part")).join(small_side(named), by, "left_semi"))
    # Rows that come with the partition they were stored in need not be looked up.
    moved = cut(keys.select(key, F.col(part).alias("_own")).join(stored.select(key, "_part"), key)
                .filter(~F.col("_part").eqNullSafe(F.col("_own"))).select(key, "_part"))
    moved = None if moved.isEmpty() else small_side(moved)

    def place(rows: DataFrame) -> DataFrame:
        found = rows if moved is None else rows.join(moved, key, "left").withColumn(part, F.coalesce("_part", part))
        return found.select(*rows.columns)

    placed = place(fresh)
    # One value per touched partition, which prunes the read as literals.
    touched = [row[0] for row in stored.select("_part").distinct().collect()]
    values = {row[0] for row in place(keys).select(part).distinct().collect()}
    elsewhere = not values <= set(touched) or None in values
    if touched and elsewhere:
        placed = cut(placed)
    if touched:
        kept = table.filter(F.col(part).isin(touched)).join(small_side(named), by, "left_anti")
        rows = kept.unionByName(placed.filter(F.col(part).isin(touched)) if elsewhere else placed)
        (
            _by_part(rows, part, len(touched))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        )
    new = placed.filter(~F.col(part).isin(touched)) if touched else placed
    if not touched or elsewhere:
        _by_part(new, part, len(values)).write.mode("append").partitionBy(part).parquet(path)


def _by_part(rows: DataFrame, part: str, values: int) -> DataFrame:
    """Rows for several partitions of a table, gathered by partition: large ones are split and small ones merged by size.

    Rows of one partition alone are written where they are.
    """
    return rows.hint("rebalance", part) if values > 1 else rows


def recent_articles(articles: DataFrame, limit: int = 20) -> DataFrame:
    """Newest articles first: a per-task top-n and one small merge."""
    return articles.orderBy(F.col("published_date").desc(), F.col("article_id").asc()).limit(limit)


def within_date_filter(df: DataFrame, date_filter: str, as_of: Column, column: str = "published_date") -> DataFrame:
    """Rows of the last ``7d``-style period (units d, h, m)."""
    amount, unit = int(date_filter[:-1]), {"d": "DAYS", "h": "HOURS", "m": "MINUTES"}[date_filter[-1]]
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {amount} {unit}"))
