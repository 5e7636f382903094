"""Join and top-k building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A key is hot beyond this many rows. Hot keys therefore number at most rows / HOT_ROWS, which bounds the
# broadcast list of them: 50,000 entries per five billion rows.
HOT_ROWS = 100_000

# Sides of at most this many narrow rows are sent to every task; their size is counted first.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else unchanged (shuffle join).

    ``df`` is counted, so it should be materialised or cheap, and hold only narrow columns.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key.

    Spark prunes to ``n`` rows per key and input partition before the shuffle (WindowGroupLimit), so a key with
    a third of all rows sends only ``n`` rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``many`` with ``one`` (one row per key); hot keys of ``many`` are split over several tasks.

    Keys with more than ``hot_rows`` rows get one salt per ``hot_rows``; the matching row of ``one`` is repeated
    once per salt, so the extra rows number at most rows / hot_rows.
    """
    hot = (
        many.groupBy(*keys).count().filter(F.col("count") > hot_rows)
        .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
    )
    hot = F.broadcast(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        many.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        one.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
