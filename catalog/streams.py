"""Streaming queries: messages land in a folder in three deliveries, the stream runs until it has seen them all."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators.tables import read_or_empty
from articleflow.session import scratch
from articleflow.sources import topics
from articleflow.streaming import dedup, ingest, logs
from catalog import sql as S
from catalog.ingest import event_logs
from catalog.registry import as_of, doc_articles, iso, page_articles, query, table

DELIVERIES = 3


def deliver(rows, landing, number):
    """Append one delivery (a third of the rows in arrival order) to the landing folder, as JSON lines."""
    third = rows.filter(F.col("_delivery") == number)
    columns = [c for c in rows.columns if c != "_delivery"]
    third.select(F.to_json(F.struct(*columns)).alias("value")).write.mode("append").text(landing)


def in_deliveries(rows, order):
    """Numbers the rows' deliveries by equal ranges of the order column."""
    last = rows.agg(F.max(order)).first()[0]
    return rows.withColumn("_delivery", F.floor(F.col(order) * DELIVERIES / (last + 1)).cast("int"))


def run_deliveries(spark, rows, start):
    """Alternate deliveries and ``start(messages, root)`` runs over the same checkpoint; returns the root folder."""
    root = scratch(spark, "stream")
    landing = os.path.join(root, "landing")
    for number in range(DELIVERIES):
        deliver(rows, landing, number)
        messages = topics.article_stream_source(spark, "text", {"path": landing})
        start(messages, root).awaitTermination()
    return root


def append_to(root, name):
    return {"path": os.path.join(root, name), "checkpointLocation": os.path.join(root, f"{name}-checkpoint")}


@query("article_stream_source", f"""WITH {S.DOCS} SELECT article_id, source, md5(content) AS content_md5,
  {S.iso('scraped_at')} AS scraped_at FROM docs""")
def article_stream_source(spark, sf_dir):
    rows = in_deliveries(doc_articles(spark, sf_dir), "doc_id").drop("doc_id")
    root = run_deliveries(spark, rows, lambda messages, at: messages.writeStream.format("parquet")
                          .options(**append_to(at, "out")).trigger(availableNow=True).start())
    return spark.read.parquet(os.path.join(root, "out")).select(
        "article_id", "source", F.md5("content").alias("content_md5"), iso("scraped_at").alias("scraped_at")
    )


@query("stream_url_dedup", f"WITH {S.PAGES} SELECT article_id, url, title FROM arts")
def stream_url_dedup(spark, sf_dir):
    pages = page_articles(spark, sf_dir)
    # Every page is scraped twice, half an hour apart.
    once = pages.withColumn("scraped_at", F.col("published_date"))
    again = once.withColumn("scraped_at", F.col("scraped_at") + F.expr("INTERVAL 30 MINUTES"))
    rows = in_deliveries(once.unionByName(again), "page_id").drop("page_id")
    root = run_deliveries(spark, rows, lambda messages, at: dedup.stream_url_dedup(messages)
                          .writeStream.format("parquet").options(**append_to(at, "out"))
                          .trigger(availableNow=True).start())
    return spark.read.parquet(os.path.join(root, "out")).select("article_id", "url", "title")


@query("stream_near_dup", f"WITH {S.KEPT} SELECT article_id, url FROM docs WHERE doc_id IN (FROM kept)")
def stream_near_dup(spark, sf_dir):
    rows = in_deliveries(doc_articles(spark, sf_dir), "doc_id").drop("doc_id")

    def start(messages, root):
        def step(batch, batch_id):
            unique = dedup.near_dup_batch(
                batch, os.path.join(root, "fingerprints"), batch_id, ["scraped_at", "article_id"], as_of()
            )
            unique.select("article_id", "url").write.mode("overwrite").parquet(
                os.path.join(root, "unique", f"batch={batch_id}")
            )

        return messages.writeStream.foreachBatch(step).option(
            "checkpointLocation", os.path.join(root, "checkpoint")
        ).trigger(availableNow=True).start()

    root = run_deliveries(spark, rows, start)
    return spark.read.parquet(os.path.join(root, "unique")).select("article_id", "url")


def ingested(spark, sf_dir):
    rows = in_deliveries(doc_articles(spark, sf_dir), "doc_id").drop("doc_id")

    def start(messages, root):
        return ingest.start_ingest(messages, ingest.Stores(root), once=True, as_of=as_of())

    return ingest.Stores(run_deliveries(spark, rows, start))


@query("ingest_stream", f"""WITH {S.KEPT}
SELECT article_id AS id, url, source, title, CAST(len({S.words('content')}) AS INT) AS word_count
FROM docs WHERE doc_id IN (FROM kept)""")
def ingest_stream(spark, sf_dir):
    stores = ingested(spark, sf_dir)
    return spark.read.parquet(stores.articles).select("id", "url", "source", "title", "word_count")


@query("indexed_chunks_stream", f"""WITH RECURSIVE {S.KEPT},{S.RECURSIVE_CHUNKS}
SELECT article_id, count(*) AS n_chunks, {C.EMBEDDING_DIM} AS dim, CAST(sum(len(text)) AS BIGINT) AS chars
FROM rchunks JOIN docs USING (doc_id) WHERE doc_id IN (FROM kept) GROUP BY 1""")
def indexed_chunks_stream(spark, sf_dir):
    """The chunk table behind the stream: chunks per article with their vectors' length."""
    chunks = spark.read.parquet(ingested(spark, sf_dir).chunks)
    return chunks.groupBy("article_id").agg(
        F.count("*").alias("n_chunks"), F.min(F.size("embedding")).alias("dim"), F.sum(F.length("text")).alias("chars")
    )


@query("dual_index", f"""WITH {S.DOCS}, {S.CHUNKS}
SELECT article_id, url, count(*) AS n_chunks, CAST(sum(len(text)) AS BIGINT) AS chars FROM chunks GROUP BY 1, 2""")
def dual_index(spark, sf_dir):
    from articleflow.operators import embedding
    from catalog.documents import keyed_chunks

    stores = ingest.Stores(scratch(spark, "index"))
    articles = doc_articles(spark, sf_dir)
    chunks = embedding.embed_chunks(keyed_chunks(spark, sf_dir), embedding.hash_embedder(64)).select(
        "chunk_key", "chunk_id", "text", "embedding", "article_id", "title", "url"
    )
    for _ in range(2):  # the second run replays the batch
        ingest.dual_index(articles, chunks, stores, 0, as_of())
    stored = spark.read.parquet(stores.articles).select(F.col("id").alias("article_id"), "url")
    return stored.join(spark.read.parquet(stores.chunks).drop("url"), "article_id").groupBy("article_id", "url").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars")
    )


@query("log_stream", f"""SELECT event_type AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'view' THEN '2024-02-01T00:00:00.000Z' ELSE {S.iso('ts')} END AS timestamp,
  CASE WHEN event_type = 'view' THEN '2024.02.01' ELSE strftime(ts, '%Y.%m.%d') END AS day,
  CASE WHEN event_type = 'click' THEN NULL ELSE props ->> '$.k' END AS parsed_k FROM events""")
def log_stream(spark, sf_dir):
    root = scratch(spark, "logs")
    landing, index = os.path.join(root, "landing"), os.path.join(root, "index")
    rows = event_logs(spark, sf_dir).select("timestamp", "service", "level", "message")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(landing)
    arrival = F.coalesce(F.to_timestamp("timestamp"), as_of())
    logs.start_log_index(
        spark, landing, index, os.path.join(root, "checkpoint"), once=True, arrived_at=arrival
    ).awaitTermination()
    stored = read_or_empty(
        spark, index, "timestamp string, service string, level string, parsed map<string,string>, day string"
    )
    return stored.select("service", "level", "timestamp", "day", F.col("parsed")["k"].alias("parsed_k"))


@query("log_stream_source", """SELECT event_type AS service, count(*) AS n, count(*) FILTER (event_type <> 'view') AS stamped
FROM events GROUP BY 1""")
def log_stream_source(spark, sf_dir):
    from articleflow.sources.logs import log_stream_source as read_logs

    root = scratch(spark, "logs")
    landing = os.path.join(root, "landing")
    rows = event_logs(spark, sf_dir).select("timestamp", "service", "level", "message")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(landing)
    read_logs(spark, landing).writeStream.format("parquet").options(**append_to(root, "out")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(os.path.join(root, "out")).groupBy("service").agg(
        F.count("*").alias("n"), F.count("timestamp").alias("stamped")
    )


def raw_messages(spark, sf_dir):
    """Article messages as text; one source's lose their closing brace, another's their url, every tenth is empty."""
    docs = in_deliveries(doc_articles(spark, sf_dir), "doc_id")
    fields = [c for c in docs.columns if c not in ("doc_id", "_delivery")]
    whole = F.to_json(F.struct(*fields))
    value = (
        F.when(F.col("doc_id") % 10 == 9, F.lit("  ")).when(F.col("source") == "src0", F.regexp_replace(whole, r"\}$", ""))
        .when(F.col("source") == "src1", F.to_json(F.struct(*[c for c in fields if c != "url"]))).otherwise(whole)
    )
    return docs.select(value.alias("value"), "_delivery")


_REASONS = """CASE WHEN doc_id % 10 = 9 THEN 'empty' WHEN source = 'src0' THEN 'malformed' WHEN source = 'src1' THEN 'no url'
  ELSE 'good' END"""


def deliver_texts(spark, rows, start):
    """As ``run_deliveries``, of texts: ``start`` gets the landing folder."""
    root = scratch(spark, "stream")
    landing = os.path.join(root, "landing")
    for number in range(DELIVERIES):
        rows.filter(F.col("_delivery") == number).select("value").write.mode("append").text(landing)
        start(landing, root).awaitTermination()
    return root


@query("article_sinks", f"""WITH {S.DOCS} SELECT {_REASONS} AS verdict, count(*) AS n,
  count(DISTINCT CASE WHEN {_REASONS} = 'good' THEN article_id END) AS articles FROM docs GROUP BY 1""")
def article_sinks(spark, sf_dir):
    """One stream into the table of good records and that of dead letters."""
    def start(landing, root):
        messages = topics.message_stream(spark, "text", {"path": landing})
        return topics.start_article_sinks(messages, os.path.join(root, "good"), os.path.join(root, "dead"),
                                          os.path.join(root, "checkpoint"), once=True)

    root = deliver_texts(spark, raw_messages(spark, sf_dir), start)
    good = spark.read.parquet(os.path.join(root, "good")).select(F.lit("good").alias("verdict"), "article_id")
    dead = spark.read.parquet(os.path.join(root, "dead")).select(
        F.col("reason").alias("verdict"), F.lit(None).cast("string").alias("article_id"))
    return good.unionByName(dead).groupBy("verdict").agg(
        F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"))


@query("ingest_dead_letters", f"""WITH {S.DOCS} SELECT {_REASONS} AS reason, count(*) AS n FROM docs
WHERE {_REASONS} <> 'good' GROUP BY 1""")
def ingest_dead_letters(spark, sf_dir):
    """The dead-letter table beside the indexed articles of the ingest stream."""
    def start(landing, root):
        messages = topics.message_stream(spark, "text", {"path": landing})
        return ingest.start_ingest(messages, ingest.Stores(root), once=True, as_of=as_of())

    stores = ingest.Stores(deliver_texts(spark, raw_messages(spark, sf_dir), start))
    return spark.read.parquet(stores.dead_letters).groupBy("reason").agg(F.count("*").alias("n"))


def extended_logs(spark, sf_dir):
    """Log lines with two fields that the layout does not know; every tenth line is cut off."""
    known = event_logs(spark, sf_dir).select("event_id", "timestamp", "service", "level", "message")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("value").alias("metrics"))
    rows = known.join(events, "event_id")
    line = F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"]))
    return rows.select(F.when(F.col("event_id") % 10 == 0, F.regexp_replace(line, r"\}$", "")).otherwise(line).alias("value"))


@query("log_extras", """SELECT event_type AS service, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users,
  round(sum(value), 2) AS total FROM events WHERE event_id % 10 <> 0 GROUP BY 1
UNION ALL SELECT '(broken)', count(*), 0, 0.0::DOUBLE FROM events WHERE event_id % 10 = 0""")
def log_extras(spark, sf_dir):
    """Fields outside the log layout, read back from the index, and the lines that could not be read."""
    root = scratch(spark, "logs")
    landing, index, broken = (os.path.join(root, name) for name in ("landing", "index", "broken"))
    extended_logs(spark, sf_dir).write.text(landing)
    logs.start_log_index(spark, landing, index, os.path.join(root, "checkpoint"), once=True, arrived_at=as_of(),
                         broken=broken).awaitTermination()
    stored = spark.read.schema("service string, extra map<string,variant>, day string").parquet(index)
    user = F.variant_get(F.col("extra")["user_id"], "$", "long")
    value = F.variant_get(F.col("extra")["metrics"], "$.value", "double")
    found = stored.groupBy("service").agg(
        F.count("*").alias("n"), F.sum(user).alias("users"), F.round(F.sum(value), 2).alias("total"))
    lost = spark.read.parquet(broken).agg(
        F.lit("(broken)").alias("service"), F.count("*").alias("n"), F.lit(0).cast("long").alias("users"),
        F.lit(0.0).alias("total"))
    return found.unionByName(lost)


@query("level_windows", f"""WITH stamped AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS service,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events)
SELECT {S.iso('start')} AS window_start, service, level, count(*) AS n FROM stamped
WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL""")
def level_windows(spark, sf_dir):
    """Closed hourly windows of a stream of log events that lands in three parts."""
    rows = event_logs(spark, sf_dir).select("event_id", "ts", "service", "level")
    rows = in_deliveries(rows, "event_id")
    root = scratch(spark, "windows")
    landing = os.path.join(root, "landing")
    for number in range(DELIVERIES):
        rows.filter(F.col("_delivery") == number).select("ts", "service", "level").write.mode("append").parquet(landing)
        events = spark.readStream.schema("ts timestamp, service string, level string").parquet(landing)
        logs.level_windows(events).writeStream.format("parquet").outputMode("append").options(
            **append_to(root, "out")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(os.path.join(root, "out")).withColumn("window_start", iso("window_start"))
