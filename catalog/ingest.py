"""Entries, messages, article table, logs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators import normalize, stats, tables
from articleflow.plans import ingest as plan
from articleflow.session import scratch
from articleflow.sources import feeds, logs, topics
from catalog import sql as S
from catalog.registry import AS_OF, DOC_URL, as_of, doc_articles, iso, page_articles, query, spread_table, table


@query("feed_entries", f"""SELECT url AS link, {S.page_title('html')} AS title, md5(html) AS summary_md5 FROM pages""")
def feed_entries(spark, sf_dir):
    entries = feeds.page_entries(spread_table(spark, sf_dir, "pages"))
    return entries.select("link", "title", F.md5("summary").alias("summary_md5"))


# Documents as feed elements: even sources are RSS feeds, odd ones Atom feeds. Every fifth element has no
# text, every seventh of the others is broken, every third has no tags, every second no author; dates come in two forms, unreadable, or not at all. One source
# lies in a folder that is no feed's.
STRAY_FEED = "folder=src3"


def feed_documents(spark, sf_dir):
    """(folder, page, document): feed documents of at most 100 elements each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    n = F.col("doc_id")

    def escaped(text):
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(name))
        return text

    def tag(name, body, when=None):
        whole = F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name.split()[0]}>"))
        return whole if when is None else F.when(when, whole).otherwise("")

    text = F.when(n % 7 == 6, F.concat(escaped(F.col("text")), F.lit(" <b>"))).otherwise(escaped(F.col("text")))
    arrived = F.expr("timestampadd(MINUTE, cast(doc_id as int), timestamp'2024-01-01 00:00:00')")
    mailed = F.concat(F.date_format(arrived, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    date = F.when(n % 4 == 0, mailed).when(n % 4 == 1, F.date_format(arrived, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    link, title = F.concat(F.lit(DOC_URL), n.cast("string")), F.concat(F.lit("Doc &amp; "), n.cast("string"))
    has_text, has_tags, has_author, has_date = n % 5 != 0, n % 3 != 0, n % 2 == 0, n % 4 != 3
    rss = F.concat(
        F.lit("<item>"), tag("title", title), tag("link", link), tag("description", text, has_text),
        tag("pubDate", date, has_date), tag("category", F.col("lang"), has_tags),
        tag("category", F.col("source"), has_tags), tag("dc:creator", F.lit("Ann"), has_author), F.lit("</item>"))
    atom = F.concat(
        F.lit("<entry>"), tag("title type=\"html\"", title), F.concat(F.lit("<link href=\""), link, F.lit("\"/>")),
        tag("summary", text, has_text), tag("published", date, has_date),
        F.when(has_tags, F.concat(F.lit("<category term=\""), F.col("lang"), F.lit("\"/><category term=\""),
                                  F.col("source"), F.lit("\"/>"))).otherwise(""),
        tag("author", F.lit("<name>Ann</name>"), has_author), F.lit("</entry>"))
    is_rss = F.substring("source", 4, 10).cast("int") % 2 == 0
    elements = docs.select(F.col("source").alias("folder"), (n / 100).cast("int").alias("page"), is_rss.alias("is_rss"),
                           n.alias("n"), F.when(is_rss, rss).otherwise(atom).alias("xml"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "xml"))), lambda e: e["xml"]), "\n")
    pages = elements.groupBy("folder", "page", "is_rss").agg(body.alias("body"))
    document = F.when(F.col("is_rss"), F.concat(F.lit("<rss version=\"2.0\"><channel><title>c</title>"), F.col("body"),
                                                F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed><title>c</title>"), F.col("body"), F.lit("</feed>")))
    return pages.select("folder", document.alias("value"))


def landed_feed_entries(spark, sf_dir):
    """(entries, rejected) of all documents, landed as feed files in one folder per source."""
    landing = scratch(spark, "feeds")
    feed_documents(spark, sf_dir).write.partitionBy("folder").text(landing)
    named = table(spark, sf_dir, "documents").select("source").distinct().select(
        F.concat(F.lit("folder="), "source").alias("folder"),
        F.concat(F.lit("https://www."), "source", F.lit("-news.example/feed")).alias("feed_url"))
    return feeds.landed_entries(feeds.feed_files(spark, landing), named.filter(F.col("folder") != STRAY_FEED))


@query("feed_files", f"""WITH texts AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN '' ELSE
    replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS body,
    '{DOC_URL}' || doc_id AS link FROM documents WHERE NOT (doc_id % 7 = 6 AND doc_id % 5 <> 0) AND source <> 'src3')
SELECT {S.uuid5('link')} AS article_id, link AS url, 'Doc & ' || doc_id AS title, md5({S.html_text('body')}) AS content_md5,
  upper(source[1]) || source[2:] || '-News' AS source, CASE WHEN doc_id % 2 = 0 THEN 'Ann' ELSE 'Unknown' END AS author,
  CASE WHEN doc_id % 4 < 2 THEN {S.iso("TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE")} ELSE '{AS_OF}' END AS published_date,
  CASE WHEN doc_id % 3 = 0 THEN 'General' ELSE lang || ',' || source END AS categories,
  CAST(len({S.words('body')}) AS INT) AS word_count FROM texts""")
def feed_files(spark, sf_dir):
    """Feed files of all sources, RSS and Atom in one scan, normalised."""
    entries, _ = landed_feed_entries(spark, sf_dir)
    articles = normalize.normalize_articles(entries, as_of())
    return articles.select(
        "article_id", "url", "title", F.md5("content").alias("content_md5"), "source", "author",
        iso("published_date").alias("published_date"), F.array_join("categories", ",").alias("categories"),
        F.col("metadata.word_count").alias("word_count"),
    )


@query("feed_rejects", """SELECT CASE WHEN broken THEN 'malformed' ELSE 'unknown feed' END AS reason, count(*) AS n
FROM (SELECT source, doc_id % 7 = 6 AND doc_id % 5 <> 0 AS broken FROM documents) WHERE broken OR source = 'src3' GROUP BY 1""")
def feed_rejects(spark, sf_dir):
    return landed_feed_entries(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("normalize_articles", f"""WITH {S.PAGES}
SELECT article_id, arts.url, title, content, source, 'Unknown' AS author, '{AS_OF}' AS published_date,
  'General' AS categories, CAST(len({S.words('html')}) AS INT) AS word_count FROM arts JOIN pages USING (page_id)""")
def normalize_articles(spark, sf_dir):
    articles = normalize.normalize_articles(feeds.page_entries(spread_table(spark, sf_dir, "pages")), as_of())
    return articles.select(
        "article_id", "url", "title", "content", "source", "author", iso("published_date").alias("published_date"),
        F.array_join("categories", ",").alias("categories"), F.col("metadata.word_count").alias("word_count"),
    )


@query("ingest_entries", f"""WITH {S.KEPT_PAGES}
SELECT article_id, url, title, source FROM docs WHERE doc_id IN (FROM kept)""")
def ingest_entries(spark, sf_dir):
    entries = feeds.page_entries(spread_table(spark, sf_dir, "pages"))
    articles, chunks = plan.ingest_entries(entries, as_of(), ["page_id"])
    # Every article of this table has text, so each one shows up in the chunk table.
    chunked = chunks.select("article_id").distinct()
    return articles.join(chunked, "article_id", "left_semi").select("article_id", "url", "title", "source")


@query("unwrap_envelope", f"""WITH {S.DOCS}
SELECT article_id, CASE WHEN title = 'es' THEN '{C.DEFAULT_TITLE}' ELSE title END AS title, source,
  md5(content) AS content_md5, CASE WHEN title = 'en' THEN 1 ELSE 0 END AS n_chunks
FROM docs""")
def unwrap_envelope(spark, sf_dir):
    # English articles come with chunks, Spanish ones bare without a title, others bare; each also sends an empty message.
    docs = doc_articles(spark, sf_dir).drop("doc_id")
    chunk = F.array(F.struct(F.lit(0).alias("chunk_id"), F.col("content").alias("text")))
    lang = F.col("title")
    fields = [c for c in docs.columns if c != "title"]
    value = (
        F.when(lang == "en", F.to_json(F.struct(F.struct(*docs.columns).alias("article"), chunk.alias("chunks"))))
        .when(lang == "es", F.to_json(F.struct(*fields)))
        .otherwise(F.to_json(F.struct(*docs.columns)))
    )
    messages = docs.select(F.explode(F.array(value, F.lit("{}"))).alias("value"))
    return normalize.unwrap_envelope(messages).select(
        "article.article_id", "article.title", "article.source", F.md5("article.content").alias("content_md5"),
        F.size("chunks").alias("n_chunks"),
    )


@query("quarantine_bad_records", f"""WITH {S.DOCS}
SELECT CASE WHEN source = 'src0' THEN 'quarantined' ELSE 'good' END AS verdict,
  CASE WHEN source = 'src0' THEN NULL ELSE article_id END AS article_id,
  CASE WHEN source = 'src0' THEN NULL ELSE md5(content) END AS content_md5 FROM docs""")
def quarantine_bad_records(spark, sf_dir):
    docs = doc_articles(spark, sf_dir).drop("doc_id")
    text = F.to_json(F.struct(*docs.columns))
    # One source's messages lose their closing brace on the way.
    value = F.when(F.col("source") == "src0", F.regexp_replace(text, r"\}$", "")).otherwise(text)
    good, bad = normalize.quarantine_bad_records(docs.select(value.alias("value")))
    return good.select(F.lit("good").alias("verdict"), "article_id", F.md5("content").alias("content_md5")).unionByName(
        bad.select(F.lit("quarantined").alias("verdict")), allowMissingColumns=True
    )


# --------------------------------------------------------------------------------------------- article table

@query("keep_first_by_key", f"""WITH {S.PAGES},
keyed AS (SELECT *, regexp_replace(regexp_replace(url, '^https?://(www\\.|m\\.|blog\\.)?', ''), '[?#].*$', '') AS canonical FROM arts)
SELECT canonical, arg_min(url, page_id) AS url, min(page_id) AS page_id FROM keyed GROUP BY canonical""")
def keep_first_by_key(spark, sf_dir):
    pages = page_articles(spark, sf_dir).select("page_id", "url")
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.|m\.|blog\.)?", ""), r"[?#].*$", "")
    first = tables.keep_first_by_key(pages.withColumn("canonical", bare), "canonical", ["page_id"])
    return first.select("canonical", "url", "page_id")


@query("exact_url_dedup", f"WITH {S.PAGES} SELECT article_id, url, page_id FROM arts")
def exact_url_dedup(spark, sf_dir):
    pages = page_articles(spark, sf_dir).select("page_id", "url")
    seen_twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000_000))
    return tables.exact_url_dedup(seen_twice, ["page_id"]).select("article_id", "url", "page_id")


@query("insert_if_absent", f"""WITH {S.PAGES}
SELECT article_id, url, title, CASE WHEN url LIKE 'https:%' THEN 1 ELSE 2 END AS batch FROM arts""")
def insert_if_absent(spark, sf_dir):
    path = scratch(spark, "articles")
    pages = page_articles(spark, sf_dir).select("article_id", "url", "title")
    secure = pages.filter("url like 'https:%'").withColumn("batch", F.lit(1))
    later = pages.withColumn("batch", F.lit(2))
    tables.append_absent(secure, path, "url", ["article_id"], 0)
    for _ in range(2):  # the second run replays the batch
        tables.append_absent(later, path, "url", ["article_id"], 1)
    return spark.read.parquet(path).select("article_id", "url", "title", "batch")


@query("recent_articles", f"""WITH {S.PAGES}
SELECT article_id, url, title, {S.iso('published_date')} AS published_date FROM arts
ORDER BY arts.published_date DESC, article_id LIMIT 20""")
def recent_articles(spark, sf_dir):
    newest = tables.recent_articles(page_articles(spark, sf_dir))
    return newest.select("article_id", "url", "title", iso("published_date").alias("published_date"))


@query("date_filter_search", f"""WITH {S.PAGES}
SELECT article_id, {S.iso('published_date')} AS published_date FROM arts
WHERE published_date >= (SELECT max(published_date) FROM arts) - INTERVAL 7 DAYS""")
def date_filter_search(spark, sf_dir):
    articles = page_articles(spark, sf_dir)
    latest = articles.agg(F.max("published_date").alias("latest")).first()["latest"]
    recent = tables.within_date_filter(articles, "7d", F.lit(latest))
    return recent.select("article_id", iso("published_date").alias("published_date"))


# ---------------------------------------------------------------------------------------------------- topics

@query("keyed_publish", f"""WITH {S.DOCS} SELECT source AS key, article_id, title, md5(content) AS content_md5 FROM docs""")
def keyed_publish(spark, sf_dir):
    path = scratch(spark, "topic")
    topics.keyed_publish(doc_articles(spark, sf_dir).drop("doc_id"), "parquet", {"path": path})
    sent = normalize.parse_messages(spark.read.parquet(path))
    return sent.select("key", "record.article_id", "record.title", F.md5("record.content").alias("content_md5"))


# ------------------------------------------------------------------------------------------------------ logs

def event_logs(spark, sf_dir):
    """``events`` as log records; ``view`` events come without a timestamp, ``click`` messages are plain text."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", "ts",
        F.when(F.col("event_type") != "view", iso("ts")).alias("timestamp"),
        F.col("event_type").alias("service"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("clicked "), "props")).otherwise(F.col("props")).alias("message"),
    )


@query("daily_log_index", f"""SELECT event_id, strftime(ts, '%Y.%m.%d') AS day,
  CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' ELSE {S.iso('ts')} END AS timestamp,
  CASE WHEN event_type = 'click' THEN NULL ELSE props ->> '$.k' END AS parsed_k FROM events""")
def daily_log_index(spark, sf_dir):
    path = scratch(spark, "log-index")
    logs.write_log_index(logs.daily_log_index(event_logs(spark, sf_dir), F.col("ts")), path)
    index = spark.read.option("inferSchema", "false").schema(
        "event_id bigint, timestamp string, parsed map<string,string>, day string"
    ).parquet(path)
    return index.select("event_id", "day", "timestamp", F.col("parsed")["k"].alias("parsed_k"))


@query("log_level_counts", """SELECT strftime(ts, '%Y.%m.%d') AS day, event_type AS service,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n FROM events GROUP BY ALL""")
def log_level_counts(spark, sf_dir):
    return stats.log_level_counts(logs.daily_log_index(event_logs(spark, sf_dir), F.col("ts")))


# --------------------------------------------------------------------------------------------------- reports

@query("source_counts", "SELECT source, count(*) AS n_articles FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return stats.source_counts(doc_articles(spark, sf_dir))


@query("store_counts", """SELECT 'articles' AS store, count(*) AS n FROM pages
UNION ALL SELECT 'vectors', count(*) FROM embeddings
UNION ALL SELECT 'cached queries', count(*) FROM benchmark
UNION ALL SELECT 'log entries', count(*) FROM events""")
def store_counts(spark, sf_dir):
    return stats.store_counts({
        "articles": table(spark, sf_dir, "pages"), "vectors": table(spark, sf_dir, "embeddings"),
        "cached queries": table(spark, sf_dir, "benchmark"), "log entries": table(spark, sf_dir, "events"),
    })


@query("feed_health", """SELECT CASE WHEN grouping(event_type) = 1 THEN NULL ELSE event_type END AS feed, count(*) AS checks,
  count(*) FILTER (value < 50) AS working, round(100.0::DOUBLE * count(*) FILTER (value < 50) / count(*), 1) AS success_rate,
  round(avg(value), 6) AS avg_elapsed, CAST(sum(user_id) AS BIGINT) AS entries FROM events GROUP BY ROLLUP (event_type)""")
def feed_health(spark, sf_dir):
    checks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed"), (F.col("value") < 50).alias("ok"), F.col("value").alias("elapsed"),
        F.col("user_id").alias("entries"),
    )
    return stats.feed_health(checks)


@query("trending_topics", """WITH counted AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS category, count(*) AS n
  FROM events GROUP BY 1, 2)
SELECT day, category, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day
  ORDER BY n DESC, category) AS rank FROM counted) WHERE rank <= 3""")
def trending_topics(spark, sf_dir):
    articles = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("published_date"), F.array("event_type").alias("categories")
    )
    return stats.trending_topics(articles).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("query_log", """WITH log AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(floor(value * 10) AS INT) AS ms FROM events)
SELECT day, count(*) AS n_queries, round(avg(ms), 6) AS avg_ms, quantile_disc(ms, 0.5) AS p50_ms,
  quantile_disc(ms, 0.95) AS p95_ms, max(ms) AS max_ms FROM log GROUP BY 1""")
def query_log(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("query", F.col("props"))
    log = stats.query_log(events, F.floor(F.col("value") * 10), F.col("ts").cast("timestamp"))
    return stats.latency_summary(log).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
