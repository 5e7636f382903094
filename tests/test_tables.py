import os
import tempfile

import pytest
from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators import answers, contexts, hits, normalize, tables
from articleflow.session import shared_dir
from articleflow.sources import feeds, topics
from articleflow.streaming import dedup, ingest


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_insert_if_absent(spark, root):
    path = os.path.join(root, "t")

    def rows():
        return sorted((r["url"], r["title"]) for r in spark.read.parquet(path).collect())

    first = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "url string, title string")
    second = spark.createDataFrame([("b", "9"), ("c", "4")], "url string, title string")
    tables.append_absent(first, path, "url", ["title"], 0)
    assert rows() == [("a", "1"), ("b", "3")]
    for _ in range(2):
        tables.append_absent(second, path, "url", ["title"], 1)
        assert rows() == [("a", "1"), ("b", "3"), ("c", "4")]
    tables.append_absent(first, path, "url", ["title"], 0)  # a late replay of the first batch
    assert rows() == [("a", "1"), ("b", "3"), ("c", "4")]


def test_upsert_keeps_the_first_partition(spark, root):
    path = os.path.join(root, "t")
    schema = "chunk_key string, text string, day string"

    def put(*rows):
        tables.upsert_into(spark.createDataFrame(rows, schema), path, "chunk_key", [F.col("text").asc()])
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(path).collect())

    assert put(("a", "1", "d1"), ("b", "1", "d2")) == [("a", "1", "d1"), ("b", "1", "d2")]
    assert put(("a", "2", "d3"), ("c", "1", "d3")) == [("a", "2", "d1"), ("b", "1", "d2"), ("c", "1", "d3")]
    assert put(("a", "3", "d9"), ("a", "2", "d9")) == [("a", "2", "d1"), ("b", "1", "d2"), ("c", "1", "d3")]


def test_another_run_never_overwrites(spark, root):
    path = os.path.join(root, "t")
    schema = "url string, title string"
    tables.append_absent(spark.createDataFrame([("u1", "first"), ("u2", "first")], schema), path, "url", ["title"], 0, "a")
    tables.append_absent(spark.createDataFrame([("u1", "second"), ("u3", "second")], schema), path, "url", ["title"], 0, "b")
    rows = sorted((r["url"], r["title"]) for r in spark.read.parquet(path).collect())
    assert rows == [("u1", "first"), ("u2", "first"), ("u3", "second")]


def test_upsert_appends_new_keys_and_replaces_groups(spark, root):
    path = os.path.join(root, "t")
    schema = "chunk_key string, url string, text string, day string"

    def put(*rows):
        tables.upsert_into(spark.createDataFrame(rows, schema), path, "chunk_key", [F.col("text").asc()], group="url")
        return sorted((r["chunk_key"], r["text"], r["day"]) for r in spark.read.schema(schema).parquet(path).collect())

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    put(("a0", "a", "old", "d1"), ("a1", "a", "old", "d1"), ("b0", "b", "old", "d2"))
    before = files()
    assert ("c0", "new", "d2") in put(("c0", "c", "new", "d2"))
    assert before < files()
    # A shorter new version leaves no chunk of the old one behind, and stays in its first partition.
    assert put(("a0", "a", "new", "d3")) == [("a0", "new", "d1"), ("b0", "old", "d2"), ("c0", "new", "d2")]
    assert put(("a0", "a", "new", "d3")) == [("a0", "new", "d1"), ("b0", "old", "d2"), ("c0", "new", "d2")]


def test_newest_version_of_a_url(spark):
    from articleflow.streaming.ingest import newest_versions

    rows = [("u", "2024-01-01", "1", "old"), ("u", "2024-01-02", "1", "new"), ("v", None, "2", "only")]
    frame = spark.createDataFrame(rows, "url string, scraped_at string, article_id string, content string")
    assert sorted((r["url"], r["content"]) for r in newest_versions(frame).collect()) == [("u", "new"), ("v", "only")]


def test_recent_and_date_filter(spark):
    frame = spark.sql("select timestampadd(DAY, cast(id as int), timestamp'2024-01-01') published_date, "
                      "cast(id as string) article_id from range(30)")
    assert [r["article_id"] for r in tables.recent_articles(frame, 3).collect()] == ["29", "28", "27"]
    as_of = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    assert tables.within_date_filter(frame, "7d", as_of).count() == 8
    assert tables.within_date_filter(frame, "24h", as_of).count() == 2


def land(root, files):
    for name, text in files.items():
        os.makedirs(os.path.join(root, os.path.dirname(name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as out:
            out.write(text if isinstance(text, bytes) else text.encode())


def named_feeds(spark):
    return spark.createDataFrame([("blog", "https://www.some-blog.example/feed"), ("an atom", "https://a.example/atom")],
                                 "folder string, feed_url string")


def test_feeds(spark, root):
    rss = """<rss><channel><title>c</title>
    <item><title>One</title><link>https://www.some-blog.example/1</link><description>&lt;p&gt;Hello &lt;b&gt;x&lt;/b&gt;&lt;/p&gt;</description>
    <pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate><category>AI</category><category>Chips</category></item>
    <item><title>Two</title><link>https://www.some-blog.example/2</link></item></channel></rss>"""
    atom = """<feed><entry><title>Three</title><link href="https://a.example/3"/><summary>text</summary>
    <author><name>Ann</name></author><published>2024-02-06T00:00:00Z</published><category term="ML"/></entry></feed>"""
    land(root, {"blog/rss.xml": rss, "an atom/feed.xml": atom})
    entries, rejected = feeds.landed_entries(feeds.feed_files(spark, root), named_feeds(spark))
    assert rejected.count() == 0
    rows = {r["title"]: r for r in normalize.normalize_articles(entries, F.to_timestamp(F.lit("2024-03-01"))).collect()}
    one, two, three = rows["One"], rows["Two"], rows["Three"]
    assert (one["content"], one["source"], one["author"], one["categories"]) == ("Hello x", "Some-Blog", "Unknown", ["AI", "Chips"])
    assert one["metadata"]["word_count"] == 2 and one["published_date"].day == 5
    assert (two["content"], two["categories"], two["published_date"].month) == ("", ["General"], 3)
    assert (three["author"], three["categories"], three["url"]) == ("Ann", ["ML"], "https://a.example/3")


def test_feed_forms_and_rejects(spark, root):
    rss = """<?xml version="1.0"?><rss xmlns:dc="x"><channel><link>of the channel</link><!-- <item><title>No</title></item> -->
    <item><title><![CDATA[T <b>w</b>o <!-- x --> </item>]]></title><guid>https://b.example/2</guid>
    <content:encoded><![CDATA[<p>body</p>]]></content:encoded><dc:creator>Bob</dc:creator><category/></item>
    <item><title>bad & broken</title><link>u</link></item><item><title>no link</title><guid isPermaLink="false">7</guid></item>
    </channel></rss>"""
    atom = """<a:feed xmlns:a="y"><a:entry><title>prefixed</title></a:entry></a:feed>
    <feed><entry xml:lang="en"><title type="html">A &amp;amp; B</title><link rel="self" href="s"/><link href=" https://a.example/3 "/>
    <summary type="html"></summary><content type="html">&lt;i&gt;whole&lt;/i&gt;</content><author><name>Ann</name></author>
    <author><name>Ben</name></author></entry></feed>"""
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><item><title>été</title><link>q</link></item></rss>'.encode("latin1")
    wide = "<rss><item><title>wide é</title><link>w</link></item></rss>".encode("utf-16")
    land(root, {"blog/1.xml": rss, "an atom/1.xml": atom, "stray/1.xml": "<item><link>l</link></item>", "blog/2.xml": latin,
                "blog/3.xml": wide, "blog/4.xml": b"", "blog/5.xml": "no feed at all"})
    entries, rejected = feeds.landed_entries(feeds.feed_files(spark, root), named_feeds(spark))
    rows = {r["link"]: r for r in entries.collect()}
    assert set(rows) == {"https://b.example/2", "https://a.example/3", "q", "w"}
    two, three = rows["https://b.example/2"], rows["https://a.example/3"]
    assert (two["title"], two["summary"], two["author"], two["tags"]) == ("T <b>w</b>o <!-- x --> </item>", "<p>body</p>", "Bob", None)
    assert (three["title"], three["summary"], three["author"]) == ("A &amp; B", "<i>whole</i>", "Ann")
    assert rows["q"]["title"] == "été" and rows["w"]["title"] == "wide é"
    assert sorted(r["reason"] for r in rejected.collect()) == ["malformed", "no link", "no link", "unknown feed"]


def test_feeds_as_a_stream(spark, root):
    landing = os.path.join(root, "landing")
    for n in range(2):
        land(landing, {f"blog/{n}.xml": f"<rss><item><title>t{n}</title><link>l{n}</link></item></rss>"})
        entries, _ = feeds.landed_entries(feeds.feed_files(spark, landing, stream=True), named_feeds(spark))
        entries.writeStream.format("parquet").option("path", os.path.join(root, "out")).option(
            "checkpointLocation", os.path.join(root, "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["link"] for r in spark.read.parquet(os.path.join(root, "out")).collect()) == ["l0", "l1"]


def test_url_dedup_keeps_one_row(spark):
    rows = [("u1", 2, "b"), ("u1", 1, "a"), ("u1", 1, "a"), ("u2", 5, "c"), (None, 1, "x"), (None, 2, "y")]
    frame = spark.createDataFrame(rows, "url string, place int, content string")
    kept = tables.exact_url_dedup(frame, ["place"])
    assert sorted((r["url"] or "", r["place"], r["content"]) for r in kept.collect()) == [
        ("", 1, "x"), ("u1", 1, "a"), ("u2", 5, "c")]


def test_envelopes_and_quarantine(spark):
    values = ['{"article": {"article_id": "1", "url": "u"}, "chunks": [{"chunk_id": 0, "text": "t"}]}',
              '{"article_id": "2", "title": "x", "url": "v"}', "{}", '{"article": nul', "null", ""]
    frame = spark.createDataFrame([(v,) for v in values], "value string")
    rows = sorted((r["article"]["article_id"], r["article"]["title"], len(r["chunks"]))
                  for r in normalize.unwrap_envelope(frame).collect())
    assert rows == [("1", "Unknown Title", 1), ("2", "x", 0)]
    good, bad = normalize.quarantine_bad_records(frame)
    assert '{"article": nul' in [r["value"] for r in bad.collect()]
    assert [r["article_id"] for r in good.collect()] == ["2"]
    assert good.count() + bad.count() == len(values)


def test_cache(spark):
    schema = ("query_id string, query string, context string, answer string, sources array<string>, used_realtime boolean, "
              "reranked boolean, local_results_count int, query_processed string")
    done = spark.createDataFrame([("1", "q1", "c", "a1", ["s"], False, True, 3, "q1"),
                                  ("2", "q2", " \n ", "a2", [], False, True, 0, "q2")], schema)
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    cache = answers.cache_put(done, now)
    assert cache.count() == 1  # a blank context is not cached
    asked = spark.createDataFrame([("x", "q1"), ("y", "q2"), ("z", "q1")], "query_id string, query string")
    fresh = {r["query_id"]: r["hit"] for r in answers.cache_lookup(asked, cache, now + F.expr("INTERVAL 3599 SECONDS")).collect()}
    stale = {r["query_id"]: r["hit"] for r in answers.cache_lookup(asked, cache, now + F.expr("INTERVAL 3600 SECONDS")).collect()}
    assert fresh == {"x": True, "y": False, "z": True}
    assert stale == {"x": False, "y": False, "z": False}


def test_answer_rows(spark):
    schema = "query_id int, query string, context string, sources array<string>, used_realtime boolean, reranked boolean, local_results_count int"
    frame = spark.createDataFrame([(1, "q", "one\n---\ntwo", ["s"], False, True, 2), (2, "q", " ", [], False, False, 0)], schema)
    plain = {r["query_id"]: r["answer"] for r in answers.answer_rows(frame).collect()}
    assert plain[1] == "one" and plain[2].startswith("I apologize")

    def load():
        return lambda prompts: [f"{p.count('[1] s')} cited" for p in prompts]

    assert {r["query_id"]: r["answer"] for r in answers.answer_rows(frame, load).collect()}[1] == "1 cited"
    small = answers.smalltalk_rows(spark.createDataFrame([(1, "hi"), (2, "what is new today")], "query_id int, query string"))
    assert [r["query_id"] for r in small.collect()] == [1]


def test_external_hits_are_capped_per_source(spark):
    rows = [(1, i, f"t{i}", f"l{i}", "pub" if i % 2 else None, "s") for i in range(6)]
    frame = spark.createDataFrame(rows, "query_id int, rank int, title string, link string, source string, summary string")
    all_hits = hits.external_hits({"news": frame, "web": frame, "papers": frame}, {"news": 3, "web": 2, "papers": 2},
                                  F.current_timestamp())
    merged = hits.merged_top_n(all_hits).orderBy("ordinal").collect()
    assert [r["link"] for r in merged] == ["l0", "l1", "l2", "l0", "l1"]
    assert [r["source"] for r in merged] == ["Google News", "pub", "Google News", "DuckDuckGo", "DuckDuckGo"]
    pages = spark.createDataFrame([("l0", "b" * 3000), ("l1", "")], "link string, body string")
    for limit, length in ((None, 3000), (C.PAGE_BODY_CHARS, 2000)):
        enriched = hits.enrich_hits(hits.merged_top_n(all_hits), pages, limit)
        filled = {r["ordinal"]: r["content"] for r in enriched.collect()}
        assert [len(filled[i]) for i in range(1, 6)] == [length, 1, 1, length, 1]
    whole, cut = (contexts.web_context(enriched, n).collect()[0]["context"] for n in (None, C.CONTEXT_BODY_CHARS))
    assert (whole.count("b"), cut.count("b")) == (4001, 2001)


ARTICLES = "article_id string, url string, title string, content string, source string, author string, " \
           "published_date timestamp, scraped_at timestamp, categories array<string>, metadata struct<word_count:int>"


def articles(spark, *items):
    """(id, text, minute) to article rows."""
    rows = spark.createDataFrame(items, "article_id string, content string, minute int")
    at = F.expr("timestampadd(MINUTE, minute, timestamp'2024-01-01 00:00:00')")
    return rows.select(
        "article_id", F.concat(F.lit("u/"), "article_id").alias("url"), F.lit("t").alias("title"), "content",
        F.lit("s").alias("source"), F.lit("a").alias("author"), at.alias("published_date"), at.alias("scraped_at"),
        F.array(F.lit("General")).alias("categories"), F.struct(F.lit(3).alias("word_count")).alias("metadata"),
    )


ONE, TWO, THREE = ("one two three four five", "six seven eight nine ten", "red green blue black white")


def test_near_dup_batches_replay_and_expiry(spark, root):
    store = os.path.join(root, "fp")

    def run(batch_id, when, *items):
        frame = articles(spark, *items)
        kept = dedup.near_dup_batch(frame, store, batch_id, ["scraped_at", "article_id"], F.to_timestamp(F.lit(when)))
        return sorted(r["article_id"] for r in kept.collect())

    first = [("a", ONE, 0), ("b", ONE, 1), ("c", TWO, 2), ("c", TWO, 2)]
    assert run(0, "2024-01-01 00:00:00", *first) == ["a", "c"]
    second = [("d", TWO, 3), ("e", THREE, 4)]
    for _ in range(2):
        assert run(1, "2024-01-02 00:00:00", *second) == ["e"]
    assert run(0, "2024-01-01 00:00:00", *first) == ["a", "c"]
    # After seven days the first batch's fingerprints are gone, the second's are not.
    assert run(2, "2024-01-08 12:00:00", ("f", ONE, 5), ("g", THREE, 6)) == ["f"]


def test_ingest_batch_replay_changes_nothing(spark, root):
    stores = ingest.Stores(root)
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))

    def tables_now():
        arts = sorted(r["url"] for r in spark.read.parquet(stores.articles).collect())
        chunks = sorted((r["url"], r["chunk_id"], r["text"][:20], len(r["embedding"])) for r in spark.read.parquet(stores.chunks).collect())
        return arts, chunks

    long_text = " ".join(f"w{i}" for i in range(400))
    batch = articles(spark, ("a", long_text, 0), ("b", ONE, 1), ("c", ONE, 2), ("d", "", 3))
    seen = []
    for _ in range(2):
        ingest.ingest_batch(batch, 0, stores, ["scraped_at", "article_id"], now)
        seen.append(tables_now())
    assert seen[0] == seen[1]
    arts, chunks = seen[0]
    assert arts == ["u/a", "u/b", "u/d"]  # d has no chunks but is an article
    assert [c[:2] for c in chunks] == [("u/a", 0), ("u/a", 1), ("u/a", 2), ("u/b", 0)]
    assert {c[3] for c in chunks} == {768}


def test_stream_from_files(spark, root):
    landing, stores = os.path.join(root, "landing"), ingest.Stores(os.path.join(root, "tables"))
    good = articles(spark, ("a", ONE, 0), ("b", TWO, 1))
    good.select(F.to_json(F.struct("*")).alias("value")).write.text(landing)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(landing)

    def run():
        messages = topics.article_stream_source(spark, "text", {"path": landing})
        ingest.start_ingest(messages, stores, once=True, as_of=F.to_timestamp(F.lit("2024-01-01"))).awaitTermination()
        return sorted(r["url"] for r in spark.read.parquet(stores.articles).collect())

    assert run() == ["u/a", "u/b"]
    left = [name for name in os.listdir(shared_dir(spark)) if name.startswith("space-")]
    assert left == []  # the micro-batch removed its scratch tables
    articles(spark, ("c", ONE, 2), ("d", THREE, 3)).select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(landing)
    assert run() == ["u/a", "u/b", "u/d"]


# ------------------------------------------------------------------------------------ lifetimes, dead letters, logs

def folders(path, column):
    return sorted(name.split("=")[1] for name in os.listdir(path) if name.startswith(f"{column}="))


def test_expired_fingerprints_are_deleted(spark, root):
    store = os.path.join(root, "fingerprints")

    def put(batch_id, when, *texts):
        frame = spark.createDataFrame([(f"{batch_id}-{i}", t, when) for i, t in enumerate(texts)],
                                      "article_id string, content string, scraped_at string").withColumn("title", F.lit("t"))
        kept = dedup.near_dup_batch(frame, store, batch_id, ["scraped_at", "article_id"], F.to_timestamp(F.lit(when)))
        return sorted(r["article_id"] for r in kept.collect())

    one, two = "a text of several words", "quite another text of words"
    assert put(0, "2024-01-01 00:00:00", one) == ["0-0"]
    assert put(1, "2024-01-05 00:00:00", one, two) == ["1-1"]
    assert folders(store, "expires_day") == ["2024-01-08", "2024-01-12"]
    # The first fingerprint has expired: its text is new again, and its day is gone. A replay finds the same.
    for _ in range(2):
        assert put(2, "2024-01-10 00:00:00", one, two) == ["2-0"]
        assert folders(store, "expires_day") == ["2024-01-12", "2024-01-17"]


def test_expired_answers_are_deleted(spark, root):
    from articleflow.plans import answer

    def responses(*queries):
        return spark.createDataFrame(
            [(q, q, "ctx", "a", ["s"], False, False, 1, q) for q in queries],
            "query_id string, query string, context string, answer string, sources array<string>, used_realtime boolean, "
            "reranked boolean, local_results_count int, query_processed string")

    def at(when):
        return F.to_timestamp(F.lit(when))

    answer.store_answers(responses("q1"), root, at("2024-01-01 10:00:00"))
    answer.store_answers(responses("q2"), root, at("2024-01-01 23:30:00"))
    path = answer.cache_path(root, None)
    assert folders(path, "expires_day") == ["2024-01-01", "2024-01-02"]
    answer.store_answers(responses("q3"), root, at("2024-01-02 00:10:00"))
    assert folders(path, "expires_day") == ["2024-01-02"]
    assert answer.stored_cache(spark, root).count() == 2
    assert answer.stored_cache(spark, os.path.join(root, "nowhere")).count() == 0


def test_article_sinks_replay(spark, root):
    landing, good, bad = (os.path.join(root, name) for name in ("in", "good", "bad"))
    values = ['{"article_id": "1", "url": "u"}', '{"article_id": "2"}', '{"broken', " ", '{"url": "v"}']
    spark.createDataFrame([(v,) for v in values], "value string").write.text(landing)
    topics.start_article_sinks(topics.message_stream(spark, "text", {"path": landing}), good, bad,
                               os.path.join(root, "ck"), once=True).awaitTermination()
    assert [r["article_id"] for r in spark.read.parquet(good).collect()] == ["1"]
    reasons = sorted((r["reason"], r["value"]) for r in spark.read.parquet(bad).collect())
    assert reasons == [("empty", " "), ("malformed", '{"broken'), ("no article_id", '{"url": "v"}'), ("no url", '{"article_id": "2"}')]
    # A replayed batch replaces itself.
    run = spark.read.parquet(bad).select("run").first()[0]
    judged = normalize.judged_messages(spark.createDataFrame([(v,) for v in values], "value string"))
    tables.replace_batch(normalize.dead_letters(judged), bad, 0, run)
    assert spark.read.parquet(bad).count() == 4


def test_logs_keep_other_fields_and_broken_lines(spark):
    from articleflow.sources import logs

    values = ['{"service": "a", "line": 7, "user": {"id": 5}, "tags": ["x"], "none": null}', '{"service": "b", "line": "bad"}',
              "{cut", "[1, 2]", '"text"', "", None, "   ", "{}"]
    lines = spark.createDataFrame([(v,) for v in values], "value string")
    rows = logs.decode_logs(lines).select(
        "service", "line", F.variant_get(F.col("extra")["user"], "$.id", "int").alias("user"),
        F.variant_get(F.col("extra")["line"], "$", "string").alias("odd"), F.map_keys("extra").alias("names")).collect()
    found = {r["service"]: (r["line"], r["user"], r["odd"], sorted(r["names"])) for r in rows}
    assert found["a"][:3] == (7, 5, None) and set(found["a"][3]) >= {"tags", "user"} and "service" not in found["a"][3]
    assert found["b"] == (None, None, "bad", ["line"])
    assert found[None] == (None, None, None, []) and len(rows) == 3
    assert sorted(r["value"] for r in logs.broken_lines(lines).collect()) == ['"text"', "[1, 2]", "{cut"]


def test_log_index_replay_on_another_day(spark, root):
    from articleflow.sources import logs

    index = spark.createDataFrame([("m", "2024.01.01")], "message string, day string")
    logs.write_log_index(index, root + "/index", 0, "r")
    logs.write_log_index(index.withColumn("day", F.lit("2024.01.02")), root + "/index", 0, "r")
    stored = spark.read.parquet(root + "/index").select("message", "day").collect()
    assert [tuple(r) for r in stored] == [("m", "2024.01.02")]


def test_late_rows_do_not_reopen_windows(spark, root):
    from articleflow.streaming import logs

    landing = os.path.join(root, "in")

    def run(*times):
        rows = spark.createDataFrame([(t, "s", "INFO") for t in times], "ts string, service string, level string")
        rows.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(landing)
        events = spark.readStream.schema("ts timestamp, service string, level string").parquet(landing)
        logs.level_windows(events, "1 hour", "30 minutes").writeStream.format("parquet").outputMode("append").option(
            "path", os.path.join(root, "out")).option("checkpointLocation", os.path.join(root, "ck")).trigger(
            availableNow=True).start().awaitTermination()
        out = spark.read.schema("window_start timestamp, service string, level string, n long").parquet(os.path.join(root, "out"))
        return sorted((r["window_start"].hour, r["n"]) for r in out.collect())

    assert run("2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-01 01:20:00") == []
    # Within the lateness a row still counts; 01:40 closes the first window.
    assert run("2024-01-01 00:55:00", "2024-01-01 01:40:00") == [(0, 3)]
    assert run("2024-01-01 00:59:00", "2024-01-01 02:45:00") == [(0, 3), (1, 2)]


def test_inserts_read_only_partitions_that_may_hold_a_key(spark, root, monkeypatch):
    from articleflow.operators import keyfilter

    path, schema = os.path.join(root, "t"), "url string, title string"
    for batch_id in range(50):
        rows = [(f"u{batch_id}-{i}", "old") for i in range(20)]
        tables.append_absent(spark.createDataFrame(rows, schema), path, "url", ["title"], batch_id)
    asked = spark.createDataFrame([("u7-3", "new"), ("u31-0", "new"), ("u99-1", "new"), (None, "new")], schema)
    wanted = keyfilter.partitions_to_read(asked, "url", path)
    assert {("run", "7"), ("run", "31")} <= wanted and len(wanted) <= 4
    for _ in range(2):
        tables.append_absent(asked, path, "url", ["title"], 50)
        added = spark.read.parquet(path).filter("title = 'new'")
        # A null key is never the same as another one, as in a unique column.
        assert sorted(r["url"] or "" for r in added.collect()) == ["", "u99-1"]
    # Without filters, and for batches too large to test, everything is read.
    monkeypatch.setattr(keyfilter, "PROBE_KEYS", 1)
    assert keyfilter.partitions_to_read(asked, "url", path) is None
    keyfilter.drop_filter(spark, path, 3, "run")
    monkeypatch.setattr(keyfilter, "PROBE_KEYS", 100)
    assert ("run", "3") in keyfilter.partitions_to_read(asked.limit(0), "url", path)


def test_key_filters():
    import numpy as np

    from articleflow.operators import keyfilter

    draw = np.random.default_rng(1)
    known, foreign = draw.integers(-2**63, 2**63 - 1, 5000), draw.integers(-2**63, 2**63 - 1, 200_000)
    raw = keyfilter._filter(known)
    assert keyfilter._passes(raw, known).all() and keyfilter._passes(raw, foreign).sum() <= 5


def test_rows_whose_key_comes_once_are_not_ranked(spark, root, monkeypatch):
    # Ranking shuffled and sorted whole rows, embeddings included, though hardly any key comes twice.
    def refuse(*_):
        raise AssertionError("ranked")

    monkeypatch.setattr(tables, "first_per_key", refuse)
    path, schema = os.path.join(root, "t"), "chunk_key string, text string, day string"
    order = [F.col("text").asc()]
    tables.upsert_into(spark.createDataFrame([("a", "1", "d1"), ("b", "1", "d2"), (None, "1", "d1")], schema), path, "chunk_key", order)
    # One row moves back to its first day, one stays, one is new.
    tables.upsert_into(spark.createDataFrame([("a", "2", "d2"), ("b", "2", "d2"), ("c", "2", "d3")], schema), path, "chunk_key", order)
    stored = {(r["chunk_key"], r["text"], r["day"]) for r in spark.read.parquet(path).collect()}
    assert stored == {("a", "2", "d1"), ("b", "2", "d2"), ("c", "2", "d3"), (None, "1", "d1")}
    at = os.path.join(root, "absent")
    for batch_id, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")])):
        tables.append_absent(spark.createDataFrame(rows, "url string, title string"), at, "url", ["title"], batch_id)
    assert {(r["url"], r["title"]) for r in spark.read.parquet(at).collect()} == {("a", "1"), ("b", "1"), ("c", "2")}
    monkeypatch.undo()
    twice = spark.createDataFrame([("x", "9", "d1"), ("x", "8", "d4"), (None, "7", "d1"), (None, "6", "d1")], schema)
    tables.upsert_into(twice, os.path.join(root, "u"), "chunk_key", order)
    stored = {(r["chunk_key"], r["text"], r["day"]) for r in spark.read.parquet(os.path.join(root, "u")).collect()}
    assert stored == {("x", "8", "d4"), (None, "6", "d1")}


def test_a_message_is_parsed_once_for_its_verdict(spark):
    texts = ['{"article_id": "1", "url": "u"}', '{"article_id": "2"}', '{"article_id"', " ", None]
    messages = spark.createDataFrame([(t,) for t in texts], "value string").filter("value is null or value <> 'x'")
    good, bad = normalize.quarantine_bad_records(messages)
    both = good.select("article_id").unionByName(bad.select("reason"), allowMissingColumns=True)
    found = sorted((r["article_id"] or "", r["reason"] or "") for r in both.collect())
    assert found == [("", "empty"), ("", "empty"), ("", "malformed"), ("", "no url"), ("1", "")]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 2
