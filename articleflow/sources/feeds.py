"""Landed feed files and web pages to feed entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions import text as X
from articleflow.operators.joins import small_side
from articleflow.schemas import FEED_ELEMENT

# Whole items and entries, with or without a name-space prefix. A CDATA section is passed over as one; comments go first.
_ELEMENT = r"(?s)<(?:\w+:)?(item|entry)(?=[\s>])[^>]*+>(?:[^<]++|<!\[CDATA\[.*?\]\]>|<(?!/(?:\w+:)?\1\s*>))*+</(?:\w+:)?\1\s*>"
# What matches is either a CDATA section, which stays, or a comment, which goes.
_COMMENT = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!--.*?-->"


def feed_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(file, content) of the feed files below a landing folder, whole, in one scan or as a stream."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), "content")


def landing_folder(file: Column) -> Column:
    """Name of the folder a file lies in: the fetcher lands each feed in a folder of its own."""
    return F.url_decode(F.element_at(F.split(file, "/"), -2))


def _decoded(content: Column) -> Column:
    """File content as text, by the encoding its XML declaration names."""
    start = F.decode(F.substring(content, 1, 100), "ISO-8859-1")
    declared = F.upper(F.regexp_extract(start, r"""encoding=["']([A-Za-z0-9-]+)["']""", 1))
    # UTF-16 files begin with a byte order mark.
    marked = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    return (
        F.when(marked, F.decode(content, "UTF-16"))
        .when(declared == "ISO-8859-1", F.decode(content, "ISO-8859-1"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def feed_elements(files: DataFrame) -> DataFrame:
    """(file, place, element, corrupt) of every item or entry in (file, content) rows, RSS and Atom alike.

    A broken element is kept as text in ``corrupt`` and does not stop its file. Comments hold no elements.
    """
    text = _decoded(F.col("content"))
    bare = F.regexp_replace(text, _COMMENT, "$1")
    found = files.select("file", F.posexplode(F.regexp_extract_all(bare, F.lit(_ELEMENT), 0)).alias("place", "xml"))
    layout = T.StructType(FEED_ELEMENT.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_xml("xml", layout, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "true"})
    return found.withColumn("element", parsed).select(
        "file", "place", "element", F.col("element._corrupt").alias("corrupt"))


def _some(column: Column) -> Column:
    """A value with its ends trimmed, null if nothing is left."""
    return F.nullif(X.strip(column), F.lit(""))


def element_entries(elements: DataFrame) -> DataFrame:
    """Feed elements to entries: (file, place, link, title, summary, author, published, tags, corrupt).

    The link is the element's own, for Atom its first alternate one, else a guid that is a permalink. The summary is the
    description or summary, else the content. Tags are null where there are none.
    """
    e = F.col("element")
    own = F.filter(e["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
    link = F.get(F.filter(F.transform(own, lambda l: F.coalesce(_some(l["_href"]), _some(l["_VALUE"]))),
                          lambda l: l.isNotNull()), 0)
    permalink = F.when(F.lower(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true"))) != "false", _some(e["guid"]["_VALUE"]))
    authors = F.filter(
        F.concat(
            F.coalesce(F.transform(e["author"], lambda a: F.coalesce(_some(a["name"]), _some(a["_VALUE"]))),
                       F.array().cast("array<string>")),
            F.coalesce(F.transform(e["dc:creator"], _some), F.array().cast("array<string>"))),
        lambda a: a.isNotNull())
    tags = F.filter(F.transform(e["category"], lambda c: F.coalesce(_some(c["_term"]), _some(c["_VALUE"]))),
                    lambda t: t.isNotNull())
    texts = [F.nullif(e[name], F.lit("")) for name in ("description", "summary", "content", "content:encoded")]
    return elements.select(
        "file", "place", F.coalesce(link, permalink).alias("link"), _some(e["title"]).alias("title"),
        reduce(lambda a, b: F.coalesce(a, b), texts).alias("summary"), F.get(authors, 0).alias("author"),
        F.coalesce(_some(e["pubDate"]), _some(e["published"])).alias("published"),
        F.when(F.size(tags) > 0, tags).alias("tags"), "corrupt",
    )


def landed_entries(files: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected elements) of landed feed files, as a batch or as a stream.

    ``feeds`` (folder, feed_url) names the feed whose files lie in a folder; it is a static table. An element that is
    no XML, has no link, or lies in a folder that is no feed's, is rejected: (file, place, reason, xml). Entries:
    (feed_url, link, title, summary, author, published, tags, file, place).
    """
    known = small_side(feeds.select("folder", "feed_url").distinct())
    folder = landing_folder(F.col("file"))
    joined = element_entries(feed_elements(files)).withColumn("folder", folder).join(known, "folder", "left")
    reason = (
        F.when(F.col("corrupt").isNotNull(), "malformed").when(F.col("link").isNull(), "no link")
        .when(F.col("feed_url").isNull(), "unknown feed")
    )
    judged = joined.withColumn("reason", reason)
    entries = judged.filter("reason is null").select(
        "feed_url", "link", "title", "summary", "author", "published", "tags", "file", "place")
    return entries, judged.filter("reason is not null").select("file", "place", "reason", F.col("corrupt").alias("xml"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Landed pages (url, html): one entry per page, titled by its first heading, else by its title element.

    Further columns of ``pages`` stay.
    """
    html = F.col("html")
    heading = X.html_to_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1))
    title = X.html_to_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))
    others = [c for c in pages.columns if c not in ("url", "html")]
    return pages.select(
        *others, F.col("url").alias("feed_url"), F.col("url").alias("link"),
        X.first_non_empty(heading, title).alias("title"), html.alias("summary"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("published"),
        F.lit(None).cast("array<string>").alias("tags"),
    )
