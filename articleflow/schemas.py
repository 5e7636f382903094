"""Record layouts of the messages and tables."""

from pyspark.sql import types as T

ARTICLE = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_date", T.TimestampType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("metadata", T.StructType([T.StructField("word_count", T.IntegerType())])),
])

CHUNK = T.StructType([
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# Either {article, chunks} or the bare article fields at the top level.
ENVELOPE = T.StructType(
    [T.StructField("article", ARTICLE), T.StructField("chunks", T.ArrayType(CHUNK))] + ARTICLE.fields
)

LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("logger", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("function", T.StringType()),
    T.StructField("exception", T.StringType()),
])

_LINK = T.StructType([
    T.StructField("_VALUE", T.StringType()), T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType()),
])

# One element of a feed, whichever form it has: RSS items and Atom entries share what they have in common.
FEED_ELEMENT = T.StructType([
    T.StructField("link", T.ArrayType(_LINK)),
    T.StructField("guid", T.StructType([
        T.StructField("_VALUE", T.StringType()), T.StructField("_isPermaLink", T.StringType())])),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("content:encoded", T.StringType()),
    T.StructField("author", T.ArrayType(T.StructType([
        T.StructField("_VALUE", T.StringType()), T.StructField("name", T.StringType())]))),
    T.StructField("dc:creator", T.ArrayType(T.StringType())),
    T.StructField("pubDate", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("category", T.ArrayType(T.StructType([
        T.StructField("_VALUE", T.StringType()), T.StructField("_term", T.StringType())]))),
])
