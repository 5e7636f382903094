import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.functions import fuzzy
from articleflow.functions import text as X
from articleflow.operators import routing


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("url", ["https://example.org/a?b=c", "http://münchen.example/ü", ""])
def test_url_uuid_is_version_five(spark, url):
    assert value(spark, X.url_uuid(F.col("x")), url) == str(uuid.uuid5(uuid.NAMESPACE_URL, url))


@pytest.mark.parametrize("text", ["a  b\tc", "  x y\x1cz　", "", "\n\n", "x\x85y"])
def test_words_split_like_python(spark, text):
    assert value(spark, X.words(F.col("x")), text) == text.split()
    assert value(spark, X.strip(F.col("x")), text) == text.strip()


@pytest.mark.parametrize("url, name", [
    ("https://www.the-verge.example/rss", "The-Verge"),
    ("http://3com.example.org/feed", "3Com"),
    ("https://news.example.com/rss", "News"),
])
def test_source_name(spark, url, name):
    assert value(spark, X.source_name(F.col("x")), url) == name


@pytest.mark.parametrize("html, text", [
    ("<p>One <b>two</b>  three</p>", "One two three"),
    ("a<script>var x='<p>no</p>'</script>b<style>p{}</style>c<!-- <p>no</p> -->d", "a b c d"),
    ('<a title="x > y">link</a> 1 < 2', "link 1 < 2"),
    ("&amp;lt; &#39;q&#39; &#x1F600; &eacute;&nbsp;", "&lt; 'q' \U0001F600 é"),
    ("&ouml;&ntilde; &#38;lt; &#x10FFFF; &#0000000065; &#x000000041; & &nope; &AMP;", "öñ &lt; \U0010FFFF A A & &nope; &"),
    ("a&#xD800;b&#99999999999999999999;c&#x110000;d&#0;", "a\ufffdb\ufffdc\ufffdd\ufffd"),
    ("<p>  inner  space </p>", "inner  space"),
    ("", ""),
])
def test_html_to_text(spark, html, text):
    assert value(spark, X.html_to_text(F.col("x")), html) == text


@pytest.mark.parametrize("text, expected", [
    ("Mon, 05 Feb 2024 10:00:00 +0100", dt.datetime(2024, 2, 5, 9)),
    ("5 Feb 2024 10:00:00 GMT", dt.datetime(2024, 2, 5, 10)),
    ("2024-02-05T10:00:00Z", dt.datetime(2024, 2, 5, 10)),
    ("2024-02-05", dt.datetime(2024, 2, 5)),
    ("February 5, 2024", dt.datetime(2024, 2, 5)),
    ("soon", dt.datetime(2000, 1, 1)),
    (None, dt.datetime(2000, 1, 1)),
])
def test_lenient_timestamp(spark, text, expected):
    when = X.lenient_timestamp(F.col("x"), F.to_timestamp(F.lit("2000-01-01 00:00:00")))
    assert value(spark, F.date_format(when, "yyyy-MM-dd HH:mm:ss"), text) == expected.strftime("%Y-%m-%d %H:%M:%S")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (x == y)))
        row = new
    return row[-1]


TERMS = ("anthropic", "openai", "claude", "chatgpt", "mistral")


def test_indel_ratio(spark):
    texts = ["anthriopc", "tellmeaboutanthriopc", "opnai", "claud", "mistrl", "xyz", "", "chatgp", "anthropics", "ai"]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = frame.select("x", *[F.struct(
        fuzzy.indel_ratio(F.col("x"), t).alias("ratio"), fuzzy.fuzzy_match(fuzzy.bare(F.col("x")), t).alias("match")
    ).alias(t) for t in TERMS]).collect()
    assert len(rows) == len(texts)
    for row in rows:
        for term in TERMS:
            ratio = 2 * lcs(row["x"], term) / (len(row["x"]) + len(term))
            inside = bool(row["x"]) and (row["x"] in term or term in row["x"])
            assert row[term]["ratio"] == pytest.approx(ratio)
            assert row[term]["match"] == (inside or ratio >= 0.6)


@pytest.mark.parametrize("text, score", [("anthriopc", 6 / 9), ("anth", 1.0), ("zzz", 0.0), ("apx", 2 / 3), (" ", 0.0)])
def test_prefix_score(spark, text, score):
    assert value(spark, fuzzy.prefix_score(fuzzy.bare(F.col("x")), "anthropic"), text) == pytest.approx(score)


@pytest.mark.parametrize("query, expected", [
    ("", "smalltalk"), ("hi", "smalltalk"), ("Good Morning ", "smalltalk"), ("gpt 5", "factual"),
    ("anthropic news", "smalltalk"), ("what is new", "factual"), (None, "smalltalk"), ("  ", "smalltalk"),
])
def test_intent(spark, query, expected):
    assert value(spark, routing.intent(F.col("x")), query) == expected


@pytest.mark.parametrize("query, expected", [
    ("Look elsewhere for chips", "latest news about Look  for chips"),
    ("find it ELSEWHERE", "latest news about ELSEWHERE"),
    ("plain query", "plain query"),
])
def test_search_rewrite(spark, query, expected):
    assert value(spark, routing.search_rewrite(F.col("x")), query) == expected


@pytest.mark.parametrize("query, enough, reasons", [
    ("What is Anthropic and who founded it?", True, ["recency keywords", "possible typo/fuzzy match"]),
    ("Tell me about anthriopc", True, []),
    ("Tell me about anthriopc", False, ["insufficient local data"]),
    ("What are the latest developments in AI?", True, ["recency keywords"]),
    ("What happened with OpenAI today?", True, ["recency keywords", "possible typo/fuzzy match"]),
    ("please search the web for renewal", False, ["explicit request", "recency keywords", "insufficient local data"]),
])
def test_routing_reasons(spark, query, enough, reasons):
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    quality = spark.createDataFrame([(1, not enough)], "query_id int, insufficient boolean")
    row = routing.route_queries(asked, quality).first()
    assert (row["reasons"], row["use_external"]) == (reasons, bool(reasons))


def test_meaningful_results(spark):
    asked = spark.createDataFrame([(i,) for i in range(4)], "query_id int")
    hits = spark.createDataFrame([
        (0, "x" * 51), (0, ""), (1, "x" * 51), (2, " " * 60), (2, "x" * 50),
    ], "query_id int, text string")
    rows = {r["query_id"]: (r["n_hits"], r["meaningful"], r["insufficient"])
            for r in routing.meaningful_results(asked, hits).collect()}
    assert rows == {0: (2, True, False), 1: (1, True, True), 2: (2, False, True), 3: (0, False, True)}


def test_white_space_helpers_agree_with_their_plain_forms(spark):
    import random

    draw = random.Random(2)
    signs = [chr(x) for x in [*range(0, 0x21), 0x7F, *range(0x80, 0xA2), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028,
                              0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x1F600]] + list("abé日") * 12
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 9))) for _ in range(2000)] + ["", " \n" * 500 + "x"]
    rows = spark.createDataFrame([(None,), *[(t,) for t in texts]], "t string")
    ends = F.regexp_replace("t", f"^{C.WHITESPACE}+|{C.WHITESPACE}+$", "")
    cut = F.array_remove(F.split("t", C.WHITESPACE + "+"), "")
    assert rows.filter(~(X.strip(F.col("t")).eqNullSafe(ends) & X.words(F.col("t")).eqNullSafe(cut))).count() == 0
    assert rows.filter(X.blank(F.col("t")) != (F.coalesce(ends, F.lit("")) == "")).count() == 0


def test_strip_does_not_search_inner_white_space(spark):
    """Runs of white space inside a text are passed once; a search from each of them is quadratic."""
    import time

    text = "a" + " " * 100_000 + "b"
    begun = time.perf_counter()
    row = spark.createDataFrame([(text,)], "t string").select(X.strip(F.col("t")).alias("s"), X.blank(F.col("t"))).first()
    assert row[0] == text and not row[1] and time.perf_counter() - begun < 10
