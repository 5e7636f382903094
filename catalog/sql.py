"""Building blocks of the DuckDB twins."""

from __future__ import annotations

from articleflow import constants as C
from articleflow.operators.dedup import permutations
from catalog.registry import DOC_URL, ITEM_URL, SHORT_QUERIES

# The same white-space class as articleflow.constants.WHITESPACE, in RE2 notation.
WS = (r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def uuid5(url: str) -> str:
    h = f"sha1(unhex('{C.URL_NAMESPACE_HEX}') || encode({url}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || "
        f"substr({h}, 21, 12)"
    )


def source_name(url: str) -> str:
    label = f"split_part(replace(split_part({url}, '/', 3), 'www.', ''), '.', 1)"
    runs = rf"regexp_extract_all({label}, '(\p{{L}}+|[^\p{{L}}]+)')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(r[1]) || lower(r[2:])), '')"


_REFERENCES = "MAP {" + ", ".join(
    f"'{name}': '" + chars.replace("'", "''") + "'" for name, chars in C.NAMED_REFERENCES.items()
) + "}"


def html_text(x: str) -> str:
    for tag in ("script", "style", "template"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(1), 'g')"
    x = f"""regexp_replace({x}, '(?s)<[/!?]?[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>', chr(1), 'g')"""
    parts = f"regexp_extract_all({x}, '(&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)')"
    x = f"""array_to_string(list_transform({parts}, lambda r: CASE WHEN r[1] <> '&' THEN r
      WHEN lower(r[2:3]) = '#x' THEN coalesce(chr(TRY_CAST('0x' || r[4:-2] AS INT)), chr(65533))
      WHEN r[2] = '#' THEN coalesce(chr(TRY_CAST(r[3:-2] AS INT)), chr(65533))
      ELSE coalesce({_REFERENCES}[r], r) END), '')"""
    nodes = f"list_transform(string_split({x}, chr(1)), lambda t: {strip('t')})"
    return f"array_to_string(list_filter({nodes}, lambda t: t <> ''), ' ')"


def page_title(x: str) -> str:
    heading = html_text(rf"regexp_extract({x}, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1)")
    title = html_text(rf"regexp_extract({x}, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)")
    return f"coalesce(nullif({heading}, ''), nullif({title}, ''), '')"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


DOCS = f"""
docs AS MATERIALIZED (
  SELECT doc_id, {uuid5(f"('{DOC_URL}' || doc_id)")} AS article_id, '{DOC_URL}' || doc_id AS url,
         lang AS title, text AS content, source, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS scraped_at
  FROM documents)"""

PAGES = f"""
arts AS MATERIALIZED (
  SELECT page_id, {uuid5('url')} AS article_id, url, {page_title('html')} AS title, {html_text('html')} AS content,
         {source_name('url')} AS source, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR AS published_date
  FROM pages)"""

LOG_QUERIES = "log AS MATERIALIZED (SELECT 'turn-' || conv_id || '-' || turn AS query_id, text AS query FROM conversations" + "".join(
    f"\n  UNION ALL SELECT '{name}-' || {key}, {text} FROM {name}" for name, key, text in SHORT_QUERIES
) + ")"

# ------------------------------------------------------------------ MinHash and the filter

SHINGLES = f"""
worded AS (SELECT doc_id, {words("lower(title || ' ' || content)")} AS w FROM docs),
shingled AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN CAST([] AS VARCHAR[]) ELSE
    list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh
  FROM worded)"""

_A, _B = permutations()
_PERMS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(_A.tolist(), _B.tolist())))
SIGNATURES = f"""
perms(i, a, b) AS (VALUES {_PERMS}),
hashed AS MATERIALIZED (
  SELECT doc_id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS h
  FROM (SELECT doc_id, sha1(s) AS h FROM (SELECT doc_id, unnest(sh) AS s FROM shingled))),
mixed AS (SELECT doc_id, i, CAST((CAST(a AS HUGEINT) * h + b) & 18446744073709551615 AS UBIGINT) AS x FROM hashed, perms),
folded AS (SELECT doc_id, i, (x & 2305843009213693951) + (x >> 61) AS y FROM mixed),
minima AS (
  SELECT doc_id, i, min(CASE WHEN y >= 2305843009213693951 THEN y - 2305843009213693951 ELSE y END & 4294967295) AS m
  FROM folded GROUP BY doc_id, i),
sigs AS MATERIALIZED (
  SELECT d.doc_id, coalesce(s.sig, list_transform(range(128), lambda x: CAST(4294967295 AS UBIGINT))) AS sig
  FROM docs d LEFT JOIN (SELECT doc_id, list(m ORDER BY i) AS sig FROM minima GROUP BY doc_id) s USING (doc_id))"""
SLOTS = """
slots AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT doc_id, '{i}:' || md5(array_to_string(sig[{1 + 42 * i}:{42 * (i + 1)}], ',')) AS bucket FROM sigs"
    for i in range(3)
) + ")"


def _rounds(n: int) -> str:
    parts = ["und0 AS MATERIALIZED (SELECT doc_id FROM docs)"]
    for r in range(n):
        parts.append(f"""
first{r} AS MATERIALIZED (SELECT bucket, min(doc_id) AS f FROM slots WHERE doc_id IN (FROM und{r}) GROUP BY bucket),
win{r} AS MATERIALIZED (SELECT doc_id FROM slots JOIN first{r} USING (bucket) WHERE doc_id IN (FROM und{r})
  GROUP BY doc_id HAVING bool_and(doc_id = f)),
lose{r} AS MATERIALIZED (SELECT DISTINCT doc_id FROM slots WHERE doc_id IN (FROM und{r}) AND doc_id NOT IN (FROM win{r})
  AND bucket IN (SELECT bucket FROM slots WHERE doc_id IN (FROM win{r}))),
und{r + 1} AS MATERIALIZED (FROM und{r} WHERE doc_id NOT IN (FROM win{r}) AND doc_id NOT IN (FROM lose{r}))""")
    lost = f" UNION ALL SELECT CAST(error('more rounds are needed') AS BIGINT) FROM und{n}"
    parts.append("kept AS MATERIALIZED (" + " UNION ALL ".join(f"FROM win{r}" for r in range(n)) + lost + ")")
    return ",".join(parts)


# The filter's fixpoint, six rounds unrolled (the given tables settle within three); it fails if a document is left undecided.
_FILTER = f"{SHINGLES},{SIGNATURES},{SLOTS},{_rounds(6)}"
KEPT = f"{DOCS},{_FILTER}"
# The same filter over pages.
KEPT_PAGES = f"""{PAGES},
docs AS MATERIALIZED (SELECT page_id AS doc_id, article_id, url, title, content, source FROM arts),{_FILTER}"""

# ------------------------------------------------------------------ retrieval

STEP = C.CHUNK_SIZE - C.CHUNK_OVERLAP
CHUNKS = f"""
pieces AS (
  SELECT doc_id, article_id, url, title, source,
         list_filter(list_transform(range(0, greatest(len(content) - {C.CHUNK_OVERLAP}, 1), {STEP}),
           lambda o: substr(content, o + 1, {C.CHUNK_SIZE})), lambda x: trim(x) <> '') AS c
  FROM docs),
chunks AS MATERIALIZED (
  SELECT doc_id, article_id, url, title, source, i - 1 AS chunk_id, c[i] AS text,
         sha1(url || '#' || (i - 1)) AS chunk_key
  FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM pieces))"""


def _recursive_chunks(size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> str:
    """The recursive split as a work list of (span, separator level).

    A span without its level's separator goes to the next level. One with it is cut in front of each separator; pieces
    of at least ``size`` go on, runs of shorter ones are packed. A chunk that starts at piece f ends before the first
    piece x that does not fit; the next one starts at the first piece behind f that leaves at most the overlap and lets
    x fit, else at x. Spans of the last level are cut into fixed windows.
    """
    marks = [m for m in C.CHUNK_SEPARATORS if m]
    parts = ["span0 AS (SELECT doc_id, 0 AS lo, len(content) AS hi FROM docs WHERE content <> '')"]
    for n, text in enumerate(marks):
        mark = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in text)
        parts.append(f"""
split{n} AS MATERIALIZED (SELECT doc_id, lo, hi, string_split(substr(content, lo + 1, hi - lo), {mark}) AS parts
  FROM span{n} JOIN docs USING (doc_id)),
ends{n} AS (SELECT doc_id, lo, k, lo + {len(text)} * (k - 1) + sum(len(part)) OVER (PARTITION BY doc_id, lo ORDER BY k) AS b
  FROM (SELECT doc_id, lo, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k FROM split{n} WHERE len(parts) > 1)),
pieces{n} AS (SELECT doc_id, lo, k, lag(b, 1, lo) OVER (PARTITION BY doc_id, lo ORDER BY k) AS a, b FROM ends{n}),
ran{n} AS MATERIALIZED (SELECT *, b - a >= {size} AS big, count(*) FILTER (b - a >= {size}) OVER (
    PARTITION BY doc_id, lo ORDER BY k) AS run FROM pieces{n} WHERE b > a),
span{n + 1} AS MATERIALIZED (SELECT doc_id, lo, hi FROM split{n} WHERE len(parts) = 1
  UNION ALL SELECT doc_id, a, b FROM ran{n} WHERE big)""")
    runs = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS level, lo, run, list(a ORDER BY k) AS s, list(b ORDER BY k) AS e FROM ran{n} WHERE NOT big "
        "GROUP BY doc_id, lo, run" for n in range(len(marks)))
    step = size - overlap
    parts.append(f"""
runs AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM ({runs})),
packed AS (
  SELECT id, 1 AS f, list_min(list_filter(range(2, len(e) + 1), lambda y: e[y] - s[1] > {size})) AS x FROM runs
  UNION ALL
  SELECT id, g, list_min(list_filter(range(x + 1, len(e) + 1), lambda y: e[y] - s[g] > {size})) FROM (
    SELECT id, s, e, x, coalesce(list_min(list_filter(range(f + 1, x), lambda j: s[x] - s[j] <= {overlap}
      AND e[x] - s[j] <= {size})), x) AS g FROM packed JOIN runs USING (id) WHERE x IS NOT NULL)),
spans AS (
  SELECT doc_id, s[f] AS a, CASE WHEN x IS NULL THEN e[-1] ELSE s[x] END AS b FROM packed JOIN runs USING (id)
  UNION ALL
  SELECT doc_id, a, least(a + {size}, hi) FROM (SELECT doc_id, hi, lo + {step} * unnest(range(0, 1 + CAST(
    ceil(greatest(hi - lo - {size}, 0) / {step}) AS INT))) AS a FROM span{len(marks)})),
rchunks AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INT) AS chunk_id, text
  FROM (SELECT doc_id, a, {strip('substr(content, CAST(a AS INT) + 1, CAST(b - a AS INT))')} AS text
        FROM spans JOIN docs USING (doc_id)) WHERE text <> '')""")
    return ",".join(parts)


RECURSIVE_CHUNKS = _recursive_chunks()


def embed(name: str, source: str, key: str, text: str, dim: int = C.EMBEDDING_DIM) -> str:
    """Sparse float32 embedding rows (key, dim, x) of ``source``."""
    return f"""
{name}_tok AS (SELECT {key}, md5(unnest({tokens(text)})) AS h FROM {source}),
{name}_raw AS (SELECT {key}, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {dim} AS dim,
  sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM {name}_tok GROUP BY ALL HAVING v <> 0),
{name} AS MATERIALIZED (SELECT {key}, dim,
  CAST(CAST(CAST(v AS DOUBLE) / sqrt(CAST(sum(v * v) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS x
  FROM {name}_raw)"""


REQUESTS = "reqs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def dense(k: int) -> str:
    return f"""{embed('qv', 'reqs', 'query_id', 'query')},{embed('cv', 'chunks', 'chunk_key', 'text')},
qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qv GROUP BY 1),
cn AS (SELECT chunk_key, sqrt(sum(x * x)) AS n FROM cv GROUP BY 1),
cosines AS (SELECT query_id, chunk_key AS id, round(sum(q.x * c.x) / any_value(qn.n) / any_value(cn.n), 6) AS score
  FROM qv q JOIN cv c USING (dim) JOIN qn USING (query_id) JOIN cn USING (chunk_key) GROUP BY 1, 2),
dense AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM cosines) WHERE rank <= {k})"""


def bm25(k: int) -> str:
    return f"""
qt AS (SELECT query_id, unnest(list_distinct({tokens('query')})) AS term FROM reqs),
ct AS MATERIALIZED (SELECT chunk_key, unnest({tokens('text')}) AS term FROM chunks),
lens AS (SELECT chunk_key, len({tokens('text')}) AS n FROM chunks),
tf AS MATERIALIZED (SELECT chunk_key, term, count(*) AS tf FROM ct WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM chunks) - count(*) + 0.5) / (count(*) + 0.5)) AS w
  FROM tf GROUP BY term),
scores AS (SELECT query_id, chunk_key AS id, round(sum(w * tf * {C.BM25_K1 + 1} / (tf + {C.BM25_K1} *
    (1 - {C.BM25_B} + {C.BM25_B} * n / (SELECT sum(n) / count(*) FROM lens)))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (chunk_key) GROUP BY 1, 2),
keyword AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scores WHERE score > 0) WHERE rank <= {k})"""


def hybrid(k: int) -> str:
    return f"""{dense(k)},{bm25(k)},
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / ({C.RRF_K} + rank)), 6) AS score, max(ds) AS dense_score
  FROM (SELECT query_id, id, rank, score AS ds FROM dense UNION ALL SELECT query_id, id, rank, NULL FROM keyword)
  GROUP BY 1, 2),
hybrid AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM fused) WHERE rank <= {k}),
hits AS MATERIALIZED (SELECT h.*, c.text, c.article_id, c.source, r.query FROM hybrid h
  JOIN chunks c ON c.chunk_key = h.id JOIN reqs r USING (query_id))"""


def search(k: int) -> str:
    return f"{DOCS},{CHUNKS},{REQUESTS},{hybrid(k)}"


RERANKED = f"""
rescored AS (SELECT *, round(CASE WHEN len(qterms) > 0 THEN len(list_intersect(qterms, cterms)) / len(qterms) ELSE 0 END
    + coalesce(dense_score, 0), 6) AS rerank_score
  FROM (SELECT *, list_distinct({tokens('query')}) AS qterms, list_distinct({tokens('text')}) AS cterms
        FROM hits WHERE text <> '')),
reranked AS MATERIALIZED (SELECT * EXCLUDE (rank, new_rank), new_rank AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS new_rank FROM rescored) WHERE new_rank <= {C.RERANKED})"""


def local_context(hits: str, name: str) -> str:
    return f"""
{name}_src AS (SELECT query_id, list(source ORDER BY r) AS sources FROM
  (SELECT query_id, source, min(rank) AS r FROM {hits} WHERE text <> '' GROUP BY 1, 2) GROUP BY 1),
{name} AS MATERIALIZED (SELECT query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) AS context,
    any_value(sources) AS sources
  FROM {hits} JOIN {name}_src USING (query_id) WHERE text <> '' GROUP BY 1)"""


# External hits: every document is a hit of the request numbered doc_id modulo the number of requests; the number in its
# source name decides which outside source found it. Benchmark items are further hits: half have an empty page, half none.
def outside(caps: dict[str, int]) -> str:
    news, web, papers = (caps[n] for n in C.EXTERNAL_SOURCES)
    return f"""
landed AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, CAST(substr(source, 4) AS INT) % 3 AS source_no,
    doc_id AS rank, 'Hit ' || doc_id AS title, '{DOC_URL}' || doc_id AS link,
    CASE WHEN lang = 'en' THEN NULL ELSE source END AS publisher, text AS summary FROM documents
  UNION ALL SELECT item_id % (SELECT count(*) FROM benchmark), CAST(item_id % 3 AS INT), -1 - item_id, 'Hit b' || item_id,
    '{ITEM_URL}' || item_id, NULL, text FROM benchmark),
outside AS MATERIALIZED (SELECT query_id, source_no, rank, title, link, summary,
    CASE source_no WHEN 0 THEN coalesce(publisher, '{C.HIT_SOURCE_NAMES['news']}')
      WHEN 1 THEN '{C.HIT_SOURCE_NAMES['web']}' ELSE '{C.HIT_SOURCE_NAMES['papers']}' END AS source
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_no ORDER BY rank) AS n FROM landed)
  WHERE n <= CASE source_no WHEN 0 THEN {news} WHEN 1 THEN {web} ELSE {papers} END)"""


ENRICHED = f"""
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_no, rank) AS ordinal
  FROM outside) WHERE ordinal <= {C.MERGED_HITS}),
bodies AS (SELECT '{DOC_URL}' || doc_id AS link, 'Body: ' || text AS body FROM documents
  UNION ALL SELECT '{ITEM_URL}' || item_id, '' FROM benchmark WHERE item_id % 2 = 0),
enriched AS MATERIALIZED (SELECT m.*, coalesce(nullif(body, ''), summary) AS content
  FROM merged m LEFT JOIN bodies USING (link))"""

WEB = f"""
web AS MATERIALIZED (SELECT query_id, string_agg('[Article ' || ordinal || ']' || chr(10) || 'Title: ' || title || chr(10) ||
    'Source: ' || source || chr(10) || 'Link: ' || link || chr(10) || 'Content: ' ||
    content || '...' || chr(10), chr(10) || '---' || chr(10) ORDER BY ordinal) AS context,
    list(source || ' - ' || link ORDER BY ordinal) AS sources
  FROM enriched GROUP BY 1)"""


def contains_any(x: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


QUALITY = """
quality AS MATERIALIZED (SELECT r.query_id, CAST(count(h.id) AS INT) AS n_hits,
    coalesce(bool_or(len(STRIPPED) > 50), false) AS meaningful,
    count(h.id) < 2 OR NOT coalesce(bool_or(len(STRIPPED) > 50), false) AS insufficient
  FROM reqs r LEFT JOIN hits h USING (query_id) GROUP BY 1)""".replace("STRIPPED", strip("h.text"))


_TERMS = ", ".join(f"('{t}')" for t in C.COMPANY_TERMS)
# Longest common subsequence by a recursive walk over the query's characters, one row of cell values per step. The score
# is exact where the threshold can be reached, else 0: only its comparison with the threshold is reported.
FUZZY = f"""
terms(term) AS (VALUES {_TERMS}),
bare AS (SELECT DISTINCT query, lower(replace(query, ' ', '')) AS q FROM log),
near AS (SELECT DISTINCT q, term FROM bare, terms
  WHERE NOT contains(term, q) AND NOT contains(q, term)
    AND 2.0::DOUBLE * least(len(q) - len(translate(q, term, '')), len(term)) / (len(q) + len(term)) >= {C.FUZZY_THRESHOLD}),
walk AS (
  SELECT q, term, 0 AS i, list_transform(range(0, len(term) + 1), lambda x: CAST(0 AS BIGINT)) AS cells FROM near
  UNION ALL
  SELECT q, term, i + 1, list_transform(range(0, len(term) + 1), lambda p: coalesce(list_max(list_transform(
      range(1, p + 1), lambda j: greatest(cells[j + 1], cells[j] + CASE WHEN term[j] = q[i + 1] THEN 1 ELSE 0 END))), 0))
  FROM walk WHERE i < len(q)),
lcs AS (SELECT q, term, 2.0::DOUBLE * cells[len(term) + 1] / (len(q) + len(term)) AS ratio FROM walk WHERE i = len(q)),
fuzzy AS MATERIALIZED (SELECT b.query, t.term, CASE WHEN b.query = '' THEN 0.0::DOUBLE
    WHEN contains(t.term, b.q) OR contains(b.q, t.term) THEN 1.0 ELSE coalesce(l.ratio, 0.0) END AS score
  FROM bare b CROSS JOIN terms t LEFT JOIN lcs l ON l.q = b.q AND l.term = t.term)"""

PREFIX = f"""
terms(term) AS (VALUES {_TERMS}),
bare AS (SELECT DISTINCT query, lower(replace(query, ' ', '')) AS q FROM log),
walk AS (
  SELECT q, term, 0 AS i, 0 AS pos, true AS alive FROM (SELECT DISTINCT q FROM bare), terms
  UNION ALL
  SELECT q, term, i + 1, pos + strpos(substr(term, pos + 1), q[i + 1]), strpos(substr(term, pos + 1), q[i + 1]) > 0
  FROM walk WHERE i < len(q) AND alive),
prefix AS (SELECT q, term, max(CASE WHEN alive THEN i ELSE 0 END) AS hits FROM walk GROUP BY 1, 2)"""

INTENT = f"""CASE WHEN q = '' OR q IN ({', '.join(repr(g) for g in C.GREETINGS)})
  OR (len({words('q')}) <= 2 AND NOT regexp_matches(q, '\\p{{Nd}}')) THEN 'smalltalk' ELSE 'factual' END"""
