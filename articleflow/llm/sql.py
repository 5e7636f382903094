"""DuckDB twins of the queries that SQL can express. They follow the definitions, not the operators' steps."""

from articleflow.llm.licenses import RULES, SENTENCES

_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body, text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS place
  FROM docs
),
normal AS (
  SELECT doc_id, place, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM lines
),
counted AS (
  SELECT doc_id, place, norm, len(string_split(norm, ' ')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth
  FROM normal WHERE norm <> ''
),
runs AS (
  SELECT a.doc_id, a.nth AS first_nth, b.nth AS last_nth, a.place AS first, b.place AS last
  FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.nth BETWEEN a.nth AND a.nth + 50
),
measured AS (
  SELECT r.doc_id, r.first, r.last, string_agg(c.norm, chr(10) ORDER BY c.nth) AS content, sum(c.words) AS words,
         sum(c.words) - min_by(c.words, c.nth) AS without_first, sum(c.words) - max_by(c.words, c.nth) AS without_last
  FROM runs r JOIN counted c ON c.doc_id = r.doc_id AND c.nth BETWEEN r.first_nth AND r.last_nth
  GROUP BY r.doc_id, r.first, r.last
),
windows AS (SELECT * FROM measured WHERE words >= 50 AND (without_first < 50 OR without_last < 50)),
earliest AS (
  SELECT content, min((doc_id, first, last)) AS place FROM windows GROUP BY content HAVING count(*) > 1
),
repeated AS (
  SELECT w.doc_id, w.first, w.last FROM windows w JOIN earliest e USING (content)
  WHERE w.doc_id <> e.place[1] OR e.place[3] < w.first
),
gone AS (
  SELECT DISTINCT l.doc_id, l.place FROM lines l JOIN repeated r
  ON l.doc_id = r.doc_id AND l.place BETWEEN r.first AND r.last
),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL) AS text,
         count(g.place) AS removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN k.removed > 0 THEN coalesce(k.text, '') ELSE d.text END AS text,
       k.removed AS n_removed_lines
FROM docs d JOIN kept k USING (doc_id)
"""

NEAR_DUP = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN [w[1]] ELSE w[i:i + 1] END AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM split WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 80 * (x.n + y.n - m)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a
),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of l USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), {_ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), {_ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, w[i + 1:i + 13] AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM iw WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT k, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, lengths WHERE len(w) >= n),
met AS (SELECT p.k, p.i, p.n, x.item_id FROM places p JOIN windows x ON x.win = p.w[p.i + 1:p.i + p.n]),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM met) GROUP BY k),
named AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM met WHERE item_id IS NOT NULL) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (k) LEFT JOIN named USING (k)
"""


def licenses() -> str:
    """Pieces of texts are walked through from left to right: behind the number of a clause or not, the longest wording
    that ends where a piece does is a sentence, else the piece is one. Then rules one after the other on the chain of
    identifiers. Texts without any wording need no walk."""
    named = {wording: sid for sid, wording in SENTENCES}
    wordings = ", ".join(f"('{wording}', '{sid}')" for wording, sid in named.items())
    known = "[" + ", ".join(f"'{w}'" for w in sorted(named, key=lambda w: (-len(w), w))) + "]"
    steps, last = [], "chains"
    for nth, (_, rule) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in rule)
        steps.append(
            f"step_{nth} AS (SELECT * REPLACE (replace(chain, '{pattern}', '#') AS chain), "
            f"(len(chain) - len(replace(chain, '{pattern}', ''))) // {len(pattern)} AS hits_{nth} FROM {last})")
        last = f"step_{nth}"
    names = list(dict.fromkeys(name for name, _ in RULES))
    found = ", ".join(
        "CASE WHEN " + " + ".join(f"hits_{i}" for i, (n, _) in enumerate(RULES) if n == name) + f" > 0 THEN '{name}' END"
        for name in names)
    return rf"""
WITH RECURSIVE wordings(wording, sid) AS (VALUES {wordings}),
rows AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, list_filter(list_transform(
  string_split_regex(regexp_replace(coalesce(text, ''), '([.!?:;])[ \t\r\n\f]+', '\1' || chr(10), 'g'), '[\r\n]+'),
  lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS normal FROM documents),
lines AS MATERIALIZED (SELECT k, '|' || array_to_string(normal, '|') || '|' AS p,
  ' ' || array_to_string(normal, ' ') || ' ' AS q FROM rows),
told AS MATERIALIZED (SELECT * FROM lines WHERE len(list_filter({known}, lambda w: contains(q, w))) > 0),
walk AS (
  SELECT k, 0 AS i, 1 AS pos, CAST(NULL AS VARCHAR) AS sentence FROM told
  UNION ALL
  SELECT k, i + 1, CAST(e AS INT), substr(q, s, e - s) FROM (
    SELECT *, coalesce(s + len(wording), s - 1 + strpos(substr(p, s), '|')) AS e FROM (
      SELECT *, list_filter({known}, lambda w: substr(q, s, len(w)) = w AND substr(p, s + len(w), 1) = '|')[1] AS wording FROM (
        SELECT *, pos + 1 + CASE WHEN len(list_filter({known}, lambda w: substr(q, pos + 1 + number, len(w)) = w)) > 0
          THEN number ELSE 0 END AS s FROM (
          SELECT k, i, pos, p, q, len(regexp_extract(substr(p, pos + 1, 5), '^(?:[0-9]{{1,2}}|[a-z]|[ivx]{{1,4}})[ |]')) AS number
          FROM walk JOIN told USING (k) WHERE pos < len(p)))))),
places AS (SELECT k, sentence, i FROM walk WHERE i > 0
  UNION ALL SELECT k, unnest(normal), unnest(range(len(normal))) FROM rows WHERE k NOT IN (SELECT k FROM told)),
named AS (
  SELECT k, i, coalesce(sid, CASE WHEN regexp_matches(sentence, '^copyright (c )?[0-9]{{4}}.*$') THEN 'copyright' END, '?') AS sid
  FROM places LEFT JOIN wordings ON sentence = wording
),
sizes AS (SELECT k, count(*) AS n FROM places GROUP BY k),
chains AS (
  SELECT k, string_agg(sid, ',' ORDER BY i) FILTER (WHERE sid <> '?') AS sentence_ids,
         coalesce(string_agg(CASE WHEN sid = '?' THEN '#' ELSE '<' || sid || '>' END, '' ORDER BY i)
           FILTER (WHERE sid <> 'copyright'), '') AS chain
  FROM named GROUP BY k
),
{", ".join(steps)}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids,
       concat_ws(',', {found}) AS licenses,
       coalesce({" + ".join(f"hits_{i}" for i in range(len(RULES)))}, 0)::BIGINT AS n_matches,
       coalesce(array_to_string(list_filter(string_split(regexp_replace(chain, '[#<]+', '', 'g'), '>'),
         lambda i: i <> ''), ','), '') AS unmatched
FROM rows LEFT JOIN {last} USING (k) LEFT JOIN sizes USING (k)
"""


# ---- op11 -----------------------------------------------------------------------------------------------------------

# Five hexadecimal digits of a SHA-1 are four characters of its base32 form.
CAPTURES = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM digests
"""


# ---- op13 -----------------------------------------------------------------------------------------------------------

_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
RANKED = f"""
WITH doc_terms AS (SELECT doc_id, row_number() OVER () AS line, {_TERMS} FROM documents),
sizes AS (SELECT line, any_value(doc_id) AS doc_id, count(*) AS n FROM doc_terms GROUP BY line),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
item_terms AS (SELECT item_id, term, count(*) AS uses FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
tfs AS (SELECT line, term, count(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
dfs AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tfs, totals GROUP BY term),
gains AS (SELECT line, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS gain
    FROM tfs JOIN dfs USING (term) JOIN sizes USING (line), totals),
scored AS (SELECT item_id, line, CAST(sum(gain * uses) AS BIGINT) AS score
    FROM gains JOIN item_terms USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN sizes USING (line) WHERE score > 0) WHERE rank <= 20
"""
