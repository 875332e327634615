"""DuckDB SQL of the queries that SQL can express on whole tables in reasonable time."""

from __future__ import annotations

from salesmart.llm.quality import PRIOR, RATIOS, REACH, WALK
from salesmart.llm.secret_scan import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_DECONTAMINATE = rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
),
item_at AS (
  SELECT item_id, ws, least(10, len(ws)) AS size,
         unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
  FROM item WHERE len(ws) > 0
),
item_window AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS words FROM item_at
),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_at AS (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM doc JOIN sizes ON len(ws) >= size
),
hit AS (
  SELECT d.doc_id, d.i, d.size, w.item_id
  FROM (SELECT doc_id, i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS words FROM doc_at) d
  JOIN item_window w ON w.size = d.size AND w.words = d.words
),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS place FROM hit),
per_doc AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(per_doc.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(per_doc.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN per_doc ON per_doc.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id
"""


_MEASURES = r"""
WITH doc AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
),
line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
three AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS words
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM doc WHERE len(ws) > 2)
),
often AS (SELECT doc_id, words FROM three GROUP BY doc_id, words HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS place
    FROM (SELECT t.doc_id, t.i FROM three t JOIN often o ON o.doc_id = t.doc_id AND o.words = t.words)
  ) GROUP BY doc_id
),
measured AS (
  SELECT doc.doc_id, lang, source, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, len(text) - len(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
         len(text) - len(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters
  FROM doc LEFT JOIN line ON line.doc_id = doc.doc_id LEFT JOIN repeated ON repeated.doc_id = doc.doc_id
),
failing AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
"""


def _quality() -> str:
    """Quantiles of each group's ratios, from its documents and not from merged counts."""
    values = []
    for place, rule in enumerate(RATIOS):
        scaled = (
            f"{rule.over} * 1000 // {rule.under}"
            if rule.most <= 4000
            else f"({rule.over} * 10 // {rule.under}) * 100"
        )
        values.append(
            f"SELECT doc_id, lang, source, base_failed, {place} AS place, '{rule.name}' AS ratio, {rule.step} AS step, "
            f"{rule.sign} * {rule.over} * 1000 AS counted, {rule.under} AS base, {rule.spare} AS spare, "
            f"{rule.sign} * least({scaled}, {rule.most}) AS value FROM failing WHERE {rule.under} > 0"
        )

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        quantiles = ", ".join(f"min(CASE WHEN 100 * place_in >= {p} * n THEN value END) AS q{p}" for p in WALK)
        first, found = f"q{WALK[0]}", f"{name}_0"
        walk = []
        for k, p in enumerate(WALK):
            tail = "tail" if k else first
            following = f"CASE WHEN q{p} - tail <= step + {REACH} * (tail - {first}) THEN q{p} ELSE tail END" if k else tail
            source = f"{name}_{k}"
            walk.append(f"{name}_{k + 1} AS (SELECT * {'EXCLUDE (tail)' if k else ''}, {following} AS tail FROM {source})")
        return f"""
{found} AS (
  SELECT {by}ratio, any_value(step) AS step, any_value(n) AS n, {quantiles}
  FROM (SELECT *, row_number() OVER (PARTITION BY {by}ratio ORDER BY value) AS place_in,
               count(*) OVER (PARTITION BY {by}ratio) AS n FROM valued WHERE NOT base_failed)
  GROUP BY {by}ratio
),
{", ".join(walk)},
{name} AS (SELECT *, tail + {REACH} * (tail - {first}) + step AS own_limit FROM {name}_{len(WALK)})"""

    def drawn(own: str, larger: str) -> str:
        shift = 1_000_000
        return f"({own}.n * ({own}.own_limit + {shift}) + {PRIOR} * ({larger} + {shift})) // ({own}.n + {PRIOR}) - {shift}"

    return f"""{_MEASURES}
valued AS ({" UNION ALL ".join(values)}),
{level("everything", "")},
{level("of_lang", "lang")},
{level("of_source", "lang, source")},
spoken AS (
  SELECT l.lang, l.ratio, l.step, {drawn("l", "e.own_limit")} AS most FROM of_lang l JOIN everything e ON e.ratio = l.ratio
),
own AS (
  SELECT s.lang, s.source, s.ratio, least({drawn("s", "l.most")}, l.most + l.step + abs(l.most) // 2) AS most
  FROM of_source s JOIN spoken l ON l.ratio = s.ratio AND l.lang IS NOT DISTINCT FROM s.lang
),
outside AS (
  SELECT doc_id, string_agg(v.ratio, ',' ORDER BY place) AS failed FROM valued v
  LEFT JOIN own ON own.ratio = v.ratio AND own.lang IS NOT DISTINCT FROM v.lang AND own.source IS NOT DISTINCT FROM v.source
  LEFT JOIN spoken ON spoken.ratio = v.ratio AND spoken.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN everything ON everything.ratio = v.ratio
  WHERE counted > coalesce(own.most, spoken.most, everything.own_limit) * base + 1000 * spare GROUP BY doc_id
)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM failing f LEFT JOIN outside o ON o.doc_id = f.doc_id
"""


#: The same matches without lookahead and possessive repeats, which DuckDB lacks.
_PLAIN_PATTERNS = {
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----",
    "login": r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@",
}


def _secrets() -> str:
    """Spans from the lengths of what lies between the matches."""
    found = []
    for rank, rule in enumerate(RULES):
        pattern = _PLAIN_PATTERNS.get(rule.kind, rule.pattern).replace("'", "''")
        found.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, "
            f"string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, "
            f"regexp_extract_all(text, '{pattern}', {rule.group}) AS parts "
            f"FROM doc WHERE regexp_matches(text, '{pattern}')"
        )
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(found)}),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matched),
span AS (
  SELECT doc_id, rank, kind, len(array_to_string(list_slice(gaps, 1, i), ''))
           + len(array_to_string(list_slice(found, 1, i - 1), '')) AS start_at, len(found[i]) AS size
  FROM each WHERE len(parts[i]) >= least
),
listed AS (
  SELECT doc_id, sum(CASE WHEN rank = 0 THEN 1 ELSE 0 END) AS n_assign,
         sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS n_access, sum(CASE WHEN rank = 2 THEN 1 ELSE 0 END) AS n_hex,
         string_agg(CASE WHEN rank < 3 THEN name END, ',' ORDER BY start_at, rank) AS base,
         string_agg(name, ',' ORDER BY start_at, rank) AS spans
  FROM (SELECT *, kind || ':' || CAST(start_at AS VARCHAR) || ':' || CAST(start_at + size AS VARCHAR) AS name FROM span)
  GROUP BY doc_id
)
SELECT doc.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed ON listed.doc_id = doc.doc_id
"""


_NGRAM_JOIN = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS words
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM doc WHERE len(ws) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingle a JOIN shingle b ON a.words = b.words AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
),
either AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reached AS (
  SELECT a, b FROM either
  UNION
  SELECT r.a, l.b FROM reached r JOIN either l ON l.a = r.b
),
least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles,
       least(doc.doc_id, coalesce(least_of.b, doc.doc_id)) AS component_id
FROM doc LEFT JOIN size ON size.doc_id = doc.doc_id LEFT JOIN least_of ON least_of.a = doc.doc_id
"""


_URL_FILTER = rf"""
WITH RECURSIVE address AS (
  SELECT DISTINCT url FROM pages
  UNION SELECT target FROM (
    SELECT unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?\s*(https?://[^"''\s>]+)', 1)) AS target
    FROM pages)
),
parted AS (
  SELECT url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref)(=|$)'))) AS asked
  FROM address
),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?\.html?$|/$', '')
           || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS key FROM parted
),
rule(verdict, on_host, on_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
ruled AS (
  SELECT url, arg_max(on_host || on_path, length(on_host || on_path)) AS name, arg_max(verdict, length(on_host || on_path)) AS verdict
  FROM keyed JOIN rule ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, on_path) GROUP BY url
),
link AS (
  SELECT DISTINCT x.key AS a, y.key AS b FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?\s*(https?://[^"''\s>]+)', 1)) AS target
    FROM pages) l
  JOIN keyed x ON x.url = l.url JOIN keyed y ON y.url = l.target WHERE x.key IS NOT NULL AND y.key IS NOT NULL
),
either AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reached AS (SELECT a, b FROM either UNION SELECT r.a, l.b FROM reached r JOIN either l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
placed AS (SELECT k.*, least(k.key, coalesce(l.b, k.key)) AS component FROM keyed k LEFT JOIN least_of l ON l.a = k.key),
blocked AS (
  SELECT DISTINCT component FROM placed JOIN ruled ON ruled.url = placed.url WHERE verdict = 'block' AND component IS NOT NULL
)
SELECT page_id, host, path, ruled.name AS rule,
       coalesce(ruled.verdict, CASE WHEN placed.component IN (SELECT component FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict,
       placed.component
FROM pages JOIN placed ON placed.url IS NOT DISTINCT FROM pages.url LEFT JOIN ruled ON ruled.url = placed.url
"""


_LINE_DEDUP = rf"""
WITH line AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key
  FROM line
),
shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
judged AS (
  SELECT k.*, s.holder IS NOT NULL AND s.holder <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY place), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


_COLLOCATIONS = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece
),
size AS (SELECT unnest(range(1, 5)) AS k),
gram AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, size WHERE len(ws) >= k)
),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang),
candidate AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, x.k AS after,
         CAST(CAST(2000000 AS HUGEINT) * c.a // (x.f + y.f) AS BIGINT) AS score
  FROM candidate c
  JOIN counted x ON x.lang = c.lang AND x.k < c.size AND x.phrase = array_to_string(list_slice(c.ws, 1, x.k), ' ')
  JOIN counted y ON y.lang = c.lang AND y.k = c.size - x.k
    AND y.phrase = array_to_string(list_slice(c.ws, x.k + 1, c.size), ' ')
),
best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, after) = 1
),
part AS (
  SELECT DISTINCT lang, a AS longer, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase FROM (
    SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidate)
  )
),
covered AS (SELECT lang, phrase, max(longer) AS longer FROM part GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.phrase = b.phrase
  WHERE c.longer IS NULL OR 100 * c.longer < 80 * b.a
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000
"""


_CONVERSATION_TRIE = """
WITH turn_of AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS said,
         length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
),
whole AS (
  SELECT conv_id, list({'said': said, 'chars': chars} ORDER BY place) AS turns FROM turn_of GROUP BY conv_id
),
-- CRC-32 of the decimal number, bit by bit.
checked AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda c, bit:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
    4294967295)) % 6 AS h
  FROM whole
),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM checked c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 100
),
prefix AS (
  SELECT conv_id, d, len(turns) AS size, list_transform(list_slice(turns, 1, d), lambda t: t.said) AS said,
         CASE WHEN d = 0 THEN 0 ELSE turns[d].chars END AS chars
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
node AS (
  SELECT array_to_string(said, '/') AS key, array_to_string(list_slice(said, 1, d - 1), '/') AS up, any_value(said) AS said,
         d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM prefix GROUP BY ALL
),
children AS (SELECT up, count(*) AS n FROM node WHERE depth > 0 GROUP BY up),
valued AS (
  SELECT node.*, coalesce(children.n, 0) AS n_children FROM node
  LEFT JOIN children ON children.up = node.key
),
lineage AS (
  SELECT n_children, n_convs, chars, array_to_string(list_slice(said, 1, above), '/') AS key
  FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM valued)
),
total AS (
  SELECT key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM lineage GROUP BY key
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, CASE WHEN v.depth > 0 THEN p.conv_id END AS parent_conv_id, v.n_convs,
       CAST(v.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN total ON total.key = v.key
LEFT JOIN valued p ON p.key = v.up AND p.depth = v.depth - 1
"""


ORACLES: dict[str, str] = {
    "op2_ngram_join": _NGRAM_JOIN,
    "op3_url_filter": _URL_FILTER,  # with whole canonical links, the only ones that pages of this kind may have
    "op4_decontaminate": _DECONTAMINATE,
    "op5_quality": _quality(),
    "op7_secret_scan": _secrets(),
    "op11_line_dedup": _LINE_DEDUP,
    "op12_collocations": _COLLOCATIONS,
    "op13_conversation_trie": _CONVERSATION_TRIE,
}
