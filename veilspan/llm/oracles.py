"""DuckDB SQL for the contract queries that SQL can express."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHA_EMPTY = "sha256('')"

OP1 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, di.m, item_id FROM di JOIN win ON di.m = win.m AND array_to_string(w[i:i + di.m - 1], ' ') = k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _urn(name: str) -> str:
    h = f"md5({name})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_TEXT = "regexp_replace(regexp_replace(regexp_replace(payload, '(?is)<script\\b[^>]*>.*?(?:</script\\s*>|\\z)|<style\\b[^>]*>.*?(?:</style\\s*>|\\z)|<!--.*?(?:-->|\\z)', ' ', 'g'), '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|title|head|body|html)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, '{_a}', '{_b}')"
_TEXT = f"trim(regexp_replace(regexp_replace(regexp_replace({_TEXT}, '[ \\t\\r\\x0B\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^\\n+|\\n+$', '', 'g'), ' ')"
OP2 = f"""
WITH r AS (SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS uri, {_urn("concat_ws('|', 'response', CAST(page_id AS VARCHAR), coalesce(url, ''))")} AS rid FROM pages),
b AS (
  SELECT page_id, payload, uri, rid, 'metadata' AS t, 'application/warc-fields' AS c,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10)
    || 'title: ' || trim(regexp_replace(regexp_extract(payload, '(?is)<title\\b[^>]*>(.*?)</title', 1), '[\\r\\n\\t ]+', ' ', 'g'), ' ') || chr(13) || chr(10)
    || array_to_string(list_transform(regexp_extract_all(payload, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1), lambda x: 'outlink: ' || regexp_replace(x, '[\\r\\n]+', ' ', 'g') || chr(13) || chr(10)), '') AS body
  FROM r
  UNION ALL SELECT page_id, payload, uri, rid, 'conversion', 'text/plain', {_TEXT} FROM r)
SELECT page_id, t AS record_type, {_urn("concat_ws('|', t, rid)")} AS record_id, rid AS refers_to, uri AS target_uri, c AS content_type, CAST(strlen(body) AS BIGINT) AS content_length,
  'sha256:' || sha256(body) AS block_digest, 'sha256:' || sha256(payload) AS source_digest, body AS block, '1970-01-01T00:00:00Z' AS date, 'text/html; charset=utf-8' AS source_type,
  strlen(body) + 4 + 24 + strlen('WARC-Type: WARC-Record-ID: WARC-Refers-To: WARC-Refers-To-Target-URI: WARC-Refers-To-Date: WARC-Target-URI: WARC-Date: WARC-Source-Content-Type: WARC-Source-Payload-Digest: WARC-Block-Digest: Content-Type: Content-Length: ')
  + 12 + strlen(t) + 2 * 47 + 2 * strlen(uri) + 2 * 20 + 24 + 2 * 71 + strlen(c) + strlen(CAST(strlen(body) AS VARCHAR)) AS record_length
FROM b
"""

OP3 = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UP}', '{LOW}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""


def _rule(host: str, path: str, rules: list, value: str) -> str:
    cases = []
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow")):
        cases.append(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{h + p if value == 'rule' else v}'")
    return "CASE " + " ".join(cases) + " END"


def op4(rules: list) -> str:
    host = f"translate(coalesce(regexp_extract({{0}}, '://([^/?#]*)', 1), ''), '{UP}', '{LOW}')"
    path = "coalesce(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '')"
    tag = "SELECT url AS u, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM pages WHERE contains(url, '://')"
    href = "coalesce(" + ", ".join(f"nullif(regexp_extract(tag, '(?i)\\shref\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s\"''>]+))', {g}), '')" for g in (1, 2, 3)) + ")"
    content = "coalesce(" + ", ".join(f"nullif(regexp_extract(tag, '(?i)\\scontent\\s*=\\s*(?:\"[^\"]*?url\\s*=\\s*([^\"]*)\"|''[^'']*?url\\s*=\\s*([^'']*)'')', {g}), '')" for g in (1, 2)) + ")"
    origin, folder = "regexp_extract(u, '^([^:/?#]+://[^/?#]*)', 1)", "regexp_extract(u, '^([^:/?#]+://[^/?#]*[^?#]*/)', 1)"
    return f"""
WITH RECURSIVE tags AS ({tag}),
links AS (SELECT u, replace(trim(l, ' '), '&amp;', '&') AS l FROM (SELECT u, CASE WHEN regexp_matches(tag, '(?i)\\srel\\s*=\\s*["'']?(?:[^"''>]*\\s)?canonical[\\s"''/>]') THEN {href}
  WHEN regexp_matches(tag, '(?i)\\shttp-equiv\\s*=\\s*["'']?refresh[\\s"''/>]') THEN trim(regexp_replace({content}, '["'']', '', 'g'), ' ') END AS l FROM tags) WHERE l IS NOT NULL),
e AS (SELECT DISTINCT regexp_replace(u, '#.*$', '') AS a, regexp_replace(CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN starts_with(l, '//') THEN regexp_extract(u, '^([^:/?#]+:)', 1) || l
  WHEN starts_with(l, '/') THEN {origin} || l ELSE (CASE WHEN length({folder}) > length({origin}) THEN {folder} ELSE {origin} || '/' END) || l END, '#.*$', '') AS b FROM links),
both_ AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
bad AS (SELECT DISTINCT a FROM both_ WHERE {_rule(host.format("a"), path.format("a"), rules, "verdict")} = 'block'),
reach AS (SELECT a FROM bad UNION SELECT both_.b FROM reach JOIN both_ USING (a)),
p AS (SELECT page_id, {host.format("url")} AS host, {path.format("url")} AS path, regexp_replace(url, '#.*$', '') AS node FROM pages),
j AS (SELECT p.*, {_rule("host", "path", rules, "rule")} AS rule, {_rule("host", "path", rules, "verdict")} AS own, coalesce(node IN (SELECT a FROM reach), false) AS class_blocked FROM p)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN class_blocked THEN 'block' ELSE 'allow' END) AS verdict, class_blocked FROM j
"""


OP8 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
p AS (SELECT conv_id, k, n, md5(string_agg(md5(length(role) || '|' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY k)) AS h FROM t),
ends AS (SELECT h, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS copies FROM p WHERE k = n GROUP BY h),
kept AS (SELECT * FROM ends WHERE h NOT IN (SELECT h FROM p WHERE k < n))
SELECT conv_id, n_turns, copies, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k) AS rendered FROM kept JOIN t USING (conv_id) GROUP BY ALL
"""
