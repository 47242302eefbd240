"""DuckDB SQL for the queries that SQL can express."""

from crosspanel.llm.url_filters import ENTITIES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

DECONTAMINATION = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m,
    unnest(list_transform(range(0, len(w) - least(13, len(w)) + 1),
      lambda k: array_to_string(w[k + 1 : k + least(13, len(w))], ' '))) AS p
  FROM items WHERE len(w) > 0),
places AS (
  SELECT doc_id, m, unnest(range(0, len(w) - m + 1)) AS k, w
  FROM words, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m),
hits AS (
  SELECT doc_id, k, o.m, item_id
  FROM (SELECT doc_id, m, k, array_to_string(w[k + 1 : k + m], ' ') AS p FROM places) o
  JOIN patterns USING (p) WHERE patterns.m = o.m),
hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + m)) AS place FROM (SELECT DISTINCT doc_id, k, m FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _spans(kind: str, rank: int, expression: str, valid: str) -> str:
    """Starts are the lengths of all gaps and matches before a match."""
    return rf"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s, s + length(v) AS e, v FROM (
    SELECT doc_id, i, v[i] AS v, coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(v[1 : i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, v, g, unnest(range(1, len(v) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{expression}') AS v, string_split_regex(text, '{expression}') AS g
      FROM texts) WHERE len(v) > 0))
  WHERE {valid}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = rf"""length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1),
    lambda k: CASE WHEN (length({_DIGITS}) - k) % 2 = 0 THEN {_DIGITS}[k]::INT
      ELSE ({_DIGITS}[k]::INT * 2) % 10 + ({_DIGITS}[k]::INT * 2) // 10 END)) % 10 = 0"""
_COMPACT = "replace(v, ' ', '')"
_MOD97 = rf"""length({_COMPACT}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
    string_split({_COMPACT}[5 :] || {_COMPACT}[: 4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9'
      THEN c::INT ELSE ascii(c) - 55 END)), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1"""
_SSN = r"NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$') AND regexp_matches(lower(right(text[: s], 40) || ' ' || text[e + 1 : e + 40]), 'ssn|social|security')"

PERSONAL_DATA = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
  {_spans('email', 0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 'true')}
  UNION ALL {_spans('ip', 1, r'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+',
                    "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND right(p, 3)::INT <= 255))")}
  UNION ALL {_spans('card', 2, '[0-9](?:[ -]?[0-9])+', _LUHN)}
  UNION ALL {_spans('phone', 3, r'\+[0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 10 AND 15')}
  UNION ALL {_spans('iban', 4, r'\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b', _MOD97)}
  UNION ALL SELECT doc_id, rank, kind, s, e, v FROM (
    {_spans('ssn', 5, r'\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', 'true')}) JOIN texts USING (doc_id) WHERE {_SSN}),
told AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip,
    count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
  coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(1, len(w) - 3)),
    lambda k: array_to_string(w[k + 1 : k + 4], ' '))) AS g
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) c
  JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS node, a AS root FROM both_ways
  UNION
  SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.node),
parts AS (SELECT node, min(root) AS part FROM reach GROUP BY node)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(part, words.doc_id) AS component_id,
  coalesce(part, words.doc_id) = words.doc_id AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN parts ON node = words.doc_id
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (
  SELECT DISTINCT a AS node, a AS root FROM links
  UNION
  SELECT b, root FROM reach JOIN links ON a = node),
parts AS (SELECT node, min(root) AS part FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(part, vec_id) AS component_id,
  coalesce(part, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN parts ON node = vec_id LEFT JOIN counts ON counts.a = vec_id
"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    """The verdicts for the rules; edges from canonical and refresh links and from equal keys."""
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    rest = "substr({u}, position('://' IN {u}) + 3)"
    host = f"CASE WHEN contains({{u}}, '://') THEN translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END"
    path = f"CASE WHEN contains({{u}}, '://') THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    query = r"regexp_extract({u}, '^[^?#]*(\?[^#]*)', 1)"
    plain = rf"regexp_replace(regexp_replace({query}, '([?&])(?:utm_[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', '')"
    walked = (f"list_reduce(list_prepend('', string_split({path}, '/')[2:]), lambda d, x: CASE x WHEN '.' THEN d "
              f"WHEN '..' THEN regexp_replace(d, '/[^/]*$', '') ELSE d || '/' || x END)")
    walked = (f"CASE WHEN contains({path}, '/.') THEN {walked} || CASE WHEN regexp_matches({path}, '/\\.\\.?$') "
              f"THEN '/' ELSE '' END ELSE {path} END")
    key = f"CASE WHEN {host} <> '' THEN {host} || {walked} || {plain} END"
    tag = r"(?i)<{t}\b[^>]*\b{a}\s*=\s*[\"'']?{v}\b[^>]*>"

    def decoded(link: str) -> str:
        for entity, mark in ENTITIES:
            link = f"replace({link}, '{entity}', '{mark.replace(chr(39), chr(39) * 2)}')"
        return link
    link = lambda t, a, v, target: (
        f"list_transform(regexp_extract_all(html, '{tag.format(t=t, a=a, v=v)}'), lambda t: "
        + decoded(f"regexp_extract(t, '(?i)\\b{target}\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1)") + ")")
    return rf"""
WITH RECURSIVE own AS (
  SELECT row_number() OVER () AS row_id, page_id, url, coalesce({host.format(u='url')}, '') AS host,
    coalesce({path.format(u='url')}, '') AS path, {key.format(u='url')} AS key,
    list_concat({link('link', 'rel', 'canonical', 'href')}, {link('meta', 'http-equiv', 'refresh', 'url')}) AS links
  FROM pages),
full_links AS (
  SELECT key AS a, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l
    WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN l LIKE '//%' THEN ':' || l
    WHEN l LIKE '/%' THEN '://' || host || l WHEN l LIKE '#%' THEN url
    WHEN l LIKE '?%' THEN '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || l
    ELSE '://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || l END AS l
  FROM (SELECT key, url, host, path, unnest(links) AS l FROM own) WHERE l <> ''),
edges AS (
  SELECT a, b FROM (SELECT a, {key.format(u='l')} AS b FROM full_links) WHERE a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT DISTINCT a AS node, a AS root FROM both_ways
  UNION
  SELECT b, root FROM reach JOIN both_ways ON a = node),
parts AS (SELECT node, min(root) AS part FROM reach GROUP BY node),
rules(verdict, h, p) AS (VALUES {listed}),
ruled AS (
  SELECT row_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM own JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row_id),
placed AS (
  SELECT own.*, rule, verdict, coalesce(part, key) AS part
  FROM own LEFT JOIN ruled USING (row_id) LEFT JOIN parts ON node = key),
said AS (
  SELECT part, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
  FROM placed WHERE part IS NOT NULL GROUP BY part)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN blocked AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM placed LEFT JOIN said USING (part)
"""


#: A table ``crc`` of one row with the 256 remainders of the checksum, made from its polynomial.
_CRC_TABLE = """crc_steps AS (
  SELECT i, 0 AS k, i::UINTEGER AS c FROM range(256) b(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE k = 8)"""


def _crc(codes: str) -> str:
    """The checksum of a list of byte values, beside ``crc``."""
    return f"""xor(list_reduce(list_prepend(4294967295::UINTEGER, {codes}),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER)::BIGINT"""


def _crc_ascii(text: str) -> str:
    return _crc(f"list_transform(regexp_extract_all({text}, '.'), lambda x: ascii(x)::UINTEGER)")


_crc_bytes = _crc("list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::UINTEGER)")


def sharding(shards: int) -> str:
    """A document belongs where the middle of its bytes lies."""
    order = "k0, k1"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
sized AS (
  SELECT doc_id, strlen(body)::BIGINT + 8 AS size, {_crc_bytes} AS text_crc32,
    ('0x' || md5(body)[:15])::BIGINT AS k0, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:15])::BIGINT AS k1
  FROM texts, crc),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM sized),
placed AS (SELECT *, least({shards} - 1, ((2 * upto - size) * {shards}) // (2 * total))::INTEGER AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY {order}) - 1 AS slot,
  NULL::INTEGER AS grown_shard
FROM placed
"""


PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS d, digest, chars
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
      md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)),
heads AS (SELECT conv_id, {_crc_ascii('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
rebuilt AS (
  SELECT h.conv_id, o.d AS d, o.digest, o.chars, 0 AS part
  FROM heads h JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 100 AND o.d <= h.h
  UNION ALL SELECT o.conv_id, o.d, o.digest, o.chars, 1 FROM own o JOIN heads h USING (conv_id) WHERE o.d > h.h),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, d) AS depth FROM rebuilt),
paths AS (
  SELECT conv_id, depth, chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, any_value(p.depth) AS depth, any_value(chars) AS chars, min(p.conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = l.length), '') AS members
  FROM paths p JOIN lengths l USING (conv_id) GROUP BY path),
children AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
climbs AS (
  SELECT left(path, 32 * k) AS path, n_children = 0 AS leaf, (n_convs - 1) * chars AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes)),
below AS (SELECT path, count_if(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM climbs GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(n.members) AS ends_sha256
FROM full_nodes n JOIN below USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, length(n.path) - 32)
"""

_SPELLED = lambda c: f"coalesce({c}::VARCHAR, ' ')"
_EDITS = lambda cost, letter, after: f"lpad((left({after}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || {after}[10 :]"
_NEVER = "'~'"


def _edited(state: str) -> str:
    """The best way on from ``state`` that uses up the row at hand: cost in nine digits, then letters."""
    follows = {"v": "u", "y": "u", "u": "a", "a": "u"}[state]
    kept = f"CASE WHEN r.kind = '{follows}' THEN {_EDITS('r.cut', 'K', 'b.' + follows)}" + (
        f" WHEN r.kind = 's' THEN {_EDITS('r.cut', 'K', 'b.y')}" if state == "v" else "") + f" ELSE {_NEVER} END"
    return (f"least({_EDITS(3, 'D', 'b.' + state)}, CASE WHEN r.must THEN {_NEVER} ELSE least({kept}, "
            f"{_EDITS('2 + r.cut', 'R', 'b.' + follows)}) END)")


REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
coded AS (
  SELECT conv_id, turn, {_SPELLED('role')} AS role, {_SPELLED('text')} AS text,
    {_crc_ascii(_SPELLED('conv_id') + " || ':' || " + _SPELLED('turn'))} % 20 AS code
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM coded)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '[^\x20\x09-\x0D](?:[\x20\x09-\x0D]*)$')[1] AS last
  FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    role[1] AS kind, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS kind_before
  FROM placed),
rows_ AS (SELECT *, fault IN (1, 2) AS must, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS cut, count(*) OVER (PARTITION BY conv_id) AS n FROM faulty),
best AS (
  SELECT DISTINCT conv_id, n + 1 AS i, '000000000' AS v, '000000004II' AS y, '000000002I' AS u, '000000000' AS a FROM rows_
  UNION ALL
  SELECT conv_id, i, least(wv, {_EDITS(2, 'I', 'wu')}, {_EDITS(4, 'II', 'wa')}), least(wy, {_EDITS(2, 'I', 'wu')}, {_EDITS(4, 'II', 'wa')}),
    least(wu, {_EDITS(2, 'I', 'wa')}), least(wa, {_EDITS(2, 'I', 'wu')})
  FROM (SELECT r.conv_id, r.i, {_edited('v')} AS wv, {_edited('y')} AS wy, {_edited('u')} AS wu, {_edited('a')} AS wa
    FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
audits AS (SELECT conv_id, left(v, 9)::BIGINT AS cost, v[10 :] AS audit FROM best WHERE i = 1),
walk AS (
  SELECT conv_id, audit, 0 AS k, 0 AS i, 'v' AS state, '' AS letter FROM audits
  UNION ALL
  SELECT conv_id, audit, k + 1, i + CASE letter WHEN 'I' THEN 0 ELSE 1 END, CASE WHEN letter = 'D' THEN state
    WHEN state = 'v' AND letter = 'K' AND kind = 's' THEN 'y' WHEN state = 'u' THEN 'a' ELSE 'u' END, letter
  FROM (SELECT w.conv_id, w.audit, w.k, w.i, w.state, w.audit[w.k + 1] AS letter, r.kind
    FROM walk w LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 WHERE w.k < length(w.audit))),
turns AS (
  SELECT w.conv_id, k, CASE WHEN letter = 'K' THEN r.role WHEN state = 'u' THEN 'user' ELSE 'assistant' END || ':'
      || CASE WHEN letter = 'I' THEN '' ELSE r.text END AS turn
  FROM walk w LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE letter IN ('K', 'R', 'I')),
repaired AS (SELECT conv_id, string_agg(turn, chr(10) ORDER BY k) AS body FROM turns GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank,
    count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(i > 1 AND kind_before || kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
