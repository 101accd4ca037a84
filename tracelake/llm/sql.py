"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Documents with the lines gone that have three words or more and are on ten sources or more, except where seen first.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, source, generate_subscripts(parts, 1) AS at, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM {docs})
), content AS (
  SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS words FROM lines
), boilerplate AS (
  SELECT words, min(doc_id) AS first_id FROM content
  WHERE regexp_matches(words, '^(?:\S+\s+){{2}}\S')
  GROUP BY words HAVING count(DISTINCT coalesce(source, chr(1))) >= 10
)
SELECT c.doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE b.words IS NOT NULL AND c.doc_id <> b.first_id) AS n_removed,
  coalesce(string_agg(c.line, chr(10) ORDER BY c.at) FILTER (WHERE b.words IS NULL OR c.doc_id = b.first_id), '') AS text
FROM content c LEFT JOIN boilerplate b ON c.words = b.words
GROUP BY c.doc_id
"""

#: Words of documents inside any occurrence of a window of ten benchmark words (or all, of a shorter item).
_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
DECONTAMINATION = """
WITH d AS (SELECT doc_id, coalesce(WORDS, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, WORDS AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
occurs AS (SELECT doc_id, item, s, n FROM grams JOIN wins USING (n, phrase)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occurs) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occurs) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("WORDS", _WORDS)

#: One response for equal payloads of 1000 bytes or more, that of the largest page_id.
ARC_TO_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS target FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> target THEN target END AS refers_to
FROM r
"""

#: Captures and entries as the query makes them; an entry holds from its add to the next remove.
URL_LISTS = r"""
WITH c AS (
  SELECT page_id, url, CAST(DATE '2023-01-01' + CAST((page_id * 7919) % 730 AS INTEGER) AS TIMESTAMP) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segments
  FROM pages
), parts AS (
  SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS top
  FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) <> ''
), named AS (SELECT *, regexp_extract(host, '([^.]+)\.example', 1) AS name FROM parts),
marked AS (SELECT *, ascii(right(name, 1)) + length(host) AS mark FROM named),
started AS (SELECT *, (mark * 31) % 300 AS start FROM marked),
spans AS (
  SELECT DISTINCT 'hosts' AS list, host AS pattern, start + d AS lo, hi FROM started, (VALUES (0, 90), (240, NULL)) v(d, h), LATERAL (SELECT start + h AS hi) WHERE mark % 7 < 2
  UNION SELECT 'sections', host || '/' || top, start + 60, start + 400 FROM started WHERE top <> '' AND length(name) % 2 = 0
), asked AS (
  SELECT page_id, fetched_at, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda k: array_to_string(string_split(host, '.')[-k:], '.')),
    list_transform(range(1, len(segments) + 1), lambda k: host || '/' || array_to_string(segments[1:k], '/')))) AS pattern
  FROM c
), met AS (
  SELECT page_id, count(DISTINCT (list, pattern)) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM asked JOIN spans USING (pattern)
  WHERE fetched_at >= TIMESTAMP '2023-01-01' + to_days(CAST(lo AS INTEGER)) AND (hi IS NULL OR fetched_at < TIMESTAMP '2023-01-01' + to_days(CAST(hi AS INTEGER)))
  GROUP BY page_id
)
SELECT page_id, host, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists
FROM c LEFT JOIN met USING (page_id)
"""

#: Components over all pairs at cosine 0.95 or more; vectors without a direction link with nothing.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""

#: Every window of 20 words beside the earliest place of its words; a word goes if such a window that begins up to 19 words before it is a later one.
REPEATED_PASSAGES = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), words AS (
  SELECT doc_id, s, w[s] AS word, CASE WHEN s + 19 <= len(w) THEN array_to_string(w[s:s + 19], ' ') END AS phrase FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM d)
), judged AS (
  SELECT *, phrase IS NOT NULL AND row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) > 1 AS later FROM words
), covered AS (
  SELECT *, max(CAST(later AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM judged
), left_over AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY s) FILTER (WHERE NOT gone), '') AS kept FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""

#: Every kept term for every group, zero counts included, and every pair of groups over them.
DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
tokens AS (SELECT n, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_count FROM tokens GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(lang_count) AS BIGINT) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.lang_count FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS total FROM dense GROUP BY lang, source),
priced AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (t.total + 2 * l.v) AS p, 1 + (1000000000 * (lang_count + 2)) // (l.total + 2 * l.v) AS q
  FROM dense JOIN totals t USING (lang, source) JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM priced WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= 10
"""


def _conversations_sql() -> str:
    """Damage by crc32 bit by bit, faults by windows, a recursive step a row over four strings of ten digits of cost and the audit."""

    def add(x: str, cost: str, letter: str) -> str:
        return f"(printf('%010d', CAST(substr({x}, 1, 10) AS BIGINT) + {cost}) || substr({x}, 11) || '{letter}')"

    def placed(x: str, initial: str) -> str:
        return f"CASE WHEN r.initial = '{initial}' THEN {add(x, 'r.more', 'K')} ELSE {add(x, '(r.more + 2)', 'R')} END"

    never = "'5000000000'"
    inserted = f"""e, s, least(u, {add("e", "2", "I")}, {add("s", "2", "I")}, {add("a", "2", "I")}) AS u,
      least(a, {add("u", "2", "I")}, {add("e", "4", "II")}, {add("s", "4", "II")}) AS a"""
    return f"""
WITH RECURSIVE read AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM read WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
), fold AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '0000000000' AS e, {never} AS s, {never} AS u, {never} AS a FROM damaged
  UNION ALL
  SELECT conv_id, i, {add("e", "3", "D")}, least({add("s", "3", "D")}, CASE WHEN initial = 's' THEN {add("e", "more", "K").replace("r.more", "more")} ELSE {never} END),
    least({add("u", "3", "D")}, {placed("e", "u").replace("r.", "")}, {placed("s", "u").replace("r.", "")}, {placed("a", "u").replace("r.", "")}), least({add("a", "3", "D")}, {placed("u", "a").replace("r.", "")})
  FROM (
    SELECT f.conv_id, r.i, r.initial, CASE r.fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2000000000 END AS more, {inserted.replace("e, s,", "f.e AS e, f.s AS s,", 1)}
    FROM fold f JOIN faults r ON f.conv_id = r.conv_id AND r.i = f.i + 1
  )
), best AS (
  SELECT conv_id, CAST(substr(x, 1, 10) AS BIGINT) AS cost, substr(x, 11) AS audit
  FROM (SELECT conv_id, least(e, a) AS x FROM (SELECT f.conv_id, {inserted.replace("e, s,", "f.e AS e, f.s AS s,", 1)} FROM fold f JOIN counted c ON f.conv_id = c.conv_id AND f.i = c.n))
), letters AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS nth
  FROM (SELECT conv_id, k, substr(audit, k, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best))
  WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), led AS (
  SELECT l.conv_id, max(CASE WHEN l.nth = 1 AND l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) AS system FROM letters l LEFT JOIN faults f ON f.conv_id = l.conv_id AND f.i = l.i GROUP BY l.conv_id
), repaired AS (
  SELECT l.conv_id, string_agg(CASE WHEN l.letter = 'K' THEN f.role WHEN (l.nth - 1 - d.system) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l.letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS text
  FROM letters l JOIN led d ON d.conv_id = l.conv_id LEFT JOIN faults f ON f.conv_id = l.conv_id AND f.i = l.i WHERE l.letter <> 'D' GROUP BY l.conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""


ORACLE: dict[str, str] = {
    "op5_decontamination": DECONTAMINATION,
    "op8_arc_to_warc": ARC_TO_WARC,
    "op4_url_lists": URL_LISTS,
    "op3_embedding_near_dedup": EMBEDDINGS,
    "op1_line_dedup": LINE_DEDUP.format(docs="documents"),
    "op11_repeated_passages": REPEATED_PASSAGES,
    "op12_conversation_repair": _conversations_sql(),
    "op13_source_divergence": DIVERGENCE,
}
