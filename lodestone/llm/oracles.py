"""DuckDB SQL for the queries that SQL can express; the others are tested by brute force, libraries and round trips.

SQL has neither the learned models (op3, op7), the encoders (op6, op10, op11), XXH64 (op8) nor the tree's digests (op2).
"""

from __future__ import annotations

from lodestone.llm.queries import RULES

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _warc() -> str:
    part = lambda k: f"('0x' || substr(h, {k * 5 + 1}, 5))::BIGINT"  # noqa: E731  five hex digits are four base32 digits
    digits = " || ".join(f"substr('{_BASE32}', (({part(k)} >> {shift}) & 31)::INT + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages WHERE page_id IS NOT NULL),
m AS (SELECT page_id, html, h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {digits} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m"""


def _url_filters() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_SMALL}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rh, rp, v) AS (VALUES {rules}),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM u JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f ON f.page_id = u.page_id"""


def _lead(n: int) -> str:
    return "concat_ws(' ', w" + "".join(f", lead(w, {k}) OVER o" for k in range(1, n)) + ")"


def _decontamination(window: int = 10) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    exploded = lambda key, table: f"(SELECT {key}, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT {key}, {words} AS ws, len({words}) AS n FROM {table}))"  # noqa: E731
    keys = ", ".join(f"{_lead(k)} AS k{k}" for k in range(1, window + 1))
    items = f"SELECT DISTINCT item_id, least(n, {window}) AS len, CASE least(n, {window}) " + " ".join(f"WHEN {k} THEN k{k}" for k in range(1, window + 1)) + f" END AS key FROM ik WHERE pos + least(n, {window}) - 1 <= n"
    matches = " UNION ALL ".join(f"SELECT doc_id, pos, {k} AS len, item_id FROM dk JOIN iw ON iw.len = {k} AND iw.key = dk.k{k} WHERE pos + {k} - 1 <= n" for k in range(1, window + 1))
    return f"""
WITH ik AS (SELECT item_id, n, pos, {keys} FROM {exploded('item_id', 'benchmark')} WINDOW o AS (PARTITION BY item_id ORDER BY pos)),
iw AS ({items}),
dk AS (SELECT doc_id, n, pos, {keys} FROM {exploded('doc_id', 'documents')} WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
m AS ({matches}),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + len)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len({words}) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


def _substring(window: int = 13) -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return f"""
WITH e AS (SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {words} AS ws, len({words}) AS n FROM documents)),
k AS (SELECT doc_id, pos, n, {_lead(window)} AS key FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE pos + {window - 1} <= n GROUP BY key HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {window})) AS pos FROM k JOIN f ON f.key = k.key AND first < doc_id WHERE pos + {window - 1} <= n),
r AS (SELECT e.doc_id, count(g.pos) AS n_removed, string_agg(w, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL) AS kept FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id)
SELECT d.doc_id, len({words}) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id"""


def _crc32(text: str) -> str:
    """The checksum of an ASCII text, byte by byte over the polynomial's table."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    own = f"({table}::BIGINT[])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)), lambda c, b: xor(c >> 8, {own}[((xor(c, b) & 255) + 1)::INT])), 4294967295::BIGINT)"


_PLACE = "ORDER BY turn NULLS FIRST, role, md5({n}(role)::VARCHAR || ':' || role || text)"


def _repair() -> str:
    """Every cheapest way to each state, with its least audit, turn by turn; then the edits are carried out one by one."""
    inserts = ", ".join(f"({s}, {k}, {at})" for s, ats in enumerate(((0, 2, 3, 2), (1, 2, 3, 2), (2, 3, 2, 3), (3, 2, 3, 2))) for k, at in enumerate(ats))
    code = _crc32("k") + " % 20"
    return rf"""
WITH RECURSIVE ins(before, k, s) AS (VALUES {inserts}), reads(s, i, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), rerole(s, t) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
moves AS (SELECT before, s AS after, NULL AS i, 'D' AS e, repeat('I', k) || 'D' AS audit, 3 * k + 4 AS cost FROM ins UNION ALL SELECT before, t, i, 'K', repeat('I', k) || 'K', 3 * k FROM ins JOIN reads ON reads.s = ins.s
  UNION ALL SELECT before, t, NULL, 'R', repeat('I', k) || 'R', 3 * k + 3 FROM ins JOIN rerole ON rerole.s = ins.s),
k AS (SELECT conv_id, coalesce(conv_id::VARCHAR, '~') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
m AS MATERIALIZED (SELECT *, {code} AS code FROM k),
d AS (SELECT c, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE code WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM m WHERE code <> 0),
o AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c {_PLACE.format(n='length')}, copy) AS i FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN regexp_matches(text, '[^.!? 	-][ 	-]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM o),
w AS (SELECT c, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit FROM (SELECT DISTINCT c FROM f)
  UNION ALL SELECT w.c, f.i, after, w.cost + moves.cost + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 3 ELSE 0 END, w.audit || moves.audit
  FROM w JOIN f ON f.c = w.c AND f.i = w.i + 1 JOIN moves ON moves.before = w.s AND (e = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (e <> 'K' OR moves.i = left(role, 1))
  QUALIFY row_number() OVER (PARTITION BY w.c, after ORDER BY w.cost + moves.cost + CASE WHEN fault = 'truncated' AND e <> 'D' THEN 3 ELSE 0 END, w.audit || moves.audit) = 1),
n AS (SELECT c, max(i) AS n FROM f GROUP BY c),
a AS MATERIALIZED (SELECT w.c, w.cost + 3 * k AS cost, audit || repeat('I', k) AS audit FROM w JOIN n ON n.c = w.c AND n.n = w.i JOIN ins ON ins.before = w.s AND ins.s IN (0, 3) QUALIFY row_number() OVER (PARTITION BY w.c ORDER BY w.cost + 3 * k, audit || repeat('I', k)) = 1),
r AS (SELECT c, 0 AS p, 0::BIGINT AS i, 0 AS s, NULL::VARCHAR AS done FROM a
  UNION ALL SELECT c, p + 1, i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE WHEN e = 'D' THEN s WHEN left(role, 1) = 's' THEN 1 WHEN left(role, 1) = 'u' THEN 2 ELSE 3 END, CASE WHEN e = 'D' THEN done ELSE coalesce(done || chr(10), '') || role || ':' || text END
  FROM (SELECT r.c, r.p, r.i, r.s, r.done, substr(audit, r.p + 1, 1) AS e, CASE WHEN substr(audit, r.p + 1, 1) = 'K' THEN f.role WHEN r.s = 2 THEN 'assistant' ELSE 'user' END AS role, CASE WHEN substr(audit, r.p + 1, 1) = 'I' THEN '' ELSE f.text END AS text
    FROM r JOIN a ON a.c = r.c AND r.p < length(audit) LEFT JOIN f ON f.c = r.c AND f.i = r.i + 1)),
x AS (SELECT r.c, sha256(coalesce(done, '')) AS sha FROM r JOIN a ON a.c = r.c AND r.p = length(audit)),
g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM k) k LEFT JOIN g ON g.c = k.c LEFT JOIN a ON a.c = k.c LEFT JOIN x ON x.c = k.c"""


def _trie() -> str:
    return f"""
WITH c AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id {_PLACE.format(n='strlen')}) AS pos FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
n AS MATERIALIZED (SELECT *, {_crc32('k')} % 9 AS h FROM (SELECT conv_id, conv_id::VARCHAR AS k, max(pos) AS total FROM c GROUP BY conv_id)),
b AS (SELECT n.conv_id, n.h, least(n.h, coalesce(m.total, 0)) AS taken, least(n.h, coalesce(m.total, 0)) + greatest(n.total - n.h, 0) AS len FROM n LEFT JOIN n m ON m.conv_id = n.conv_id - n.conv_id % 5),
t AS (SELECT b.conv_id, pos AS d, role, text FROM b JOIN c ON c.conv_id = b.conv_id - b.conv_id % 5 AND pos <= taken UNION ALL SELECT b.conv_id, pos - h + taken, role, text FROM b JOIN c ON c.conv_id = b.conv_id AND pos > h),
p AS MATERIALIZED (SELECT conv_id, d, strlen(text) AS bytes, string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM b),
v AS MATERIALIZED (SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key, d),
w AS (SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1),
l AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN w ON w.key = v.key),
a AS (SELECT substr(key, 1, 32 * j) AS key, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM l) GROUP BY 1),
e AS (SELECT key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends FROM p JOIN b ON b.conv_id = p.conv_id AND b.len = p.d GROUP BY key)
SELECT l.conv_id, l.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM l LEFT JOIN v u ON u.key = substr(l.key, 1, length(l.key) - 32) AND l.depth > 0 JOIN a ON a.key = l.key LEFT JOIN e ON e.key = l.key"""


ORACLES = {
    "op1_warc": _warc(), "op4_url_filters": _url_filters(), "op5_benchmark_decontamination": _decontamination(), "op9_substring_dedup": _substring(),
    "op12_conversation_repair": _repair(), "op13_conversation_trie": _trie(),
}  # fmt: skip
