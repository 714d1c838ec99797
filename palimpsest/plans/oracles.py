"""DuckDB SQL for the registered queries, written from their meaning and not from their plans."""

from __future__ import annotations

from ..functions.labels import AUDITED_TYPES, CATEGORIES, CUSTOM_ALIASES, IDENTIFIER_TYPES, LABEL_CATEGORY
from ..operators import synth
from ..operators.spans import PATTERNS
from . import fixtures as fx
from .fixtures import quoted, values


def _case(column: str, d: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in d.items()) + f" ELSE {other} END"


CATEGORY = _case("label", LABEL_CATEGORY, "'other'")
IN_CATEGORIES = "(" + ", ".join(map(quoted, CATEGORIES)) + ")"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _chunks(source: str) -> str:
    return f"""chunks AS (
  SELECT doc_id, (pos // 900)::INTEGER AS chunk_idx, pos::INTEGER AS chunk_offset, substr(text, (pos + 1)::INTEGER, 1000) AS chunk
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 900)) AS pos FROM {source}))"""


def _found(source: str) -> str:
    """Rebased matches: each starts behind all pieces and all matches before it."""
    parts = []
    for label, p in PATTERNS.items():
        parts.append(f"""
  SELECT doc_id, chunk_idx, chunk_offset, {quoted(label)} AS label, hits[k] AS text,
         coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, chunk_idx, chunk_offset, regexp_extract_all(chunk, {quoted(p)}) AS hits, regexp_split_to_array(chunk, {quoted(p)}) AS pieces
        FROM chunks WHERE regexp_matches(chunk, {quoted(p)})), generate_series(1, len(hits)) g(k)""")
    return _chunks(source) + ", found AS (SELECT doc_id, chunk_idx, (chunk_offset + start)::INTEGER AS g_start, (chunk_offset + start + length(text))::INTEGER AS g_end, label, text FROM (" + " UNION ALL ".join(parts) + "))"


FIRST = "ents AS (SELECT doc_id, g_start, g_end, label, min(chunk_idx) AS chunk_idx, arg_min(text, chunk_idx) AS text FROM found GROUP BY ALL)"
ITEMS = f"items AS (SELECT *, {CATEGORY} AS type, text AS value FROM ents WHERE label <> 'email' OR regexp_matches(text, {quoted(EMAIL)}))"
SHOWN = f"CASE WHEN type IN {IN_CATEGORIES} THEN type ELSE 'other' END"
DOCS = "docs AS (SELECT doc_id, text FROM documents)"

LAYOUT = """
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS raw_line FROM documents),
raw_words AS (SELECT doc_id, raw_line, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) AS i, string_split(line, ' ') AS ws FROM raw_lines),
spaced AS (SELECT doc_id, raw_line, i, text, sum(length(text) + 1) OVER (PARTITION BY doc_id, raw_line ORDER BY i) - length(text) - 1 AS col FROM raw_words),
words AS (SELECT doc_id, (raw_line // 40 + 1)::INTEGER AS page_num, (raw_line % 40)::INTEGER AS line_no,
                 (row_number() OVER (PARTITION BY doc_id, raw_line ORDER BY i) - 1)::INTEGER AS word_idx, text, col,
                 col * 6.0::DOUBLE AS x0, (col + length(text)) * 6.0::DOUBLE AS x1, 792.0::DOUBLE - 12 * (raw_line % 40) - 10 AS y0, 792.0::DOUBLE - 12 * (raw_line % 40) AS y1
          FROM spaced WHERE trim(text) <> ''),
text_lines AS (SELECT doc_id, page_num, line_no, string_agg(text, ' ' ORDER BY word_idx) AS line FROM words GROUP BY ALL),
text_pages AS (SELECT doc_id, page_num, '[Page ' || page_num || ']' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS body FROM text_lines GROUP BY doc_id, page_num),
full_texts AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page_num) AS text FROM text_pages GROUP BY ALL),
page_starts AS (SELECT doc_id, page_num, sum(length(body) + 2) OVER (PARTITION BY doc_id ORDER BY page_num) - length(body) - 2 + length('[Page ' || page_num || ']') + 1 AS page_start FROM text_pages),
line_starts AS (SELECT doc_id, page_num, line_no, sum(length(line) + 1) OVER (PARTITION BY doc_id, page_num ORDER BY line_no) - length(line) - 1 AS line_start,
                       row_number() OVER (PARTITION BY doc_id ORDER BY page_num, line_no) - 1 AS line_idx FROM text_lines),
indexed AS (SELECT w.*, l.line_idx::INTEGER AS line_idx,
                   (p.page_start + l.line_start + sum(length(w.text) + 1) OVER (PARTITION BY w.doc_id, w.page_num, w.line_no ORDER BY w.word_idx) - length(w.text) - 1)::INTEGER AS char_start
            FROM words w JOIN page_starts p USING (doc_id, page_num) JOIN line_starts l USING (doc_id, page_num, line_no))"""

PLACED = "WITH " + LAYOUT + ", " + _found("full_texts") + ", " + FIRST + ", " + ITEMS + """,
cut AS (SELECT e.doc_id, e.g_start, e.g_end, e.label, e.type, e.value, w.page_num, w.line_idx, w.x0, w.x1, w.y0, w.y1, length(w.text) AS n,
               greatest(e.g_start, w.char_start) - w.char_start AS low, least(e.g_end, w.char_start + length(w.text)) - w.char_start AS high
        FROM items e JOIN indexed w ON e.doc_id = w.doc_id AND w.char_start < e.g_end AND w.char_start + length(w.text) > e.g_start),
placed AS (SELECT doc_id, g_start, g_end, label, type, value, page_num, line_idx,
                  min(CASE WHEN low = 0 AND high = n THEN x0 ELSE x0 + low / n * (x1 - x0) END) - 2 AS x0, min(y0) AS y0,
                  max(CASE WHEN low = 0 AND high = n THEN x1 ELSE x0 + high / n * (x1 - x0) END) + 2 AS x1, max(y1) AS y1
           FROM cut GROUP BY ALL)"""

PX = "floor(x0 * 300 / 72 * 1000 + 0.5)::BIGINT AS x, floor((792 - y1) * 300 / 72 * 1000 + 0.5)::BIGINT AS y, floor((x1 - x0) * 300 / 72 * 1000 + 0.5)::BIGINT AS w, floor((y1 - y0) * 300 / 72 * 1000 + 0.5)::BIGINT AS h"
RECTS = PLACED + f", rects AS (SELECT doc_id, page_num, value, {PX} FROM placed JOIN (SELECT DISTINCT type AS sel_type, value AS sel FROM placed WHERE type IN ('email', 'ip_address')) ON value = sel)"
FOUND = f"WITH {DOCS}, " + _found("docs") + f", {FIRST}, {ITEMS}"
UI = FOUND + ", ui AS (SELECT type, value, count(*) AS count, min(doc_id) AS seq FROM items GROUP BY ALL)"

# text masked one pattern after another
_MASKED = [PATTERNS[k] for k in ("email", "phone_number", "credit_card", "ip_address")]


def _mask(expression) -> str:
    sql = "text"
    for p in _MASKED:
        sql = expression(sql, quoted(p))
    return f"SELECT doc_id, md5(t) AS text_md5, length(t)::INTEGER AS n FROM (SELECT doc_id, {sql} AS t FROM documents)"


def _joined(hit: str):
    def one(sql: str, p: str) -> str:
        return f"(SELECT list_reduce(list_prepend('', list_transform(generate_series(1, len(ps)), lambda i: ps[i] || coalesce({hit}, ''))), lambda a, b: a || b) FROM (SELECT regexp_split_to_array(s, {p}) AS ps, regexp_extract_all(s, {p}) AS hs FROM (SELECT {sql} AS s)))"

    return one


TRUNC = "date_trunc('hour', ts)"
EVENTS = "e AS (SELECT event_id, ts, event_type, event_id % 4 AS n FROM events)"
HOURLY = f"hourly AS (SELECT {TRUNC} AS hour, event_type AS pii_type, sum(n)::BIGINT AS count FROM e WHERE n > 0 GROUP BY ALL)"
CLASSIFIED = (
    "WITH " + values("lines", ["line_no", "raw"], fx.SAMPLE_LINES) + f""",
parsed AS (SELECT line_no, raw, trim(raw) = '' AS blank, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM lines),
opened AS (SELECT line_no, raw, blank, j->>'ocr_text' AS t, (j->'pii')::JSON[] AS pii FROM parsed),
checked AS (SELECT *, coalesce(length(t) BETWEEN 300 AND 500 AND pii IS NOT NULL AND len(list_filter(pii, lambda p: (p->>'type') NOT IN ({', '.join(map(quoted, AUDITED_TYPES))}) OR length(p->>'value') = 0)) = 0, FALSE) AS fine,
                   regexp_replace(t, '^\\.\\.\\.\\s*', '') AS txt FROM opened),
counted AS (SELECT *, CASE WHEN fine THEN len(list_filter(pii, lambda p: len(list_filter(string_split(p->>'value', ' '), lambda w: NOT contains(txt, w))) > 0)) ELSE 0 END AS errs FROM checked),
classified AS (SELECT line_no, raw, CASE WHEN blank THEN 'blank' WHEN NOT fine THEN 'schema_error' WHEN length(txt) < 250 THEN 'short' WHEN errs > 0 THEN 'token_error' ELSE 'ok' END AS status, errs::INTEGER AS token_errors FROM counted)
"""
)
PARITY = "WITH " + values("l", ["label", "text", "start", "score"], fx.LEFT) + ", " + values("r", ["label", "text", "start", "score"], fx.RIGHT) + """,
a AS (SELECT label, text, arg_max(score, start)::DOUBLE AS a FROM l GROUP BY ALL), b AS (SELECT label, text, arg_max(score, start)::DOUBLE AS b FROM r GROUP BY ALL),
parity AS (SELECT label, text, CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' ELSE 'both' END AS side, abs(b - a) AS drift FROM a FULL JOIN b USING (label, text))"""
AUDIT = "WITH " + values("was", ["sample_id", "seq", "type", "value"], fx.AUDIT_OLD) + ", " + values("now", ["sample_id", "seq", "type", "value"], fx.AUDIT_NEW) + """,
ids AS (SELECT DISTINCT sample_id FROM was), added AS (SELECT sample_id, type, value FROM now EXCEPT SELECT sample_id, type, value FROM was), gone AS (SELECT sample_id, type, value FROM was EXCEPT SELECT sample_id, type, value FROM now)"""
SPAN_ROWS = "WITH " + values("span_rows", ["row_id", "text", "spans"], fx.SPAN_ROWS) + """,
lists AS (SELECT row_id, text, (replace(replace(spans, '''', '"'), 'None', 'null'))::JSON::JSON[] AS ss FROM span_rows WHERE json_valid(replace(replace(spans, '''', '"'), 'None', 'null'))),
hits AS (SELECT row_id, text, length(regexp_split_to_array(text, '(?i)\\b(P\\.?\\s*O\\.?\\s*Box|PO\\s*Box|Post Office Box)\\b')[1]) AS pos FROM span_rows WHERE regexp_matches(text, '(?i)\\b(P\\.?\\s*O\\.?\\s*Box|PO\\s*Box|Post Office Box)\\b'))"""
PURCHASES = "p AS (SELECT o_orderkey AS id, o_custkey AS account_id, o_orderdate AS created_at, o_orderkey % 3 * 100 + 100 AS quota_total FROM orders)"
CUSTOM = "WITH " + values("raw", ["seq", "value", "type", "line"], fx.CUSTOM) + f""",
parts AS (SELECT seq, 0 AS part_no, value, type FROM raw WHERE line IS NULL UNION ALL
          SELECT seq, i AS part_no, CASE WHEN contains(part, '=') THEN substr(part, instr(part, '=') + 1) ELSE part END, CASE WHEN contains(part, '=') THEN substr(part, 1, instr(part, '=') - 1) END
          FROM (SELECT seq, unnest(regexp_split_to_array(line, '[\\n,]')) AS part0, generate_subscripts(regexp_split_to_array(line, '[\\n,]'), 1) AS i, trim(part0) AS part FROM raw WHERE line IS NOT NULL)),
named AS (SELECT seq, part_no, trim(value) AS value, {_case("lower(trim(coalesce(type, '')))", CUSTOM_ALIASES, "lower(trim(coalesce(type, '')))")} AS t FROM parts),
entries AS (SELECT seq, part_no, value, CASE WHEN t IN {IN_CATEGORIES} THEN t ELSE 'other' END AS type FROM named WHERE value <> '')"""

_CUSTOM = CUSTOM.removeprefix("WITH ") + """,
given AS (SELECT value, coalesce(arg_min(type, seq * 1000 + part_no) FILTER (type <> 'other'), 'other') AS type, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS target FROM entries GROUP BY value),
lettered AS (SELECT doc_id, page_num, line_no, word_idx, x0, y0, x1, y1, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS n FROM words),
page_lines AS (SELECT doc_id, page_num, line_no, min(x0) AS lx0, max(x1) AS lx1, string_agg(n, '' ORDER BY word_idx) AS letters FROM lettered GROUP BY ALL),
runs AS (SELECT doc_id, page_num, members, any_value(letters) AS run_text, any_value(starts) AS starts FROM (
  SELECT doc_id, page_num, anchor, list(line_no ORDER BY line_no) AS members, string_agg(letters, '' ORDER BY line_no) AS letters, list(begins ORDER BY line_no) AS starts FROM (
    SELECT a.doc_id, a.page_num, a.line_no AS anchor, b.line_no, b.letters, sum(length(b.letters)) OVER (PARTITION BY a.doc_id, a.page_num, a.line_no ORDER BY b.line_no) - length(b.letters) AS begins
    FROM page_lines a JOIN page_lines b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND (a.line_no = b.line_no OR b.line_no > a.line_no AND least(a.lx1, b.lx1) > greatest(a.lx0, b.lx0)))
  GROUP BY doc_id, page_num, anchor) GROUP BY doc_id, page_num, members),
finds AS (SELECT doc_id, page_num, members, starts, value, type, target, coalesce(list_sum(list_transform(pieces[1:k], lambda x: length(x))), 0) + (k - 1) * length(target) AS lo
  FROM (SELECT *, string_split(run_text, target) AS pieces FROM runs JOIN given ON contains(run_text, target) AND target <> ''), generate_series(1, len(pieces) - 1) g(k)),
placed_words AS (SELECT *, sum(length(n)) OVER (PARTITION BY doc_id, page_num, line_no ORDER BY word_idx) - length(n) AS w_lo FROM lettered),
touched AS (SELECT f.doc_id, f.page_num, f.value, f.type, f.members, f.lo, f.line_no, w.x0, w.y0, w.x1, w.y1, length(w.n) AS n,
                   greatest(f.lo - f.line_lo, w.w_lo) - w.w_lo AS a, least(f.lo + length(f.target) - f.line_lo, w.w_lo + length(w.n)) - w.w_lo AS z
  FROM (SELECT *, unnest(members) AS line_no, unnest(starts) AS line_lo FROM finds) f JOIN placed_words w
    ON w.doc_id = f.doc_id AND w.page_num = f.page_num AND w.line_no = f.line_no AND w.w_lo < f.lo + length(f.target) - f.line_lo AND w.w_lo + length(w.n) > f.lo - f.line_lo),
lined AS (SELECT doc_id, page_num, value, type, min(CASE WHEN a = 0 AND z = n THEN x0 ELSE x0 + a / n * (x1 - x0) END) AS x0, min(y0) AS y0, max(CASE WHEN a = 0 AND z = n THEN x1 ELSE x0 + z / n * (x1 - x0) END) AS x1, max(y1) AS y1
  FROM touched GROUP BY doc_id, page_num, value, type, members, lo, line_no),
custom_boxes AS (SELECT doc_id, page_num, value, type, any_value(x0) - 2 AS x0, any_value(y0) - 2 AS y0, any_value(x1) + 2 AS x1, any_value(y1) + 2 AS y1
  FROM lined GROUP BY doc_id, page_num, value, type, floor(x0 * 10 + 0.5), floor(y0 * 10 + 0.5), floor(x1 * 10 + 0.5), floor(y1 * 10 + 0.5)),
custom_first AS (SELECT doc_id, value, type, min(page_num) AS page_num FROM custom_boxes GROUP BY ALL)"""
FOUND_CUSTOM = "WITH " + LAYOUT + ", " + _CUSTOM
BESIDE = PLACED + ", " + _CUSTOM + """,
beside AS (SELECT * FROM placed h WHERE NOT EXISTS (SELECT 1 FROM custom_boxes s WHERE s.doc_id = h.doc_id AND s.page_num = h.page_num
  AND least(h.x1, s.x1) > greatest(h.x0, s.x0) AND least(h.y1, s.y1) > greatest(h.y0, s.y0)
  AND (least(h.x1, s.x1) - greatest(h.x0, s.x0)) * (least(h.y1, s.y1) - greatest(h.y0, s.y0)) >= 0.5 * (h.x1 - h.x0) * (h.y1 - h.y0)))"""


_ORDERS = "WITH " + values("e", ["seq", "body"], fx.ORDER_EVENTS) + ", " + values("products", ["product_id", "tier", "pages", "price_cents"], fx.PRODUCTS) + """,
j AS (SELECT seq, body::JSON AS b FROM e),
o AS (SELECT seq, b->'data'->>'id' AS order_id, b->'data'->'metadata'->>'account_id' AS account_id, coalesce(b->'data'->>'productId', b->'data'->>'product_id') AS product_id,
             coalesce((b->'data'->>'totalAmount')::BIGINT, (b->'data'->>'total_amount')::BIGINT, 0) AS amount_cents FROM j WHERE b->>'type' = 'order.paid'),
paid AS (SELECT order_id, account_id, tier, pages::BIGINT AS pages, amount_cents FROM o JOIN products USING (product_id)
         WHERE order_id <> '' AND regexp_full_match(account_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', 'i') QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq) = 1)"""


def _replay(events: str) -> str:
    """The ledger's fold as a recursion over each account's events: settle, refill, drain, answer, mint."""
    return f"""WITH RECURSIVE {events},
ev AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts, seq) AS i, min(ts) OVER (PARTITION BY account) AS opened FROM events_),
st AS (
  SELECT account, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::BOOLEAN AS allow, 0::BIGINT AS from_daily, 0::BIGINT AS from_week1, 0::BIGINT AS from_prepaid,
         opened + INTERVAL 7 DAY AS week_end, date_trunc('day', opened)::TIMESTAMP + INTERVAL 1 DAY AS day_end, 0::BIGINT AS du, 0::BIGINT AS wu, 0::BIGINT AS pu, NULL::BIGINT AS pg,
         NULL::TIMESTAMP AS li, NULL::BIGINT AS lc, 0::BIGINT AS charged, 0::BIGINT AS reconciled
  FROM ev WHERE i = 1
  UNION ALL
  SELECT account, i, ts, seq, kind, CASE kind WHEN 'consume' THEN ok ELSE TRUE END, CASE WHEN kind = 'consume' AND ok THEN least(dl, pages) ELSE 0 END,
         CASE WHEN kind = 'consume' AND ok THEN least(wl, pages - least(dl, pages)) ELSE 0 END, CASE WHEN kind = 'consume' AND ok THEN pages - least(dl, pages) - least(wl, pages - least(dl, pages)) ELSE 0 END,
         week_end, day_end, du2 + CASE WHEN kind = 'consume' AND ok THEN least(dl, pages) ELSE 0 END, wu2 + CASE WHEN kind = 'consume' AND ok THEN least(wl, pages - least(dl, pages)) ELSE 0 END,
         pu2 + CASE WHEN kind = 'consume' AND ok AND pg IS NOT NULL THEN pages - least(dl, pages) - least(wl, pages - least(dl, pages)) ELSE 0 END, CASE WHEN kind = 'grant' THEN coalesce(pg, 0) + pages ELSE pg END,
         CASE WHEN mint THEN ts ELSE li2 END, CASE WHEN mint THEN greatest(0, least(dl + wl + pl, 10)) ELSE lc2 END, CASE WHEN told THEN 0 ELSE amt END, CASE WHEN told THEN amt ELSE 0 END
  FROM (SELECT *, dl + wl + pl >= pages AS ok, kind = 'balance' AND (li2 IS NULL OR ts > li2 + INTERVAL 24 HOUR OR ts - li2 >= INTERVAL 12 HOUR) AS mint
   FROM (SELECT *, greatest(1 - du2, 0) AS dl, CASE WHEN ts <= week_end THEN greatest(20 - wu2, 0) ELSE 0 END AS wl, greatest(coalesce(pg, 0) - pu2, 0) AS pl,
                CASE WHEN NOT told AND amt > 0 THEN NULL ELSE li END AS li2, CASE WHEN NOT told AND amt > 0 THEN NULL ELSE lc END AS lc2
    FROM (SELECT *, du1 + least(greatest(1 - du1, 0), amt) AS du2, wu + least(wk, amt - least(greatest(1 - du1, 0), amt)) AS wu2,
                 pu + CASE WHEN pg IS NULL THEN 0 ELSE amt - least(greatest(1 - du1, 0), amt) - least(wk, amt - least(greatest(1 - du1, 0), amt)) END AS pu2
     FROM (SELECT e.account, e.i, e.ts, e.seq, e.kind, e.pages, s.week_end, s.wu, s.pu, s.pg, s.li, s.lc, e.issued IS NOT NULL AND e.used IS NOT NULL AS told,
                  CASE WHEN e.kind <> 'grant' AND e.ts > s.day_end THEN 0 ELSE s.du END AS du1,
                  CASE WHEN e.kind <> 'grant' AND e.ts > s.day_end THEN date_trunc('day', e.ts)::TIMESTAMP + INTERVAL 1 DAY ELSE s.day_end END AS day_end,
                  CASE WHEN e.ts <= s.week_end THEN greatest(20 - s.wu, 0) ELSE 0 END AS wk,
                  CASE WHEN e.kind = 'grant' OR s.li IS NULL THEN 0 WHEN e.issued IS NOT NULL AND e.used IS NOT NULL THEN CASE WHEN s.li <> e.issued OR e.ts > s.li + INTERVAL 24 HOUR THEN 0 ELSE least(e.used, s.lc) END ELSE greatest(s.lc, 0) END AS amt
           FROM st s JOIN ev e ON e.account = s.account AND e.i = s.i + 1)))))
SELECT account, ts, seq, kind, allow, CASE WHEN NOT allow THEN 'insufficient_balance' END AS reason, from_daily, from_week1, from_prepaid, greatest(1 - du, 0)::BIGINT AS daily_left,
       (CASE WHEN ts <= week_end THEN greatest(20 - wu, 0) ELSE 0 END)::BIGINT AS week1_left, greatest(coalesce(pg, 0) - pu, 0)::BIGINT AS prepaid_left, li AS lease_issued_at, lc AS lease_ceiling, charged, reconciled
FROM st WHERE i > 0"""


ASKED = """SELECT o_custkey::VARCHAR AS account, o_orderdate::TIMESTAMP AS ts, o_orderkey * 2 + 1 AS seq, 'consume' AS kind, o_orderkey % 25 + 1 AS pages FROM orders
UNION ALL SELECT o_custkey::VARCHAR, o_orderdate::TIMESTAMP, o_orderkey * 2, 'grant', 100 FROM orders WHERE o_orderpriority LIKE '1%'"""
LEDGER = f"events_ AS (SELECT *, NULL::TIMESTAMP AS issued, NULL::BIGINT AS used FROM ({ASKED}))"
LEASES = f"""asked_ AS (SELECT account, ts, seq, pages, CASE WHEN kind = 'grant' THEN 'grant' WHEN seq % 3 = 0 THEN 'balance' ELSE 'consume' END AS kind FROM ({ASKED})),
known_ AS (SELECT *, last_value(CASE WHEN kind = 'balance' THEN ts END IGNORE NULLS) OVER (PARTITION BY account ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ FROM asked_),
events_ AS (SELECT account, ts, seq, kind, pages, CASE WHEN seq % 5 < 4 AND kind <> 'grant' THEN last_ END AS issued, CASE WHEN seq % 5 < 4 AND kind <> 'grant' AND last_ IS NOT NULL THEN seq % 12 END AS used FROM known_)"""



def _synthetic(n: int, seed: int = 1337) -> str:
    """The synthetic notes: the same draws, values and sentences."""

    def u(*what: str) -> str:
        return f"(('0x' || substr(md5('{seed}|' || \"row\" || {' || '.join(f"'|' || {w}" for w in what)}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"

    def number(kind: str, part: str, low: int, high: int) -> str:
        return f"(floor({u(quoted(kind), quoted(part))} * {high - low}) + {low})::BIGINT"

    def pick(options: list[str], draw: str) -> str:
        return f"([{', '.join(map(quoted, options))}])[(floor({draw} * {len(options)}) + 1)::INTEGER]"

    first, last = pick(synth.FIRST, u("'first'")), pick(synth.LAST, u("'last'"))
    made = {
        "full_name": f"{first} || ' ' || {last}",
        "email_address": f"lower({first}) || '.' || lower({last}) || {number('email_address', 'n', 1, 99)} || '@example.com'",
        "phone_number": f"printf('(%d) 555-%04d', {number('phone_number', 'a', 201, 989)}, {number('phone_number', 'n', 100, 200)})",
        "social_security_number": f"printf('%d-%02d-%04d', {number('social_security_number', 'a', 900, 1000)}, {number('social_security_number', 'b', 1, 70)}, {number('social_security_number', 'c', 0, 10000)})",
        "credit_card_number": f"printf('411111111111%04d', {number('credit_card_number', 'n', 0, 10000)})",
        "address": f"{number('address', 'n', 1, 200)} || ' ' || {pick(synth.STREETS, u("'address'", "'s'"))} || ' Street ' || {pick(synth.TOWNS, u("'address'", "'t'"))} || ' ' || printf('%05d', {number('address', 'z', 1, 99999)})",
        "date": f"printf('%02d/%02d/%d', {number('date', 'm', 1, 13)}, {number('date', 'd', 1, 29)}, {number('date', 'y', 1940, 2006)})",
        "account_id": f"printf('%010d', {number('account_id', 'n', 0, 10**10)})",
        "government_id": f"printf('X%08d', {number('government_id', 'n', 0, 10**8)})",
        "other_pii": f"printf('192.0.2.%d', {number('other_pii', 'n', 1, 255)})",
    }
    running, kinds = 0, []
    for name, (w, _) in synth.KINDS.items():
        running += w
        kinds.append(f"WHEN {u("'kind'")} * {sum(w for w, _ in synth.KINDS.values())} < {running} THEN {quoted(name)}")
    fields = " ".join(f"WHEN {quoted(k)} THEN [{', '.join(map(quoted, f))}]::VARCHAR[]" for k, (_, f) in synth.KINDS.items())
    return f"""WITH drawn AS (SELECT i AS "row", CASE {" ".join(kinds)} END AS kind FROM range({n}) t(i)),
valued AS (SELECT "row", kind, CASE kind {fields} END AS fields, MAP {{{", ".join(f"{quoted(f)}: {v}" for f, v in made.items())}}} AS vals,
           MAP {{{", ".join(f"{quoted(f)}: {pick(s, u(quoted(f), "'said'"))}" for f, s in synth.SENTENCES.items())}}} AS said FROM drawn),
notes AS (SELECT "row", kind, {pick(synth.PLAIN, u("'opening'"))} || array_to_string(list_transform(fields, lambda f, i:
          CASE WHEN {u("'break'", "(i - 1)")} < {synth.BREAK_SHARE} THEN chr(10) ELSE ' ' END || replace(said[f], '#', vals[f])
          || CASE WHEN {u("'plain'", "(i - 1)")} < {synth.PLAIN_SHARE} THEN ' ' || {pick(synth.PLAIN, u("'which'", "(i - 1)"))} ELSE '' END), '') AS ocr_text,
          '[' || array_to_string(list_transform(fields, lambda f: '{{"type":"' || f || '","value":"' || vals[f] || '"}}'), ',') || ']' AS pii FROM valued)
"""


_DEVICES = """WITH b AS (SELECT c_custkey, md5(c_custkey::VARCHAR) AS machine_id FROM customer),
x AS (SELECT c_custkey, machine_id, list_transform(generate_series(0, 31), lambda i: lpad(hex(xor(ascii(substr(machine_id, (i + 1)::INTEGER, 1)), [90, 60, 167, 225, 24, 159, 66, 182][(i % 8 + 1)::INTEGER])), 2, '0')) AS h FROM b)
SELECT c_custkey, machine_id, sha256(unhex(right(array_to_string(list_transform(h, lambda v: right('0' || v, 2)), ''), 32) || left(array_to_string(list_transform(h, lambda v: right('0' || v, 2)), ''), 32))) AS device_id FROM x"""

SQL = {
    "sample_corpus": _synthetic(5000) + ' SELECT "row", kind, ocr_text, pii FROM notes',
    "sample_kinds": _synthetic(5000) + " SELECT kind, count(*) AS n FROM notes GROUP BY kind",
    "sample_batches": _synthetic(5000) + ' SELECT "row", ("row" // 10)::INTEGER AS batch, kind FROM notes WHERE "row" < 50',
    "ledger_replay": _replay(LEDGER),
    "lease_replay": _replay(LEASES),
    "deny_list": "SELECT doc_id, length(regexp_replace(text, '\\b(the|Of|and)\\b', '<X>', 'g'))::INTEGER AS n FROM documents",
    "cluster_lines": "WITH " + LAYOUT + """, gaps AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id, page_num, line_no ORDER BY word_idx) > 20, TRUE) AS cut FROM words),
lines AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY doc_id, page_num ORDER BY line_no, word_idx) - 1 AS line_idx FROM gaps)
SELECT doc_id, page_num, (line_no * 100000 + word_idx)::BIGINT AS word_seq, line_idx::INTEGER AS line_idx, (row_number() OVER (PARTITION BY doc_id, page_num, line_idx ORDER BY word_idx) - 1)::INTEGER AS word_idx FROM lines""",
    "detection_json": FOUND + f""", each AS (SELECT 'doc-' || doc_id AS file, type, value, count(*) AS n FROM items GROUP BY ALL)
SELECT file, '{{"file":"' || file || '","model":"rules","total_pii_detected":' || count(*) || ',"pii":[' || string_agg('{{"value":"' || value || '","type":"' || type || '","occurrences":' || n || '}}', ',' ORDER BY list_position([{', '.join(map(quoted, CATEGORIES))}], type), value) || ']}}' AS json FROM each GROUP BY file""",
    "request_lines": "WITH " + values("r", ["line_no", "raw"], fx.REQUEST_LINES) + """, j AS (SELECT line_no, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r WHERE trim(raw) <> '')
SELECT line_no::BIGINT AS line_no, j->>'cmd' AS cmd, j->>'path' AS path, CASE WHEN j IS NULL THEN 'invalid JSON' WHEN coalesce(j->>'cmd', '') NOT IN ('detect', 'scrub', 'close') THEN 'unknown cmd' END AS error FROM j""",
    "clean_custom": "WITH " + values("raw", ["seq", "value", "type", "line"], fx.CUSTOM) + f""", t AS (SELECT trim(value) AS value, {_case("lower(trim(coalesce(type, '')))", CUSTOM_ALIASES, "lower(trim(coalesce(type, '')))")} AS t FROM raw)
SELECT value, CASE WHEN t IN {IN_CATEGORIES} THEN t ELSE 'other' END AS type FROM t WHERE value <> ''""",
    "identifier_lists": "SELECT * FROM (VALUES (1::BIGINT, 0, 'name', 'Ann'), (1, 1, 'other', 'Bob'), (1, 3, 'other', 'Z')) v(row_id, seq, type, value)",
    "grant_idempotent": _ORDERS + " SELECT order_id, account_id, tier, pages, amount_cents FROM paid",
    "grant_balances": _ORDERS + ", " + values("held", ["account_id", "granted"], fx.BALANCES) + ", " + values("done", ["order_id"], fx.DONE_ORDERS) + " SELECT account_id, sum(granted)::BIGINT AS granted FROM (SELECT * FROM held UNION ALL SELECT account_id, pages FROM paid WHERE order_id NOT IN (SELECT order_id FROM done)) GROUP BY ALL",
    "offline_consume": "WITH RECURSIVE " + values("r", ["client", "seq", "now_", "pages", "expires_at", "ceiling", "used"], fx.OFFLINE) + """,
st AS (SELECT DISTINCT client, 0 AS seq, NULL::VARCHAR AS reason, 0 AS used_before, used FROM r
 UNION ALL SELECT client, seq, reason, used AS used_before, used + CASE WHEN reason IS NULL THEN pages ELSE 0 END FROM
 (SELECT r.client, r.seq, r.pages, st.used, CASE WHEN r.ceiling IS NULL THEN 'offline_state_missing' WHEN r.expires_at IS NULL OR r.now_ >= r.expires_at THEN 'offline_lease_expired' WHEN r.pages > r.ceiling - st.used THEN 'offline_ceiling_reached' END AS reason
  FROM st JOIN r ON r.client = st.client AND r.seq = st.seq + 1))
SELECT client, seq::BIGINT AS seq, reason IS NULL AS allow, reason, used_before::BIGINT AS used_before FROM st WHERE seq > 0""",
    "chunk_documents": f"WITH {DOCS}, " + _chunks("docs") + " SELECT doc_id, chunk_idx, chunk_offset, length(chunk)::INTEGER AS n, md5(chunk) AS chunk_md5 FROM chunks",
    "normalize_text": "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS norm_md5 FROM documents",
    "detect_regex_entities": f"WITH {DOCS}, " + _found("docs") + " SELECT * FROM found",
    "dedupe_entities": f"WITH {DOCS}, " + _found("docs") + f", {FIRST} SELECT * FROM ents",
    "aggregate_pii": FOUND + f" SELECT {SHOWN} AS type, value, count(*) AS occurrences FROM items GROUP BY ALL",
    "conversation_pii": "WITH turns AS (SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations), " + _found("turns") + f", {FIRST}, {ITEMS} SELECT {SHOWN} AS type, value, count(*) AS occurrences FROM items GROUP BY ALL",
    "index_words": "WITH " + LAYOUT + " SELECT doc_id, page_num, line_idx, word_idx, char_start, (char_start + length(text))::INTEGER AS char_end, text, x0, x1, y0 FROM indexed",
    "index_word_rows": "WITH " + LAYOUT + " SELECT doc_id, page_num, line_idx, word_idx, char_start, (char_start + length(text))::INTEGER AS char_end FROM indexed",
    "indexed_text": "WITH " + LAYOUT + " SELECT doc_id, length(text)::INTEGER AS n, md5(text) AS text_md5 FROM full_texts",
    "layout_text": "WITH " + LAYOUT + " SELECT doc_id, length(text)::INTEGER AS n, md5(text) AS text_md5 FROM full_texts",
    "resolve_entity_boxes": PLACED + " SELECT doc_id, g_start, label, value, page_num, line_idx, x0, y0, x1, y1 FROM placed",
    "pixel_boxes": PLACED + f" SELECT doc_id, g_start, value, line_idx, {PX} FROM placed",
    "custom_pii_parse": CUSTOM + " SELECT value, coalesce(arg_min(type, seq * 1000 + part_no) FILTER (type <> 'other'), 'other') AS type FROM entries GROUP BY value",
    "custom_pii_match": FOUND_CUSTOM + " SELECT * FROM custom_boxes",
    "custom_emitted": FOUND_CUSTOM + " SELECT * FROM custom_first",
    "suppress_hits": BESIDE + " SELECT doc_id, g_start, value, page_num, line_idx FROM beside",
    "all_items": BESIDE + """, each AS (SELECT doc_id, 0 AS s, page_num AS a, value AS b, 'custom' AS source, type, value FROM custom_first UNION ALL SELECT DISTINCT doc_id, 1, g_start, label, 'model', type, value FROM beside)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, a, b)::INTEGER AS place, source, type, value FROM each""",
    "dedupe_boxes": PLACED + " SELECT doc_id, value, page_num, min(g_start * 2)::INTEGER AS seq, arg_min(label, g_start) AS label FROM placed GROUP BY doc_id, value, page_num, floor(x0 * 10 + 0.5), floor(y0 * 10 + 0.5), floor(x1 * 10 + 0.5), floor(y1 * 10 + 0.5)",
    "attach_boxes": PLACED + f""" SELECT doc_id, type, value, occurrences, n_boxes::INTEGER AS n_boxes, b[1] AS page_num, floor(b[2] * 1000 + 0.5)::BIGINT AS x0, floor(b[3] * 1000 + 0.5)::BIGINT AS y0
FROM (SELECT doc_id, {SHOWN} AS type, value, count(*) AS occurrences FROM placed GROUP BY ALL)
JOIN (SELECT doc_id, value, count(*) AS n_boxes, list_min(list(ROW(page_num, x0, y0, x1, y1))) AS b FROM placed GROUP BY ALL) USING (doc_id, value)""",
    "page_pixel_boxes": PLACED + f" SELECT doc_id, g_start, value, page_num, line_idx, {PX.replace('792', 'CASE WHEN page_num % 2 = 0 THEN 1008 ELSE 792 END')} FROM placed",
    "redaction_rects": RECTS + " SELECT * FROM rects",
    "unredacted_docs": RECTS + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM rects)",
    "redaction_totals": RECTS + " SELECT count(*) AS rects, count(DISTINCT (doc_id, page_num)) AS pages FROM rects",
    "pages_to_draw": RECTS + " SELECT doc_id, page_num, count(value) AS n_rects FROM text_pages LEFT JOIN rects USING (doc_id, page_num) GROUP BY ALL",
    "mask_text": _mask(lambda s, p: f"regexp_replace({s}, {p}, '<ANONYMIZED>', 'g')"),
    "redact_text": _mask(lambda s, p: f"regexp_replace({s}, {p}, '', 'g')"),
    "star_text": _mask(_joined("left(hs[i], greatest(length(hs[i]) - 12, 0)::INTEGER) || repeat('*', least(length(hs[i]), 12)::INTEGER)")),
    "hash_text": _mask(_joined("sha256(hs[i])")),
    "ui_groups": FOUND + """, ui AS (SELECT doc_id, type, value, count(*) AS count, min(g_start) AS seq FROM items GROUP BY ALL)
SELECT doc_id, type, row_number() OVER (PARTITION BY doc_id, type ORDER BY count DESC, seq, value)::INTEGER AS place, value, count,
       count(*) OVER (PARTITION BY doc_id, type) AS n_items, (sum(count) OVER (PARTITION BY doc_id, type))::BIGINT AS total FROM ui""",
    "selected_by_type": UI + " SELECT type, count(*) AS n FROM ui WHERE length(value) % 2 = 0 GROUP BY type",
    "page_span": PLACED + " SELECT type, value, count(DISTINCT (doc_id, page_num)) AS n_pages, count(*) AS n_boxes FROM placed GROUP BY ALL",
    "keep_checked": UI + " SELECT type, value, count, CASE WHEN seq % 2 = 0 THEN seq % 4 = 0 ELSE TRUE END AS checked FROM ui",
    "selected_values": UI + " SELECT DISTINCT value FROM ui",
    "union_identifiers": "WITH " + values("a", ["type", "raw"], fx.IDENTIFIER_INPUTS[:6]) + ", " + values("b", ["type", "raw"], fx.IDENTIFIER_INPUTS[4:]) + " SELECT * FROM a UNION ALL SELECT * FROM b",
    "chunk_dump": f"WITH {DOCS}, " + _chunks("docs") + ", d AS (SELECT doc_id, string_agg(repeat('=', 80) || chr(10) || 'chunk ' || (chunk_idx + 1) || ' (offset ' || chunk_offset || ')' || chr(10) || repeat('=', 80) || chr(10) || chunk, chr(10) ORDER BY chunk_idx) AS dump FROM chunks GROUP BY doc_id) SELECT doc_id, length(dump)::INTEGER AS n, md5(dump) AS dump_md5 FROM d",
    "ocr_words": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS i FROM l WHERE line_no % 5 <> 0)
SELECT doc_id, (line_no * 100000 + i)::INTEGER AS word_seq, text, floor((i * 50.0 - 6) * 72 / 300 * 1000 + 0.5)::BIGINT AS x0, floor((3300 - line_no * 40.0 - 30) * 72 / 300 * 1000 + 0.5)::BIGINT AS y0,
       floor((i * 50.0 + 51) * 72 / 300 * 1000 + 0.5)::BIGINT AS x1, floor((3300 - line_no * 40.0) * 72 / 300 * 1000 + 0.5)::BIGINT AS y1 FROM w WHERE trim(text) <> ''""",
    "format_identifier": "WITH " + values("a", ["type", "raw"], fx.IDENTIFIER_INPUTS) + r""",
d AS (SELECT type, raw, left(regexp_replace(raw, '[^0-9]', '', 'g'), CASE type WHEN 'ssn' THEN 9 ELSE 8 END) AS d FROM a),
f AS (SELECT type, raw, CASE WHEN type = 'ssn' THEN CASE WHEN length(d) <= 3 THEN d WHEN length(d) <= 5 THEN d[1:3] || '-' || d[4:] ELSE d[1:3] || '-' || d[4:5] || '-' || d[6:] END
                             WHEN type = 'dob' THEN CASE WHEN length(d) <= 2 THEN d WHEN length(d) <= 4 THEN d[1:2] || '/' || d[3:] ELSE d[1:2] || '/' || d[3:4] || '/' || d[5:] END ELSE raw END AS formatted FROM d)
SELECT type, raw, formatted, trim(formatted) <> '' AND CASE type WHEN 'ssn' THEN regexp_full_match(trim(formatted), '\d{3}-\d{2}-\d{4}') WHEN 'dob' THEN regexp_full_match(trim(formatted), '\d{2}/\d{2}/\d{4}')
       WHEN 'email' THEN regexp_full_match(trim(formatted), '[^\s@]+@[^\s@]+\.[^\s@]+') ELSE TRUE END AS ok FROM f""",
    "ui_formats": "WITH " + values("a", ["a", "b"], fx.PROGRESS) + ", " + values("p", ["c"], fx.PRICES) + ", " + values("t", ["t"], fx.TIERS) + ", " + values("k", ["t"], fx.TYPES) + ", " + values("c", ["t"], fx.COLORS) + """
SELECT 'percent' AS what, a || '/' || b AS raw, (CASE WHEN b > 0 THEN floor(a / b * 100 + 0.5)::INTEGER ELSE 0 END)::VARCHAR AS shown FROM a
UNION ALL SELECT 'price', c::VARCHAR, CASE WHEN c % 100 = 0 THEN format('${}', c // 100) ELSE printf('$%.2f', c / 100) END FROM p
UNION ALL SELECT 'tier', t, CASE WHEN coalesce(t, '') = '' THEN 'Prepaid' ELSE upper(t[1]) || t[2:] END FROM t
UNION ALL SELECT 'type', t, array_to_string(list_transform(string_split(t, '_'), lambda w: upper(w[1]) || w[2:]), ' ') FROM k
UNION ALL SELECT 'color', t, CASE WHEN regexp_full_match(t, '#[0-9A-Fa-f]{6}') THEN t ELSE '#DC2626' END FROM c""",
    "output_paths": "WITH " + values("f", ["path"], fx.FILES) + r" SELECT path, regexp_replace(path, '(\.[^./]*)$', '_scrubbed\1') AS scrubbed, regexp_replace(path, '(\.[^./]*)$', '_fulltext.txt') AS full_text FROM f WHERE lower(path) LIKE '%.pdf'",
    "redeem_status": "WITH " + values("r", ["status", "message"], fx.REDEEM) + """ SELECT status, message, CASE WHEN status = 200 THEN 'ok' WHEN status = 400 THEN CASE WHEN contains(coalesce(message, ''), 'no_account') THEN 'no_account' ELSE 'invalid_input' END
 WHEN status = 403 THEN CASE WHEN contains(coalesce(message, ''), 'key_belongs_to_other_account') THEN 'key_belongs_to_other_account' ELSE 'invalid_key' END
 WHEN status = 409 AND contains(coalesce(message, ''), 'already_applied') THEN 'already_applied' WHEN status = 429 THEN 'rate_limited' WHEN status = 503 THEN 'validate_unavailable' ELSE 'network_error' END AS outcome FROM r""",
    "tier_dimension": "WITH " + values("p", ["product_id", "tier", "pages", "price_cents"], fx.PRODUCTS) + " SELECT product_id, tier, pages::BIGINT AS pages, price_cents::BIGINT AS price_cents FROM p",
    "label_categories": "WITH " + values("m", ["vocab", "raw", "category"], [("model", k, v) for k, v in LABEL_CATEGORY.items()] + [("display", c, c) for c in CATEGORIES] + [("identifier", t, CUSTOM_ALIASES.get(t, t)) for t in IDENTIFIER_TYPES]) + " SELECT * FROM m",
    "device_id": _DEVICES,
    "validate_ids": """SELECT c_custkey, c_custkey % 3 <> 0 AS machine_ok, c_custkey % 3 <> 0 AS device_ok, c_custkey % 5 <> 0 AND c_custkey * 7 % 12000 - 100 BETWEEN 1 AND 10000 AS pages_ok FROM customer""",
    "hourly_rollup": f"WITH {EVENTS}, {HOURLY} SELECT hour::TIMESTAMP AS hour, pii_type, count FROM hourly",
    "hourly_runs": f"SELECT {TRUNC}::TIMESTAMP AS hour, count(*) AS runs FROM events GROUP BY ALL",
    "additive_upsert": f"WITH {EVENTS}, {HOURLY} SELECT hour::TIMESTAMP AS hour, pii_type, count FROM hourly",
    "summary_totals": f"WITH {EVENTS}, {HOURLY} SELECT pii_type, sum(count)::BIGINT AS total, (SELECT count(*) FROM events) AS total_runs FROM hourly GROUP BY GROUPING SETS ((pii_type), ())",
    "history_window": f"WITH {EVENTS}, {HOURLY} SELECT hour::TIMESTAMP AS hour, pii_type, count FROM hourly WHERE hour >= TIMESTAMP '2024-01-14 12:00:00'",
    "recent_purchases": f"WITH {PURCHASES} SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC)::INTEGER AS place FROM p QUALIFY place <= 10",
    "purchased_total": f"WITH {PURCHASES} SELECT account_id, sum(quota_total)::BIGINT AS total FROM p GROUP BY ALL",
    "waterfall_split": """SELECT o_orderkey, from_daily, from_week1, pages - from_daily - from_week1 AS from_prepaid FROM
(SELECT o_orderkey, 1 + o_orderkey % 25 AS pages, least(o_orderkey % 2, pages) AS from_daily, least(o_custkey % 21, pages - from_daily) AS from_week1 FROM orders)""",
    "balance_pivot": f"""WITH {PURCHASES}, s AS (SELECT account_id, sum(quota_total) FILTER (id % 3 = 0) AS d, sum(quota_total) FILTER (id % 3 = 1) AS w, sum(quota_total) FILTER (id % 3 = 2) AS q FROM p GROUP BY ALL),
l AS (SELECT account_id, greatest(coalesce(d, 0) - 150, 0)::BIGINT AS daily_left, greatest(coalesce(w, 0) - 150, 0)::BIGINT AS week1_left, greatest(coalesce(q, 0) - 150, 0)::BIGINT AS prepaid_left FROM s)
SELECT *, daily_left + week1_left + prepaid_left AS available FROM l""",
    "resolve_accounts": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND (c_custkey % 6 <> 0 OR c_custkey % 7 <> 0) THEN c_custkey END AS account_id,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN 'machine' WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN 'device' WHEN c_custkey % 7 <> 0 THEN 'created' ELSE 'invalid_device' END AS outcome FROM customer""",
    "migration_pending": "WITH " + values("f", ["filename"], fx.MIGRATIONS) + ", " + values("a", ["filename"], fx.APPLIED) + " SELECT filename FROM f WHERE filename LIKE '%.sql' AND filename NOT IN (SELECT filename FROM a)",
    "offline_overlay": """WITH s AS (SELECT c_custkey AS client, c_custkey % 11 AS o, c_custkey % 2 AS du, c_custkey % 20 AS wu, c_custkey % 3 = 2 AS active, c_custkey % 9 AS pu, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 4 * 5 END AS pg FROM customer),
d AS (SELECT *, least(greatest(1 - du, 0), o) AS dt FROM s), w AS (SELECT *, least(CASE WHEN active THEN 20 - wu ELSE 0 END, o - dt) AS wt FROM d)
SELECT client, du + dt AS daily_usage, wu + wt AS week1_usage, pu + least(CASE WHEN pg IS NULL THEN 0 ELSE greatest(pg - pu, 0) END, o - dt - wt) AS prepaid_usage FROM w""",
    "classify_samples": CLASSIFIED + " SELECT line_no::BIGINT AS line_no, status, token_errors FROM classified",
    "validate_samples": CLASSIFIED + " SELECT count(*) AS n_lines, count(*) FILTER (status = 'schema_error') AS schema_errors, sum(token_errors)::BIGINT AS token_errors FROM classified WHERE status <> 'blank'",
    "clean_samples": CLASSIFIED + " SELECT line_no::BIGINT AS line_no, md5(raw) AS raw_md5 FROM classified WHERE status NOT IN ('short', 'token_error')",
    "audit_diff": AUDIT + """ SELECT sample_id::BIGINT AS sample_id, coalesce((SELECT string_agg(type || '=' || value, ';' ORDER BY type, value) FROM added a WHERE a.sample_id = i.sample_id), '') AS added,
coalesce((SELECT string_agg(type || '=' || value, ';' ORDER BY type, value) FROM gone g WHERE g.sample_id = i.sample_id), '') AS removed FROM ids i WHERE sample_id IN (SELECT sample_id FROM added UNION SELECT sample_id FROM gone)""",
    "audit_totals": AUDIT + " SELECT (SELECT count(*) FROM (SELECT sample_id FROM added UNION SELECT sample_id FROM gone)) AS changed, (SELECT count(*) FROM added) AS added",
    "parity_diff": PARITY + " SELECT * FROM parity",
    "parity_top": PARITY + " SELECT * FROM parity WHERE side = 'both' ORDER BY drift DESC, label, text LIMIT 5",
    "length_profile": "WITH l AS (SELECT list(length(text) ORDER BY length(text)) AS l, count(*) AS n FROM documents), i AS (SELECT l, n, lambda_p AS p FROM l, (VALUES (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) v(lambda_p))"
    " SELECT n, l[1]::INTEGER AS least, " + ", ".join(f"l[CASE WHEN floor(n * {p}) - 1 < 0 THEN n ELSE floor(n * {p})::BIGINT END]::INTEGER AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", l[n]::INTEGER AS most FROM l",
    "label_census": SPAN_ROWS + " SELECT s->>'label' AS label, count(*) AS n FROM (SELECT unnest(ss) AS s FROM lists) WHERE s->>'label' <> '' GROUP BY ALL",
    "pattern_census": SPAN_ROWS + " SELECT s->>'label' AS label, count(*) AS n FROM (SELECT unnest(ss) AS s, pos FROM lists JOIN hits USING (row_id)) WHERE abs(coalesce((s->>'start')::INTEGER, -999) - pos) < 80 GROUP BY ALL",
    "pattern_hits": SPAN_ROWS + " SELECT row_id::BIGINT AS row_id, pos::INTEGER AS \"at\", replace(substr(text, (greatest(pos - 20, 0) + 1)::INTEGER, (pos + 80 - greatest(pos - 20, 0))::INTEGER), chr(10), ' ') AS context FROM hits",
    "quality_census": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "acquired_stamps": """WITH t AS (SELECT o_orderkey, o_orderdate + to_minutes(o_orderkey * 37) AS ts FROM orders), f AS (SELECT o_orderkey, strftime(ts, '%b %-d') AS d, strftime(ts, '%-I:%M %p') AS t, ts FROM t)
SELECT o_orderkey, d || repeat(' ', greatest(1, 15 - length(d) - length(t))) || t AS stamp, strftime(ts, '%-m/%-d/%Y, %-I:%M %p') AS shown, CASE WHEN o_orderkey = 0 THEN '' ELSE printf('%.1f MB', o_orderkey * 104858 / 1048576) END AS size FROM f""",
    "reading_order": PLACED + """ SELECT doc_id, type, value, row_number() OVER (PARTITION BY doc_id, type, value ORDER BY page_num, 792 - y1, x0)::INTEGER AS place, page_num,
floor((792 - y1) * 300 / 72 * 10 + 0.5)::BIGINT AS y, floor(x0 * 300 / 72 * 10 + 0.5)::BIGINT AS x FROM placed""",
    "scanned_pages": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS raw_line FROM documents),
w AS (SELECT doc_id, raw_line // 40 + 1 AS page_num, raw_line % 40 AS line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS i FROM l WHERE raw_line % 40 % 5 <> 0)
SELECT doc_id, page_num::INTEGER AS page_num, count(*) AS n_words, max(floor((i * 50.0 + 51) * 72 / 300 * 1000 + 0.5)::BIGINT) AS "right", min(floor((3300 - line_no * 40.0 - 30) * 72 / 300 * 1000 + 0.5)::BIGINT) AS bottom
FROM w WHERE trim(text) <> '' GROUP BY ALL""",
    "painted_pages": PLACED + """, px AS (SELECT p.doc_id, p.page_num, x0 * 0.1::DOUBLE AS x, (792 - y1) * 0.1::DOUBLE AS y, (x1 - x0) * 0.1::DOUBLE AS w, (y1 - y0) * 0.1::DOUBLE AS h
  FROM placed p WHERE value IN (SELECT value FROM placed WHERE type IN ('email', 'ip_address'))),
dots AS (SELECT DISTINCT doc_id, page_num, a, b FROM (SELECT doc_id, page_num, y, h, unnest(generate_series(greatest(0, floor(x)::INTEGER), least(60, floor(x + w)::INTEGER))) AS a FROM px),
         LATERAL (SELECT unnest(generate_series(greatest(0, floor(y)::INTEGER), least(78, floor(y + h)::INTEGER))) AS b))
SELECT doc_id, page_num, count(a) AS painted, 13 + 61 * 79 * 3 AS n_bytes FROM text_pages LEFT JOIN dots USING (doc_id, page_num) GROUP BY ALL""",
    "sampled_documents": "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10000",
    "model_entities": f"""WITH {DOCS}, """ + _chunks("docs") + """, hits AS (
  SELECT doc_id, chunk_idx, chunk_offset, h[k] AS text, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, chunk_idx, chunk_offset, regexp_extract_all(chunk, '[A-Z]{3,}') AS h, regexp_split_to_array(chunk, '[A-Z]{3,}') AS p FROM chunks WHERE regexp_matches(chunk, '[A-Z]{3,}')), generate_series(1, len(h)) g(k)),
rebased AS (SELECT doc_id, chunk_idx, (chunk_offset + start)::INTEGER AS g_start, (chunk_offset + start + length(text))::INTEGER AS g_end, text FROM hits WHERE length(text) >= 6)
SELECT doc_id, g_start, g_end, 'full_name' AS label, text, least(1.0, length(text) / 16)::DOUBLE AS score FROM rebased QUALIFY row_number() OVER (PARTITION BY doc_id, g_start, g_end ORDER BY chunk_idx) = 1""",
    "jsonl_lines": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS raw FROM nation WHERE n_nationkey % 5 <> 3""",
    "stream_json_lines": """SELECT '{"cmd":"detect","kind":"pii","item":{"type":"' || event_type || '","value":"' || event_id || '"}}' AS raw FROM events""",
    "opened_accounts": """WITH made AS (SELECT md5(c_custkey::VARCHAR) AS machine_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0)
SELECT machine_id, kept_in, sku, CASE WHEN kept_in = 'balances' THEN 0::BIGINT END AS usage, pages, CASE WHEN kept_in = 'balances' THEN a END AS period_start, CASE WHEN kept_in = 'balances' THEN z END AS period_end
FROM made, (VALUES ('balances'), ('purchases')) k(kept_in),
     (VALUES ('free_week1', 20::BIGINT, TIMESTAMP '2024-03-05 14:30:00', TIMESTAMP '2024-03-12 14:30:00'), ('free_daily', 1, TIMESTAMP '2024-03-05 00:00:00', TIMESTAMP '2024-03-06 00:00:00')) s(sku, pages, a, z)""",
    "relinked_accounts": "WITH d AS (" + _DEVICES + """) SELECT c_custkey AS account_id, machine_id, CASE WHEN c_custkey % 7 = 0 THEN reverse(device_id) ELSE device_id END AS device_id
FROM d WHERE c_custkey % 3 = 0 AND (c_custkey % 6 = 0) <> (c_custkey % 7 = 0)""",
    "audit_applied": AUDIT + " SELECT sample_id::BIGINT AS sample_id, string_agg(type || '=' || value, ';' ORDER BY seq) AS items FROM now GROUP BY sample_id",
    "concat_samples": _synthetic(60) + """ SELECT 0 AS part, "row", kind FROM notes WHERE "row" < 51 UNION ALL SELECT 1, "row", kind FROM notes WHERE "row" < 9 UNION ALL SELECT 2, "row", kind FROM notes""",
    "download_totals": "SELECT count(*) AS files, sum(size)::BIGINT AS total FROM (SELECT l_orderkey % 5 AS file, max(l_partkey) AS size FROM lineitem GROUP BY ALL)",
    "command_outcomes": """WITH e AS (SELECT event_id, event_id % 2 = 0 AS detect, event_id % 3 AS phase, event_id % 7 % 4 AS status FROM events)
SELECT event_id, status = 3 OR (status = 2 AND ((detect AND phase = 1) OR (NOT detect AND phase = 2))) AS ends FROM e""",
    "page_progress": "SELECT doc_id, phase, floor(max(n) + 0.5)::INTEGER AS percent FROM (SELECT user_id % 20 AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'ocr' ELSE 'analyze' END AS phase, CASE WHEN event_id % 2 = 0 THEN event_id % 97 ELSE event_id % 89 END AS n FROM events) GROUP BY ALL",
    "penalty_notices": "WITH p AS (SELECT o_custkey AS client, o_orderdate AS lease_issued_at, o_orderkey % 4 AS charged, o_orderkey AS k FROM orders) SELECT client, lease_issued_at, max(charged) AS charged FROM p WHERE charged > 0 AND (client, lease_issued_at) NOT IN (SELECT (client, lease_issued_at) FROM p WHERE k % 3 = 0) GROUP BY ALL",
    "purchases_detected": "WITH b AS (SELECT c_custkey AS client, CASE WHEN c_custkey % 5 > 0 THEN greatest(c_custkey % 50 - 10, 0) ELSE 0 END AS was FROM customer), p AS (SELECT o_custkey AS client, o_orderdate AS at_, greatest(o_orderkey % 60 - 10, 0) AS now_ FROM orders) SELECT client, min(at_) AS \"at\" FROM p LEFT JOIN b USING (client) WHERE now_ > coalesce(was, 0) GROUP BY client",
    "stream_rollup": f"SELECT {TRUNC}::TIMESTAMP AS hour, event_type AS pii_type, count(*) AS count FROM events GROUP BY ALL",
    "stream_ui_fold": """WITH e AS (SELECT user_id % 20 AS doc_id, event_id, event_id % 50 = 49 AS ends, event_type AS type, (event_id % 3)::VARCHAR AS value FROM events),
cut AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part, count(*) FILTER (ends) OVER (PARTITION BY doc_id) AS parts FROM e),
held AS (SELECT doc_id, part, type, value, count(*) AS count, min(event_id) AS first FROM cut WHERE NOT ends AND part < parts GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id, part ORDER BY first) - 1 AS seq, type, value, count, 'done' AS status FROM held""",
    "stream_grants": "SELECT DISTINCT event_id::VARCHAR AS order_id FROM events",
}
