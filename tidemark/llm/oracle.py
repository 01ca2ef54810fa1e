"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

ESCAPED = r"regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g')"

_CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), steps AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length({ESCAPED}) + 24)::BIGINT AS formatted_chars,
  bool_and(CASE role
    WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END)
  AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM steps GROUP BY conv_id
"""


def _jump(shards: int) -> str:
    """The published loop over 64-bit keys, in 128-bit arithmetic."""
    return f"""
  SELECT doc_id, -1::BIGINT AS spot, 0::BIGINT AS jump, coalesce(doc_id, 0)::HUGEINT AS key FROM ids
  UNION ALL
  SELECT doc_id, jump, floor((jump + 1) * (2147483648.0::DOUBLE / (((step >> 33) + 1)::DOUBLE)))::BIGINT, step
  FROM (
    SELECT doc_id, jump, (key * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS step
    FROM jumps{shards} WHERE jump < {shards}
  )"""


# The slots hold for tables of one block, up to 16,384 rows: beyond, blocks go by a hash that SQL there lacks.
_SHARDS = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents),
jumps16(doc_id, spot, jump, key) AS ({_jump(16)}),
jumps17(doc_id, spot, jump, key) AS ({_jump(17)}),
bytes_of AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry
  FROM range(256) t(i)
),
table_of AS (SELECT list(entry ORDER BY i) AS entries FROM bytes_of),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS digits
  FROM documents
),
sums AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM sized, table_of
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, a.spot::INTEGER AS shard, b.spot::INTEGER AS grown_shard,
  row_number() OVER (PARTITION BY a.spot ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM sums
JOIN (SELECT doc_id, max(spot) AS spot FROM jumps16 GROUP BY doc_id) a USING (doc_id)
JOIN (SELECT doc_id, max(spot) AS spot FROM jumps17 GROUP BY doc_id) b USING (doc_id)
"""

_BASE32 = """
  list_aggregate(list_transform(range(32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_aggregate(list_transform(range(5), lambda k: CASE WHEN
      ((instr('0123456789abcdef', substr(digest, (5 * g + k) // 4 + 1, 1)) - 1) >> (3 - (5 * g + k) % 4)) & 1 = 1
      THEN 16 >> k ELSE 0 END), 'sum')::INTEGER + 1, 1)), 'string_agg', '')"""

_WARC = f"""
WITH digests AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest
  FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM digests)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM firsts
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

_DECONTAMINATION = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS spelling, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
spans AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
found AS (
  SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS spelling FROM spans)
  JOIN windows USING (spelling, n)
),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_FILL_IN_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT *, array_to_string(u[1 : least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1 : len(u)], '') AS s
  FROM drawn
)
SELECT doc_id, len(u)::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

#: The published bitwise loop of CRC-32 over a short text of one-byte characters.
_CRC32 = """xor(list_reduce(list_transform(range(1, length(spelled) + 1), lambda i: ascii(substr(spelled, i, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END,
      xor(c, b)), 4294967295::BIGINT), 4294967295)"""

_FAR = "{'c': 1000000000, 'a': ''}"


def _way(state: str, cost: str, letters: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letters}}}"


def _ways(to: str) -> str:
    """The best way to a state over one more row, by cost, then by audit."""
    stay = _way(to, "2", "'D'")
    if to == "b":
        return stay
    if to == "s":
        return f"list_min([{stay}, CASE WHEN must_go OR initial <> 's' THEN {_FAR} ELSE {_way('b', 'open', chr(39) + 'K' + chr(39))} END])"
    stands = f"(CASE WHEN initial = '{to}' THEN 0 ELSE 1 END) + open"
    letter = f"(CASE WHEN initial = '{to}' THEN 'K' ELSE 'R' END)"
    ask = ("b", "s", "a")
    direct, inserted = (ask, ("u",)) if to == "u" else (("u",), ask)
    ways = [_way(x, stands, letter) for x in direct]
    ways += [_way(x, f"5 + {stands}", f"'I' || {letter}") for x in inserted]
    return f"list_min([{stay}, {', '.join(f'CASE WHEN must_go THEN {_FAR} ELSE {w} END' for w in ways)}])"


_REPAIR = rf"""
WITH RECURSIVE drawn AS (
  SELECT *, {_CRC32} % 20 AS kind FROM (
    SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS spelled FROM conversations
  )
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE kind <> 0)
), placed AS (
  SELECT *, sha256(length(role) || ':' || role || text) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS place,
    regexp_replace(text, '[ 	-
]+$', '') AS trimmed
  FROM damaged
), timed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS time FROM placed
), rows AS (
  SELECT conv_id, turn, role, text, place, left(role, 1) AS initial, trimmed = '' AS blank,
    trimmed <> '' AND time > 1 AS duplicate,
    trimmed <> '' AND time = 1 AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM timed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows GROUP BY conv_id
), steps AS (
  SELECT conv_id, place, initial, blank OR duplicate AS must_go, CASE WHEN truncated THEN 5 ELSE 0 END AS open FROM rows
), ways AS (
  SELECT conv_id, 0::BIGINT AS place, {{'c': 0, 'a': ''}} AS b, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a FROM counts
  UNION ALL
  SELECT conv_id, place, {", ".join(f"{_ways(to)} AS {to}" for to in "bsua")} FROM (
    SELECT w.conv_id, r.place, w.b, w.s, w.u, w.a, r.initial, r.must_go, r.open
    FROM ways w JOIN steps r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.place = w.place + 1
  )
), settled AS (
  SELECT w.conv_id, list_min([b, a, {_way("u", "5", "'I'")}, {_way("s", "10", "'II'")}]) AS best
  FROM ways w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.place = c.n
), spelled AS (
  SELECT conv_id, k, substr(best.a, k, 1) AS letter, length(replace(substr(best.a, 1, k), 'I', '')) AS place
  FROM (SELECT *, unnest(range(1, length(best.a) + 1)) AS k FROM settled)
), stands AS (
  SELECT p.conv_id, p.k, p.letter, CASE WHEN p.letter = 'I' THEN '' ELSE r.text END AS text, r.role,
    row_number() OVER w AS m, first_value(p.letter = 'K' AND left(r.role, 1) = 's') OVER w AS headed
  FROM spelled p JOIN rows r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.place = greatest(p.place, 1)
  WHERE p.letter <> 'D' WINDOW w AS (PARTITION BY p.conv_id ORDER BY p.k)
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY k) AS text
  FROM stands GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN settled s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""

_RULES = r"""
WITH split AS (
  SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM documents
), windows AS (
  SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS spelling
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)
), twice AS (
  SELECT id, count(DISTINCT place) AS n FROM (
    SELECT id, unnest([i, i + 1, i + 2]) AS place
    FROM (SELECT *, count(*) OVER (PARTITION BY id, spelling) AS times FROM windows) WHERE times > 1
  ) GROUP BY id
), counts AS (
  SELECT id, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN twice USING (id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), vals AS (
  SELECT id, lang, source, base_failed, unnest([
    {'rule': 'symbols', 'v': 10000 * n_symbols // word_chars, 'least': 40, 'below': false},
    {'rule': 'repeated_lines', 'v': 10000 * n_dup_lines // n_lines, 'least': 600, 'below': false},
    {'rule': 'repeated_words', 'v': 10000 * n_repeat_words // n_words, 'least': 500, 'below': false},
    {'rule': 'word_length', 'v': 100 * word_chars // n_words, 'least': 30, 'below': true}], recursive := true)
  FROM based WHERE n_words > 0
), classed AS (
  SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS class FROM vals WHERE NOT base_failed
), grouped AS (
  SELECT rule, lang, source, grouping(lang, source) AS level, class, count(*) AS n FROM classed
  GROUP BY GROUPING SETS ((rule, lang, source, class), (rule, lang, class), (rule, class))
), sums AS (
  SELECT *, sum(n) OVER (w ORDER BY class) AS upto, sum(n) OVER w AS total
  FROM grouped WINDOW w AS (PARTITION BY rule, level, lang, source)
), q AS (
  SELECT rule, level, lang, source, max(total) AS total, min(class) FILTER (upto * 100 >= total * 50) AS middle,
    min(class) FILTER (upto * 100 >= total * 10) AS tenth
  FROM sums GROUP BY rule, level, lang, source
), limits AS (
  SELECT a.rule, a.lang, a.source,
    CASE WHEN a.total >= 100 THEN a.middle WHEN b.total >= 100 THEN b.middle ELSE c.middle END AS middle,
    CASE WHEN a.total >= 100 THEN a.tenth WHEN b.total >= 100 THEN b.tenth ELSE c.tenth END AS tenth
  FROM q a JOIN q b ON b.level = 1 AND a.rule = b.rule AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN q c ON c.level = 3 AND a.rule = c.rule
  WHERE a.level = 0
), bad AS (
  SELECT DISTINCT id FROM vals v JOIN limits l
    ON v.rule = l.rule AND v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source
  WHERE v > middle + 6 * greatest(middle - tenth, least) OR (below AND v < middle - 6 * greatest(middle - tenth, least))
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.id IS NULL AS kept
FROM based LEFT JOIN bad USING (id)
"""

ORACLE: dict[str, str] = {
    "op11_fill_in_middle": _FILL_IN_MIDDLE,
    "op12_repair": _REPAIR,
    "op13_rules": _RULES,
    "op1_chat": _CHAT,
    "op3_shards": _SHARDS,
    "op6_warc": _WARC,
    "op9_decontaminate": _DECONTAMINATION,
}
