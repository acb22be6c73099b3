"""SQL for DuckDB of the operators that SQL can express."""

JACCARD = r"""
WITH RECURSIVE texts AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS text_id, count(*) AS n_copies FROM documents GROUP BY 1
), words AS (
  SELECT text_id, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), shingles AS (
  SELECT DISTINCT text_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (
  SELECT text_id, count(*) AS n FROM shingles GROUP BY 1
), common AS (
  SELECT a.text_id AS x, b.text_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.text_id <> b.text_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.text_id = x JOIN sizes q ON q.text_id = y
  WHERE c / (p.n + q.n - c) >= 0.8
), reached(x, y) AS (
  SELECT text_id, text_id FROM texts UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), named AS (
  SELECT x AS text_id, min(y) AS class_id FROM reached GROUP BY 1
), degree AS (
  SELECT x AS text_id, count(*) AS n_links FROM links GROUP BY 1
)
SELECT d.doc_id, class_id, text_id, coalesce(n_links, 0) AS n_links, n_copies
FROM documents d JOIN texts t ON coalesce(d.text, '') = t.text JOIN named USING (text_id) LEFT JOIN degree USING (text_id)
"""

CHAT = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations
), views AS (
  SELECT DISTINCT conv_id, name AS participant FROM turns WHERE name <> 'system'
), pieces AS (
  SELECT t.conv_id, participant, turn, name, text,
    CASE WHEN name = participant THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN name = participant THEN '<|im_start|>assistant' WHEN name = 'system' THEN '<|im_start|>system'
      ELSE '<|im_start|>user name=' || name END || chr(10) AS head
  FROM turns t JOIN views v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), rendered AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM pieces
), placed AS (
  SELECT *, row_number() OVER w AS seq,
    sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
  FROM rendered WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, name, text)
)
SELECT conv_id, participant, seq, role, name, rendered, stop - length(rendered) AS start, stop,
  CASE WHEN role = 'assistant' THEN stop - length(rendered) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN stop - 1 END AS mask_stop
FROM placed
"""

RULES = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), positions AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM words
), starts AS (
  SELECT doc_id, i, i + 7 <= len(w)
    AND count(*) OVER (PARTITION BY doc_id, i + 7 <= len(w), array_to_string(w[i:i + 7], ' ')) > 1 AS twice FROM positions
), covered AS (
  SELECT doc_id, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM starts
), repeated AS (
  SELECT doc_id, sum(c)::BIGINT AS n FROM covered GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts
), doubled AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \x09-\x0D]') GROUP BY 1
), counts AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words,
    coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(doubled.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN doubled USING (doc_id) LEFT JOIN repeated USING (doc_id)
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_words, 1) AS line_rate,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 100 * word_chars // greatest(n_words, 1) AS word_length
  FROM counts
), rates AS (
  UNPIVOT (SELECT lang, source, symbol_rate, line_rate, repeat_rate, word_length FROM base WHERE NOT base_failed)
  ON symbol_rate, line_rate, repeat_rate, word_length INTO NAME rate VALUE v
), bins AS (
  SELECT lang, source, rate, (v >> k) << k AS bin, count(*) AS n
  FROM (SELECT *, greatest(length(bin(v)) - 7, 0)::INT AS k FROM rates) GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, rate, bin, n FROM bins
  UNION ALL SELECT 2, lang, NULL, rate, bin, sum(n) FROM bins GROUP BY ALL
  UNION ALL SELECT 3, NULL, NULL, rate, bin, sum(n) FROM bins GROUP BY ALL
), running AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM levels
), quartiles AS (
  SELECT level, lang, source, rate, max(total) AS total, min(bin) FILTER (upto * 4 >= total) AS q1,
    min(bin) FILTER (upto * 4 >= total * 3) AS q3 FROM running GROUP BY ALL
), chosen AS (
  SELECT a.lang, a.source, a.rate,
    CASE WHEN a.total >= 30 THEN a.q1 WHEN b.total >= 30 THEN b.q1 ELSE c.q1 END AS q1,
    CASE WHEN a.total >= 30 THEN a.q3 WHEN b.total >= 30 THEN b.q3 ELSE c.q3 END AS q3
  FROM quartiles a JOIN quartiles b ON b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.rate = b.rate
  JOIN quartiles c ON c.level = 3 AND a.rate = c.rate WHERE a.level = 1
), limits AS (
  SELECT lang, source,
    max(q3 + 3 * (q3 - q1) + 100) FILTER (rate = 'symbol_rate') AS symbols,
    max(q3 + 3 * (q3 - q1) + 20) FILTER (rate = 'line_rate') AS lines,
    max(q3 + 3 * (q3 - q1) + 250) FILTER (rate = 'repeat_rate') AS repeats,
    max(q3 + 3 * (q3 - q1) + 100) FILTER (rate = 'word_length') AS longest,
    max(q1 - 3 * (q3 - q1) - 100) FILTER (rate = 'word_length') AS shortest
  FROM chosen GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol_rate <= symbols AND line_rate <= lines AND repeat_rate <= repeats
    AND word_length <= longest AND word_length >= shortest, false) AS kept
FROM base b LEFT JOIN limits l ON b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source
"""

PHRASES = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM cut
), spans AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (SELECT unnest([1, 2, 3, 4]) AS size)
), f AS (
  SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM spans GROUP BY lang, phrase
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND a >= 30
), parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, (SELECT unnest([1, 2, 3]) AS k) WHERE k < size
), scores AS (
  SELECT p.lang, p.phrase, p.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * p.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = first JOIN f y ON y.lang = p.lang AND y.phrase = rest
), least AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, size, a, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase
  FROM candidates, (SELECT unnest([2, 3]) AS n) WHERE n < size
), longer AS (
  SELECT lang, phrase, max(a) AS longest FROM inner_parts GROUP BY lang, phrase
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, l, r, score
  FROM least s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase WHERE coalesce(100 * longest < 80 * s.a, true)
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
"""

NEAR = r"""
WITH RECURSIVE words AS (
  SELECT text, min(doc_id) AS text_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents GROUP BY text
), shingles AS (
  SELECT DISTINCT text_id, unnest(CASE
    WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) ELSE w END) AS s FROM words
), sizes AS (
  SELECT text_id, count(*) AS n FROM shingles GROUP BY 1
), ranks AS (
  SELECT s, row_number() OVER (ORDER BY count(*), s) AS rare FROM shingles GROUP BY s
), prefixes AS (
  -- Of two sets with four fifths of their union in common, the rarest fifth of each meets the other's.
  SELECT text_id, rare FROM shingles JOIN ranks USING (s) JOIN sizes USING (text_id)
  QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY rare) <= n - (4 * n + 4) // 5 + 1
), candidates AS (
  SELECT DISTINCT a.text_id AS x, b.text_id AS y FROM prefixes a JOIN prefixes b ON a.rare = b.rare AND a.text_id < b.text_id
), common AS (
  SELECT x, y, count(*) AS c FROM candidates JOIN shingles a ON a.text_id = x JOIN shingles b ON b.text_id = y AND a.s = b.s GROUP BY x, y
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.text_id = x JOIN sizes q ON q.text_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached(x, y) AS (
  SELECT text_id, text_id FROM sizes UNION SELECT r.x, l.y FROM reached r JOIN both_ways l ON l.x = r.y
), named AS (
  SELECT x AS text_id, min(y) AS component_id FROM reached GROUP BY 1
), found AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
  FROM documents d JOIN words t ON d.text IS NOT DISTINCT FROM t.text LEFT JOIN sizes USING (text_id) LEFT JOIN named USING (text_id)
)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found
"""

REPAIR = r"""
WITH RECURSIVE bits AS (
  SELECT n, 0 AS k, n::UBIGINT AS v FROM range(256) t(n)
  UNION ALL SELECT n, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY n) AS crc FROM bits WHERE k = 8
), filled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), faults AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_transform(string_split(name, ''), lambda c: ascii(c)::UBIGINT), lambda h, c: xor(h >> 8, crc[((xor(h, c) & 255) + 1)::BIGINT]),
    4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS fault FROM filled, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM faults WHERE fault <> 0
), conv AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), ordered AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i
  FROM damaged d JOIN conv ON d.conv_id IS NOT DISTINCT FROM conv.conv_id
), judged AS (
  SELECT *, left(role, 1) AS initial, regexp_matches(text, '[^ \x09-\x0D]') AS said,
    row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
    right(rtrim(text, e' \t\n\x0b\x0c\r'), 1) NOT IN ('.', '!', '?') AS ended_short FROM ordered
), marked AS (
  SELECT *, CASE WHEN NOT said THEN 'blank' WHEN again THEN 'duplicate' WHEN ended_short THEN 'truncated' ELSE 'fine' END AS fault,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS neighbours FROM judged
), counted AS (
  SELECT c, max(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (neighbours IS NOT NULL AND neighbours NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY c
), steps(before, role) AS (
  VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')
), inserted(before, role, edits) AS (
  VALUES ('', '', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('', 'u', 'I'), ('s', 'u', 'I'), ('u', 'a', 'I'), ('a', 'u', 'I'),
    ('', 'a', 'II'), ('s', 'a', 'II'), ('u', 'u', 'II'), ('a', 'a', 'II')
), best AS (
  SELECT c, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit FROM conv
  UNION ALL
  SELECT c, i, state, pick.cost, pick.audit FROM (
    SELECT c, i, state, min({'cost': cost, 'audit': audit}) AS pick FROM (
      SELECT b.c, m.i, x.role AS state, b.cost + 2 * length(x.edits) + 3 AS cost, b.audit || x.edits || 'D' AS audit
      FROM best b JOIN marked m ON m.c = b.c AND m.i = b.i + 1 JOIN inserted x ON x.before = b.state
      UNION ALL
      SELECT b.c, m.i, t.role, b.cost + 2 * length(x.edits) + CASE WHEN t.role = m.initial THEN 0 ELSE 2 END
        + CASE WHEN m.fault = 'truncated' THEN 1 ELSE 0 END, b.audit || x.edits || CASE WHEN t.role = m.initial THEN 'K' ELSE 'R' END
      FROM best b JOIN marked m ON m.c = b.c AND m.i = b.i + 1 JOIN inserted x ON x.before = b.state JOIN steps t ON t.before = x.role
      WHERE m.fault IN ('fine', 'truncated') AND (t.role = m.initial OR t.role <> 's')
    ) GROUP BY c, i, state)
), ended AS (
  SELECT b.c, min({'cost': b.cost + 2 * length(x.edits), 'audit': b.audit || x.edits}) AS pick
  FROM best b JOIN counted n ON n.c = b.c AND b.i = n.rows JOIN inserted x ON x.before = b.state WHERE x.role IN ('', 'a') GROUP BY b.c
), edits AS (
  SELECT c, pick.audit AS audit, unnest(range(1, length(pick.audit) + 1)) AS k FROM ended
), placed AS (
  SELECT c, k, audit[k] AS edit, sum(CASE WHEN audit[k] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY k) AS i FROM edits
), kept AS (
  SELECT p.c, k, edit, CASE WHEN edit = 'K' THEN m.role END AS own, CASE WHEN edit = 'I' THEN '' ELSE m.text END AS text,
    row_number() OVER (PARTITION BY p.c ORDER BY k) AS place FROM placed p LEFT JOIN marked m ON m.c = p.c AND m.i = p.i AND edit <> 'I'
  WHERE edit <> 'D'
), heads AS (
  SELECT c, max(CASE WHEN place = 1 AND left(own, 1) = 's' THEN 1 ELSE 0 END) AS system FROM kept GROUP BY c
), lines AS (
  SELECT c, place, coalesce(own, CASE WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text AS line
  FROM kept JOIN heads USING (c)
), repaired AS (
  SELECT c, sha256(string_agg(line, chr(10) ORDER BY place)) AS digest FROM lines GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(pick.cost, 0) AS cost,
  coalesce(pick.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM conv LEFT JOIN counted USING (c) LEFT JOIN ended USING (c) LEFT JOIN repaired USING (c)
"""

ORACLES = {
    "op10_jaccard_join": JACCARD,
    "op11_near_dedup": NEAR,
    "op12_repair": REPAIR,
    "op13_phrases": PHRASES,
    "op5_chat": CHAT,
    "op6_quality_rules": RULES,
}
