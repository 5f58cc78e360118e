"""SQL of the queries that DuckDB can state over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
SPACED = r"'[^\x20\x09-\x0D]+'"
PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

EXACT = f"""WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {SPACED}) AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) AS u(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM both_have JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
 edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT edges.y, reach.c FROM reach JOIN edges ON reach.doc_id = edges.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

PASSAGES = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM d, unnest(range(1, greatest(len(ws) - 11, 1))) AS u(i)),
 firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
 hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (s) WHERE doc_id > f),
 words AS (SELECT doc_id, i, ws[i] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
 per AS (SELECT words.doc_id, count(p) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (p IS NULL) AS k FROM words LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.p = words.i GROUP BY words.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)"""

COPIES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM d, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS u(i)),
 firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
 hit AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE doc_id > f),
 marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS head FROM hit),
 numbered AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
 runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, g),
 cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
 per AS (SELECT cut.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(max(h), 2 * max(b) + 1) AS k FROM cut JOIN d USING (doc_id) GROUP BY cut.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)"""

MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {SPACED})) AS size FROM documents),
 s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
 s1 AS (SELECT *, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1] AS weight, ([-0.5, 0.0, 0.5])[(rank - 1) % 3 + 1] AS lean, 2.0 * source_size AS cap FROM s0),
 s2 AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
 s3 AS (SELECT *, least(cap, weight * max(level) OVER ()) AS target FROM s2),
 r AS (SELECT d.doc_id, d.size, s3.*, CAST('0x' || substring(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 15) AS BIGINT) AS draw FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
 b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins, CAST(floor(target + 1e-6) AS BIGINT) AS goal FROM r),
 c AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM b),
 e AS (SELECT *, CAST(whole * size + least(greatest(goal - whole * source_size - begins, 0), size) AS BIGINT) AS taken FROM c),
 f AS (SELECT *, CASE WHEN target > 0 THEN least(begins / target, 1.0) ELSE 0.0 END AS part, CASE WHEN taken > 0 THEN least((((taken - 1) // size) * source_size + begins) / target, 1.0) END AS last_part FROM e)
SELECT doc_id, size, source_size, round(CAST(target AS DOUBLE), 6) AS target, taken,
 round(CASE WHEN lean = 0 THEN part ELSE coalesce(2 * part / nullif(1 - lean + sqrt((1 - lean) * (1 - lean) + 4 * lean * part), 0), 0) END, 9) AS position,
 round(CASE WHEN lean = 0 THEN last_part WHEN taken > 0 THEN coalesce(2 * last_part / nullif(1 - lean + sqrt((1 - lean) * (1 - lean) + 4 * lean * last_part), 0), 0) END, 9) AS last_position FROM f"""

LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {PLAIN}) AS ws FROM documents),
 items AS (SELECT item_id, regexp_extract_all({LOWERED}, {PLAIN}) AS ws FROM benchmark),
 wanted AS (SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS s FROM items, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
 win AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM wanted) AS l, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS u(i)),
 found AS (SELECT doc_id, i, win.n, item_id FROM win JOIN wanted ON win.s = wanted.s AND win.n = wanted.n),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
CRC_TABLE = "crcs AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i))"

REPAIRS = f"""WITH RECURSIVE {CRC_TABLE},
 drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS draw FROM conversations, crcs),
 hurt AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM hurt),
 seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, trim(text, E' \\t\\n\\x0b\\x0c\\r') AS bare FROM placed),
 lines_of AS (SELECT conv_id, pos, turn, role, text, role[1] AS x, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS y FROM seen),
 step(p, x, q, name) AS (VALUES (0, 's', 1, 'system'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
 begun AS (SELECT p, p AS spot, 0 AS cost, '' AS letters, '' AS line FROM range(4) AS r(p) UNION ALL SELECT p, q, 2, 'I', CASE WHEN p = 0 THEN '' ELSE chr(10) END || name || ':' FROM step WHERE x <> 's'),
 ways AS (SELECT p, spot AS q, cost + 3 AS cost, letters || 'D' AS letters, line, CAST(NULL AS VARCHAR) AS wants, CAST(NULL AS VARCHAR) AS gives, false AS stays, spot = 0 AS opens FROM begun
  UNION ALL SELECT b.p, q, b.cost, letters || 'K', line, x, NULL, true, spot = 0 FROM begun b JOIN step s ON s.p = b.spot
  UNION ALL SELECT b.p, q, b.cost + 2, letters || 'R', line, NULL, name, true, spot = 0 FROM begun b JOIN step s ON s.p = b.spot WHERE x <> 's'),
 walk AS (SELECT conv_id, 0 AS state, CAST(0 AS BIGINT) AS pos, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT w.conv_id, q, r.pos, min({{'cost': w.best.cost + m.cost + CASE WHEN stays AND fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || letters, 'lines': w.best.lines || line || CASE WHEN stays THEN CASE WHEN opens THEN '' ELSE chr(10) END || coalesce(gives, role) || ':' || text ELSE '' END}})
  FROM walk w JOIN lines_of r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1 JOIN ways m ON m.p = w.state AND (wants IS NULL OR wants = r.x) AND NOT (stays AND fault IN ('blank', 'duplicate')) GROUP BY w.conv_id, q, r.pos),
 counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pos > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal FROM lines_of GROUP BY conv_id),
 ended AS (SELECT w.conv_id, min({{'cost': w.best.cost + t.cost, 'audit': w.best.audit || t.letters, 'lines': w.best.lines || t.line}}) AS best FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, 2, 'I', chr(10) || 'assistant:'), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')) AS t(state, cost, letters, line) ON t.state = w.state WHERE w.pos = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(e.best.lines) AS repaired_sha256 FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""

FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
HEAD = " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
MERKLE = f"""WITH RECURSIVE {CRC_TABLE},
 d AS (SELECT doc_id, coalesce('1' || lang, '0') AS unit, sha256({HEAD} || {FIELD.format("text")}) AS leaf, CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({HEAD} || {FIELD.format(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS struck FROM documents, crcs),
 l AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id NULLS FIRST, leaf, struck) - 1 AS place, count(*) OVER (PARTITION BY unit) AS n FROM d),
 up AS (SELECT unit, 0 AS level, place AS spot, leaf AS h, n FROM l
  UNION ALL SELECT unit, level + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY unit, level + 1, spot // 8),
 subs AS (SELECT unit, level AS tall, h AS subroot, row_number() OVER (ORDER BY unit) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
 higher AS (SELECT 0 AS level, place AS spot, subroot AS h, n FROM subs
  UNION ALL SELECT level + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), any_value((n + 7) // 8) FROM higher WHERE n > 1 GROUP BY level + 1, spot // 8),
 runs AS (SELECT unit, level, spot // 8 AS run, list(h ORDER BY spot) AS hs FROM up WHERE n > 1 GROUP BY ALL),
 over_runs AS (SELECT level, spot // 8 AS run, list(h ORDER BY spot) AS hs FROM higher WHERE n > 1 GROUP BY ALL),
 way AS (SELECT unit, place AS nth, place AS spot, 0 AS level, 0 AS above, coalesce(struck, leaf) AS h, '' AS proof FROM l
  UNION ALL SELECT w.unit, w.nth, CASE WHEN r.hs IS NULL THEN s.place // 8 ELSE w.spot // 8 END, w.level + 1, CASE WHEN r.hs IS NULL THEN 1 ELSE 0 END + w.above,
   sha256(array_to_string(list_concat(coalesce(r.hs, o.hs)[1:k], [w.h], coalesce(r.hs, o.hs)[k + 2:]), '')), w.proof || array_to_string(list_concat(coalesce(r.hs, o.hs)[1:k], coalesce(r.hs, o.hs)[k + 2:]), '')
   FROM (SELECT way.*, subs.place, tall, CASE WHEN level < tall THEN spot % 8 WHEN level = tall THEN place % 8 ELSE spot % 8 END AS k FROM way JOIN subs USING (unit)) AS w
   JOIN subs s ON s.unit = w.unit LEFT JOIN runs r ON r.unit = w.unit AND r.level = w.level AND r.run = w.spot // 8
   LEFT JOIN over_runs o ON w.level >= w.tall AND o.level = w.level - w.tall AND o.run = CASE WHEN w.level = w.tall THEN s.place // 8 ELSE w.spot // 8 END
   WHERE r.hs IS NOT NULL OR o.hs IS NOT NULL),
 ends AS (SELECT unit, nth, max_by(h, level) AS h, max_by(proof, level) AS proof FROM way GROUP BY unit, nth)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, ends.h AS folded_root, ends.h = top.h AS verified FROM l JOIN ends ON ends.unit = l.unit AND ends.nth = l.place JOIN subs ON subs.unit = l.unit, (SELECT h FROM higher WHERE n = 1) AS top"""

SQL = {"op11_talk_repair": REPAIRS, "op13_merkle_manifest": MERKLE, "op2_exact_dedup": EXACT, "op3_odd_sketches": NEAR, "op5_previous_factors": COPIES, "op7_passage_doubling": PASSAGES, "op8_curriculum_mix": MIX, "op10_decontaminate": LEAKS}
