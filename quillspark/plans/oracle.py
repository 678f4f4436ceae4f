"""The registered queries in DuckDB's SQL, written from the operators' definitions and not from their plans."""

from __future__ import annotations

import json

from ..config import CONFIG
from ..operators.transcribe import request_for
from ..schema import EDGES, STATES

LINES = """
parts AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS p FROM documents),
split AS (SELECT document_id, CAST(unnest(range(len(p))) AS INTEGER) AS ln, unnest(p) AS text FROM parts),
lines AS (SELECT document_id, ln, CAST((length(text) % 7) * 4 AS INTEGER) AS x, CAST(ln * 30 + (length(text) % 5) * 6 AS INTEGER) AS y, CAST(length(text) * 3 AS INTEGER) AS w, 12 AS h,
          CAST(length(text) AS INTEGER) AS ink, CAST(length(replace(text, ' ', '')) AS DOUBLE) / greatest(1, length(text)) AS density, text FROM split)"""

SCORED = """
stats AS (SELECT document_id, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC) AS DOUBLE) AS mh, min(x) AS lx, greatest(1, CAST(max(w) AS DOUBLE)) AS fw FROM {src} GROUP BY document_id),
steps AS (SELECT l.*, y - lag(y + h) OVER o AS gap, abs(lag(density) OVER o - density) AS thin FROM {src} l WINDOW o AS (PARTITION BY document_id ORDER BY ln)),
scored AS (SELECT s.*, CAST(0.55 AS DOUBLE) * least(1.0, greatest(0.0, gap / (3.0 * mh))) + CAST(0.25 AS DOUBLE) * least(1.0, greatest(0.0, (x - lx) / (0.25 * fw)))
           + CAST(0.2 AS DOUBLE) * least(1.0, thin * 4.0) AS score FROM steps s JOIN stats USING (document_id)),
para AS (SELECT *, sum(CASE WHEN gap IS NULL OR score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ln) AS paragraph FROM scored)"""

BOX = "min(x) AS x, min(y) AS y, CAST(max(x + w) - min(x) AS INTEGER) AS w, CAST(max(y + h) - min(y) AS INTEGER) AS h"


def paragraphs_of(src: str) -> str:
    return SCORED.replace("{src}", src) + f""",
paragraphs AS (SELECT document_id, paragraph, 'p' || printf('%03d', CAST(paragraph AS BIGINT)) AS id, {BOX}, count(*) AS n_lines FROM para GROUP BY document_id, paragraph)"""


def questions_of(src: str, said: str) -> str:
    return f"""
qm AS (SELECT document_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY h DESC) AS mh FROM {src} GROUP BY document_id),
qc AS (SELECT l.*, {said} AS said FROM {src} l JOIN qm USING (document_id) WHERE h <= 4.0 * mh),
qw AS (SELECT document_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY w DESC) AS fw FROM qc GROUP BY document_id),
qs AS (SELECT c.*, row_number() OVER o AS pos, y - lag(y + h) OVER o AS gap, w < 0.7 * fw AS short,
       regexp_matches(said, '(?i)^\\s*(Q\\s*\\d+|QN\\s*\\d+|Question\\s*\\d*\\b)') AS pre FROM qc c JOIN qw USING (document_id) WINDOW o AS (PARTITION BY document_id ORDER BY ln)),
qt AS (SELECT *, pos = 1 OR pre OR contains(said, '?') AS hit, sum(CASE WHEN pos > 1 AND gap <= 45 AND short AND NOT pre THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ln) AS stretch FROM qs),
qh AS (SELECT *, min(ln) FILTER (hit) OVER (PARTITION BY document_id, stretch) AS opens FROM qt),
ql AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY stretch) AS question FROM qh WHERE ln >= opens),
questions AS (SELECT document_id, question, 'q' || printf('%03d', question) AS id, {BOX}, count(*) AS n_lines FROM ql GROUP BY document_id, question)"""


def answers_of(src: str) -> str:
    return f"""
top AS (SELECT document_id, arg_min(y + h, y) AS bottom FROM questions GROUP BY document_id),
capped AS (SELECT document_id, bottom, min(q.y) FILTER (q.y > bottom) AS cap FROM top JOIN questions q USING (document_id) GROUP BY document_id, bottom),
a0 AS (SELECT l.* FROM {src} l JOIN capped USING (document_id) WHERE l.y > bottom AND (cap IS NULL OR l.y < cap)),
m1 AS (SELECT document_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY density DESC) AS md FROM a0 GROUP BY document_id),
a1 AS (SELECT a0.* FROM a0 JOIN m1 USING (document_id) WHERE md <= 0 OR density >= 0.25 * md),
m2 AS (SELECT document_id, percentile_disc(0.5) WITHIN GROUP (ORDER BY x DESC) AS mx FROM a1 GROUP BY document_id),
a2 AS (SELECT a1.* FROM a1 JOIN m2 USING (document_id) WHERE NOT (x < mx - 60 AND ink < 800)),
answers AS (SELECT document_id, 'answer_001' AS id, {BOX} FROM a2 GROUP BY document_id),
inside AS (SELECT l.* FROM {src} l JOIN answers a USING (document_id) WHERE l.y BETWEEN a.y AND a.y + a.h)"""


ASKED = "asked AS (SELECT *, CASE WHEN ln % 7 = 3 THEN ' qn 12 ' || text WHEN ln % 5 = 4 THEN text || '?' ELSE text END AS s FROM lines)"
PARAGRAPHS, QUESTIONS, ANSWERS = paragraphs_of("lines"), questions_of("lines", "''"), answers_of("lines")
PROFILE = """profile AS (SELECT user_id AS document_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS y, count(*) AS row_ink, min(event_id % 1000) AS x_min, max(event_id % 1000) AS x_max FROM events GROUP BY ALL)"""
ISLES = """isles AS (SELECT *, sum(CASE WHEN y - p - 1 > 240 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY y) AS island
  FROM (SELECT *, lag(y) OVER (PARTITION BY document_id ORDER BY y) AS p FROM profile))"""
WORDS = """
chars AS (SELECT document_id, ln, CAST(unnest(range(length(text))) AS INTEGER) AS x, unnest(string_split(text, '')) AS c FROM lines),
wr AS (SELECT *, x - row_number() OVER (PARTITION BY document_id, ln ORDER BY x) AS g FROM chars WHERE c <> ' '),
ws AS (SELECT document_id, ln, min(x) AS x, CAST(count(*) AS INTEGER) AS w FROM wr GROUP BY document_id, ln, g),
words AS (SELECT document_id, ln, row_number() OVER (PARTITION BY document_id, ln ORDER BY x) AS word_no, x, w FROM ws)"""
INPARA = """
inpara AS (SELECT l.document_id, p.id AS parent_id, l.ln, p.id || '_line' || printf('%03d', row_number() OVER (PARTITION BY l.document_id, p.id ORDER BY l.y)) AS id
  FROM lines l JOIN paragraphs p ON l.document_id = p.document_id AND l.y + l.h / 2.0 BETWEEN p.y AND p.y + p.h)"""
OCR = """
ocr AS (SELECT document_id, ln, text, CAST((document_id * 37 + ln * 11) % 101 AS DOUBLE) / 100 AS confidence FROM lines),
classed AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'accepted' WHEN confidence >= 0.7 THEN 'review_recommended' ELSE 'review_required' END AS review_class FROM ocr)"""
LOG = f"""log AS (SELECT user_id AS document_id, ts, event_id, [{', '.join(f"'{s}'" for s in STATES)}][(length(event_type) + event_id % 3) % {len(STATES)} + 1] AS state FROM events)"""
DIM = f"""dim(ordinal, state, label, next_state) AS (VALUES {', '.join(f"({i}, '{s}', '{s.replace('_', ' ')}', {repr(STATES[i + 1]) if i + 1 < len(STATES) else 'NULL'})" for i, s in enumerate(STATES))})"""
ALLOWED = f"""edges(cur, nxt) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in EDGES)})"""


def _key_sql() -> str:
    mark = "\x01"
    before, after = json.dumps(request_for(mark, CONFIG.transcription), sort_keys=True, separators=(",", ":"), ensure_ascii=False).split("\\u0001")
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"sha256(encode(text) || '\\x00'::BLOB || encode({q(before)} || 'l' || printf('%03d', ln) || {q(after)}))"


KEYED = f"keyed AS (SELECT document_id, ln, 'l' || printf('%03d', ln) AS crop_id, {_key_sql()} AS cache_key FROM split)"
RANGES = """
u AS (SELECT document_id, ln, length(text) AS n, ln % 4 AS s1, 6 AS e1, length(text) - 2 + ln % 3 AS s2, length(text) + ln % 2 AS e2 FROM split),
cut AS (SELECT document_id, ln, e1 > n OR e2 > n AS clamped, list_filter([[s1, least(e1, n)], [s2, least(e2, n)]], lambda r: r[2] > r[1]) AS r FROM u)"""

INK = """
size AS (SELECT document_id, max(y + h) + 20 AS height, max(x + w) AS pw, max(y + h) AS ph FROM lines GROUP BY document_id),
cutat AS (SELECT *, 3 * CASE WHEN instr(text, ' ') > 1 THEN instr(text, ' ') - 1 ELSE length(text) END AS c FROM lines),
runs AS (SELECT document_id, y + 3 + i AS y, s, e FROM (SELECT document_id, y, x AS s, x + c AS e FROM cutat UNION ALL SELECT document_id, y, x + c + 3, x + w FROM cutat), (SELECT unnest(range(6)) AS i) WHERE e > s),
profile AS (SELECT document_id, y, sum(e - s) AS row_ink, min(s) AS x_min, max(e) - 1 AS x_max FROM runs GROUP BY document_id, y)"""
MARKS = """
marks AS (SELECT document_id, ln, ln % 4 AS k, x AS x0, x + CASE WHEN ln % 4 = 0 THEN w ELSE w // 2 END AS x1, ln * 30 + CASE WHEN ln % 4 = 0 THEN 0 ELSE 1 - document_id % 2 * 6 END AS y0, ln * 30 + 25 AS y1 FROM lines WHERE ln % 4 < 2 AND w > 3),
area AS (SELECT *, (x1 - x0) * (y1 - y0) AS n FROM marks),
pairs AS (SELECT a.document_id, a.ln AS la, b.ln AS lb, 8 - 2 * CAST(a.x0 = b.x0 AS INTEGER) - 2 * CAST(a.x1 = b.x1 AS INTEGER) AS corners, least(a.x0, b.x0) AS x0, greatest(a.x1, b.x1) AS x1, a.y0, b.y1, a.n + b.n AS n FROM area a JOIN area b ON a.document_id = b.document_id AND a.k = 0 AND b.ln = a.ln + 1 AND b.y0 <= a.y1 AND b.x0 <= a.x1 AND a.x0 <= b.x1),
found AS (SELECT document_id, x0, x1, y0, y1, n, corners FROM pairs UNION ALL
  SELECT document_id, x0, x1, y0, y1, n, 4 AS corners FROM area m WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.document_id = m.document_id AND (p.la = m.ln OR p.lb = m.ln)))"""

PATHS = r"""paths AS (SELECT path, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix FROM (SELECT regexp_replace(url, '[?#].*$', '') AS path FROM pages))"""


def q(*ctes: str) -> str:
    *parts, last = ctes
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + last


ORACLE: dict[str, str] = {
    "page_paragraphs": q(LINES, PARAGRAPHS, "SELECT document_id, id, paragraph, x, y, w, h, n_lines FROM paragraphs"),
    "paragraph_scores": q(LINES, PARAGRAPHS, "SELECT document_id, ln, gap, round(score, 9) AS score, paragraph FROM para"),
    "question_groups_spatial": q(LINES, QUESTIONS, "SELECT document_id, id, x, y, w, h, n_lines FROM questions"),
    "question_groups_text": q(LINES, ASKED, questions_of("asked", "s"), "SELECT document_id, id, x, y, w, h, n_lines FROM questions"),
    "answer_region": q(LINES, ASKED, questions_of("asked", "s"), answers_of("asked"), "SELECT document_id, id, x, y, w, h FROM answers"),
    "answer_lines": q(LINES, QUESTIONS, ANSWERS, "SELECT document_id, ln, y FROM inside"),
    "row_islands": q(PROFILE, ISLES, "SELECT document_id, island, min(y) AS first, max(y) AS last, min(x_min) AS x_min, max(x_max) AS x_max, sum(row_ink) AS ink_area FROM isles GROUP BY document_id, island"),
    "row_islands_tail": q(PROFILE, ISLES, "edge AS (SELECT document_id, max(y) + document_id % 3 * 200 + 1 AS e FROM profile GROUP BY document_id)",
        "SELECT document_id, min(y) AS first, CASE WHEN max(e) - max(y) <= 240 THEN max(e) - 1 ELSE max(y) END AS last, sum(row_ink) AS ink_area FROM isles JOIN edge USING (document_id) GROUP BY document_id, island HAVING sum(row_ink) >= 2"),
    "band_merge": q(PROFILE, "b AS (SELECT document_id, y AS s, y + row_ink * 30 AS e FROM profile)",
        "m AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p - 1 > 240 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY s) AS band FROM (SELECT *, lag(e) OVER (PARTITION BY document_id ORDER BY s) AS p FROM b))",
        'SELECT document_id, band, min(s) AS start, arg_max(e, s) AS "end" FROM m GROUP BY document_id, band'),
    "word_islands": q(LINES, WORDS, "SELECT document_id, ln, word_no, x, w FROM words"),
    "line_to_paragraph": q(LINES, PARAGRAPHS, INPARA, "SELECT document_id, parent_id, id, ln FROM inpara"),
    "line_to_question": q(LINES, QUESTIONS, INPARA.replace("paragraphs", "questions"), "SELECT document_id, parent_id, id, ln FROM inpara"),
    "enclosing_band": q(LINES, INK, "bands AS (SELECT document_id, y - 5 AS s, y - 3 AS e FROM lines WHERE ln % 3 = 0)",
        "near AS (SELECT l.*, (SELECT max(e) FROM bands b WHERE b.document_id = l.document_id AND e < l.y + l.h / 2.0) AS up, (SELECT min(s) FROM bands b WHERE b.document_id = l.document_id AND s > l.y + l.h / 2.0) AS lo FROM lines l)",
        "grown AS (SELECT n.document_id, ln, x, w, greatest(0, least(coalesce(up + 1, y), y)) AS y0, least(ph, greatest(coalesce(lo, y + h), y + h)) AS y1 FROM near n JOIN size USING (document_id))",
        "SELECT document_id, ln, x, y0 AS y, w, y1 - y0 AS h FROM grown"),
    "crop_hierarchy": q(LINES, PARAGRAPHS, INPARA, WORDS, """SELECT document_id, 'paragraph' AS type, id, NULL AS parent_id, NULL AS parent_type, NULL AS grandparent_id, NULL AS grandparent_type FROM paragraphs
        UNION ALL SELECT document_id, 'line', id, parent_id, 'paragraph', NULL, NULL FROM inpara
        UNION ALL SELECT document_id, 'word', i.id || '_word' || printf('%02d', word_no), i.id, 'line', parent_id, 'paragraph' FROM words JOIN inpara i USING (document_id, ln)"""),
    "crop_paths": q(LINES, "SELECT document_id, 'l' || printf('%03d', ln) AS id, CASE WHEN ln % 4 <> 1 THEN 'crops/lines/page_001/l' || printf('%03d', ln) || '.png' END AS path FROM lines"),
    "crop_created": q(LINES, "SELECT document_id, 'l' || printf('%03d', ln) AS id, CASE WHEN ln % 3 = 0 THEN 1700000000 + ln ELSE 1800000000 END AS created FROM lines"),
    "new_crops": q(LINES, "SELECT document_id, 'line' AS type, 'l' || printf('%03d', ln) AS id FROM lines WHERE ln % 3 <> 0"),
    "clamped_crops": q(LINES, INK, "b AS (SELECT document_id, ln, greatest(0, x - 8) AS x, greatest(0, y - 10) AS y, least(pw, x + w + 8) AS x1, least(ph, y + h + 10) AS y1 FROM lines JOIN size USING (document_id))",
        "SELECT document_id, ln, x, y, greatest(0, x1 - x) AS w, greatest(0, y1 - y) AS h FROM b"),
    "cache_keys": q(LINES, KEYED, "SELECT document_id, crop_id, cache_key FROM keyed"),
    "cache_hits": q(LINES, KEYED, "SELECT document_id, ln, cache_key FROM keyed WHERE cache_key IN (SELECT cache_key FROM keyed WHERE ln % 3 = 0)"),
    "cache_misses": q(LINES, KEYED, "SELECT document_id, ln, cache_key FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM keyed WHERE ln % 3 = 0)"),
    "call_cap": q(LINES, "SELECT document_id, ln, row_number() OVER (PARTITION BY document_id ORDER BY ln) AS call_no, row_number() OVER (PARTITION BY document_id ORDER BY ln) > 5 AS capped FROM split WHERE ln % 3 <> 0"),
    "uncertainty_repair": q(LINES, RANGES, "SELECT document_id, ln, clamped, len(r) AS n_ranges, array_to_string(list_transform(r, lambda i: i[1]::VARCHAR || '-' || i[2]::VARCHAR), ',') AS ranges FROM cut"),
    "validate_response": q(LINES, """k AS (SELECT document_id, ln, ln % 10 AS k, length(text) AS n FROM split)""", """
        SELECT document_id, ln, CASE WHEN k IN (0, 1, 4, 6, 8, 9) THEN n ELSE 0 END AS n_text, CAST([0.97, 0.5, 0, 0, 1, 0, 0.8, 0, 1, 1][k + 1] AS DOUBLE) AS confidence,
          CASE WHEN k = 1 AND n > 1 OR k = 4 AND n > 2 THEN 1 ELSE 0 END AS n_ranges,
          ['valid', 'valid', 'invalid', 'invalid', 'valid', 'invalid', 'valid', 'unavailable', 'valid', 'valid'][k + 1] AS validation_state,
          CASE WHEN k IN (0, 6, 8, 9) OR k = 1 AND n <= 1 OR k = 4 AND n <= 2 THEN 'pending' ELSE 'required' END AS review_state,
          [NULL, CASE WHEN n < 5 THEN 'uncertainty_range_clamped' ELSE 'model_uncertainty' END, 'malformed_response:''confidence''', 'malformed_response:invalid text or confidence', 'uncertainty_range_clamped', 'malformed_response:uncertainty range outside literal text', 'uncertainty_range_clamped', 'provider_unavailable', NULL, NULL][k + 1] AS review_reason FROM k"""),
    "confidence_class": q(LINES, OCR, "SELECT document_id, ln, confidence, review_class FROM classed"),
    "review_flags": q(LINES, OCR, "SELECT document_id, review_class, count(*) AS n_lines, string_agg(ln::VARCHAR, ',' ORDER BY ln) AS lines FROM classed GROUP BY document_id, review_class"),
    "ocr_line_join": q(LINES, OCR, "SELECT l.document_id, l.ln, CASE WHEN c.ln IS NULL THEN '' WHEN l.ln % 6 = 0 THEN c.text || '!' ELSE c.text END AS ocr_text, c.confidence, c.review_class FROM lines l LEFT JOIN (SELECT * FROM classed WHERE ln % 4 <> 1) c USING (document_id, ln)"),
    "question_orphans": q(LINES, QUESTIONS, "SELECT document_id, ln FROM ql WHERE ln % 4 = 0"),
    "paragraph_text": q(LINES, PARAGRAPHS, "SELECT document_id, paragraph, coalesce(string_agg(trim(text), ' ' ORDER BY ln) FILTER (trim(text) <> ''), '') AS text FROM para GROUP BY document_id, paragraph"),
    "answer_text": q(LINES, QUESTIONS, ANSWERS, SCORED.replace("{src}", "inside"), "pt AS (SELECT document_id, paragraph, string_agg(trim(text), ' ' ORDER BY ln) AS t FROM para GROUP BY document_id, paragraph)",
        "SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY paragraph) AS text FROM pt GROUP BY document_id"),
    "question_text": q(LINES, QUESTIONS, "SELECT document_id, string_agg(text, ' ' ORDER BY ln) AS text FROM ql GROUP BY document_id"),
    "review_export": q(LINES, QUESTIONS, ANSWERS, SCORED.replace("{src}", "inside"), "pt AS (SELECT document_id, paragraph, string_agg(trim(text), ' ' ORDER BY ln) AS t FROM para GROUP BY document_id, paragraph)",
        "resp AS (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY paragraph) AS response FROM pt GROUP BY document_id)",
        "ques AS (SELECT document_id, string_agg(text, ' ' ORDER BY ln) AS question FROM ql GROUP BY document_id)",
        "SELECT d.doc_id AS document_id, 'doc_' || printf('%03d', d.doc_id) || '.png' AS filename, coalesce(question, '') AS question, coalesce(response, '') AS response FROM documents d LEFT JOIN ques q ON q.document_id = d.doc_id LEFT JOIN resp r ON r.document_id = d.doc_id WHERE q.document_id IS NOT NULL OR r.document_id IS NOT NULL"),
    "overlay_layers": q(LINES, QUESTIONS, ANSWERS, "SELECT document_id, 'question' AS layer, id, x, y, w, h FROM questions UNION ALL SELECT document_id, 'answer', id, x, y, w, h FROM answers UNION ALL SELECT document_id, 'line', 'l' || printf('%03d', ln), x, y, w, h FROM lines"),
    "nested_documents": q(LINES, PARAGRAPHS, "SELECT document_id, 1 AS n_pages, CAST(max(paragraph) AS INTEGER) AS n_paragraphs, CAST(count(*) AS INTEGER) AS n_lines, arg_min(text, ln) AS first_text FROM para GROUP BY document_id"),
    "state_violations": q(LOG, ALLOWED, "steps AS (SELECT document_id, event_id, lag(state) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS cur, state AS nxt FROM log)",
        "SELECT document_id, event_id, cur, nxt, coalesce((SELECT string_agg(e.nxt, ',' ORDER BY e.nxt) FROM edges e WHERE e.cur = s.cur), '') AS allowed FROM steps s WHERE cur IS NOT NULL AND (cur, nxt) NOT IN (SELECT (cur, nxt) FROM edges)"),
    "current_state": q(LOG, DIM, "last AS (SELECT document_id, state, count(*) OVER (PARTITION BY document_id) AS n_steps FROM log QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1)",
        "SELECT document_id, state, ordinal, label, next_state, n_steps FROM last JOIN dim USING (state)"),
    "stage_reached": q(LOG, DIM, "last AS (SELECT document_id, state FROM log QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1)",
        "SELECT l.document_id, s.ordinal, s.label, s.ordinal <= n.ordinal AS reached FROM last l JOIN dim n USING (state), dim s"),
    "states_seen": q(LOG, DIM, "SELECT ordinal, state, label, next_state, (SELECT count(*) FROM log WHERE log.state = dim.state) AS n FROM dim"),
    "ocr_progress": q(LINES, "SELECT document_id, ln, row_number() OVER (PARTITION BY document_id ORDER BY ln) AS completed, count(*) OVER (PARTITION BY document_id) AS total FROM lines"),
    "format_scan": q(PATHS, "kinds AS (SELECT path, suffix, CASE WHEN suffix = '.pdf' THEN 'pdf' WHEN suffix IN ('.png', '.jpg', '.jpeg', '.webp') THEN 'image' END AS kind FROM paths)",
        "SELECT path, kind, CASE WHEN kind IS NULL THEN 'unsupported format ' || CASE WHEN suffix = '' THEN '(no extension)' ELSE suffix END END AS reason FROM kinds"),
    "redacted_log": "SELECT doc_id, CASE WHEN length(text) > 300 THEN '<' || length(text) || ' chars omitted>' ELSE text END AS logged FROM documents",
    "stripped_text": q(LINES, "SELECT document_id, ln, trim(text) AS text FROM split"),
    "markup_counts": q(LINES, "SELECT document_id, sum(k + (len(text) - len(replace(text, '<strikethrough>', ''))) // 15) AS strikes, sum(k + (len(text) - len(replace(text, '<caret>', ''))) // 7) AS carets, sum(k + (len(text) - len(replace(text, '[illegible]', ''))) // 11) AS illegible FROM (SELECT *, CASE WHEN ln % 3 = 0 THEN 1 ELSE 0 END AS k FROM split) GROUP BY document_id"),
    "new_document_ids": """WITH new AS (SELECT doc_id, 'scans/' || source || '/' || doc_id || '.png' AS path FROM documents WHERE doc_id % 10 = 3)
        SELECT doc_id, path, 'doc_' || printf('%03d', (SELECT max(doc_id) + 5 FROM documents WHERE doc_id % 10 <> 3) + row_number() OVER (ORDER BY substr(md5(path), 1, 3), path)) AS document_id FROM new""",
    "state_advance": q(LOG, ALLOWED, DIM, "now AS (SELECT document_id, state AS now FROM log WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, event_id DESC) = 1)",
        "k AS (SELECT user_id AS document_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS k FROM events WHERE event_id % 2 = 1)",
        "asked AS (SELECT k.*, now, s.state FROM k JOIN now USING (document_id) JOIN dim n ON n.state = now JOIN dim s ON s.ordinal = (n.ordinal + k) % 11)",
        "steps AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY document_id ORDER BY ts, event_id), now) AS cur FROM asked)",
        "fits AS (SELECT s.*, EXISTS (SELECT 1 FROM edges e WHERE e.cur = s.cur AND e.nxt = s.state) AS fit FROM steps s)",
        "SELECT document_id, event_id, state, cur, coalesce((SELECT string_agg(e.nxt, ',' ORDER BY e.nxt) FROM edges e WHERE e.cur = f.cur), '') AS allowed, bool_and(fit) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS accepted FROM fits f"),
    "json_round_trip": q(LINES, OCR, "SELECT document_id, ln, nullif(text, '') AS text, CASE WHEN confidence > 0.05 THEN confidence END AS confidence, CASE WHEN ln % 5 = 0 THEN 1 ELSE 0 END AS n_ranges, CASE WHEN ln % 5 = 0 THEN 3 END AS first_end FROM ocr"),
    "line_density": q(LINES, INK, "part AS (SELECT l.document_id, l.ln, l.w * l.h AS area, least(e, x + w) - greatest(s, x) AS n FROM lines l JOIN runs r ON r.document_id = l.document_id AND r.y >= l.y AND r.y < l.y + l.h)",
        "SELECT document_id, ln, round(CAST(sum(n) AS DOUBLE) / area, 9) AS density FROM part WHERE n > 0 GROUP BY document_id, ln, area"),
    "ink_profile": q(LINES, INK, "SELECT document_id, 1 AS page_number, height, y, row_ink, x_min, x_max FROM profile JOIN size USING (document_id)"),
    "drawn_lines": q(LINES, INK, "isles AS (SELECT *, sum(CASE WHEN y - p - 1 > 3 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY y) AS line_no FROM (SELECT *, lag(y) OVER (PARTITION BY document_id ORDER BY y) AS p FROM profile))",
        "SELECT document_id, line_no, min(x_min) AS x, min(y) AS y, max(x_max) - min(x_min) + 1 AS w, max(y) - min(y) + 1 AS h, sum(row_ink) AS ink_area FROM isles GROUP BY document_id, line_no"),
    "ruled_bands": q(LINES, INK, "rule AS (SELECT DISTINCT document_id, y + i AS y FROM runs, (SELECT unnest([-1, 0, 1]) AS i) WHERE e - s >= 60 AND y + i >= 0)",
        "b AS (SELECT *, sum(CASE WHEN y - p - 1 > 8 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY y) AS band FROM (SELECT *, lag(y) OVER (PARTITION BY document_id ORDER BY y) AS p FROM rule))",
        'SELECT document_id, band, min(y) AS start, max(y) AS "end" FROM b GROUP BY document_id, band'),
    "unruled_ink": q(LINES, INK, "cuts AS (SELECT document_id, y + unnest([-1, 0, 1]) AS y, s, e FROM runs WHERE e - s >= 60)", "px AS (SELECT document_id, y, unnest(range(s, e)) AS x FROM runs WHERE e - s < 60)",
        "SELECT document_id, y, count(*) AS row_ink, min(x) AS x_min, max(x) AS x_max FROM px p WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.document_id = p.document_id AND c.y = p.y AND p.x >= c.s AND p.x < c.e) GROUP BY document_id, y"),
    "highlight_boxes": q(LINES, MARKS, "SELECT document_id, 1 AS page_number, 'highlight_' || printf('%03d', row_number() OVER (PARTITION BY document_id ORDER BY y0, x0)) AS id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, n AS area FROM found WHERE n >= 400"),
    "margin_lines": q(LINES, INK, """bars AS (SELECT document_id, ln * 30 + i AS y, pw + 10 AS s, pw + 12 + (ln // 3) % 3 AS e FROM lines JOIN size USING (document_id), (SELECT unnest(range(30)) AS i) WHERE ln % 6 < 5
  UNION ALL SELECT document_id, ln * 30 + i, pw + 30, pw + 33 FROM lines JOIN size USING (document_id), (SELECT unnest(range(30)) AS i) WHERE ln % 2 = 0)""",
        "px AS (SELECT document_id, y, unnest(range(s, e)) AS x FROM (SELECT document_id, y, s, e FROM runs UNION ALL SELECT document_id, y, s, e FROM bars))",
        "isle AS (SELECT *, y - row_number() OVER (PARTITION BY document_id, x ORDER BY y) AS g FROM px)",
        'tall AS (SELECT document_id, x, min(y) AS "first", max(y) AS "last" FROM isle GROUP BY document_id, x, g HAVING count(*) >= 60)',
        'SELECT document_id, "first", "last", count(*) AS n_columns, min(x) AS x_min, max(x) AS x_max FROM tall GROUP BY ALL'),
    "line_columns": q(LINES, INK, "part AS (SELECT l.document_id, l.ln, greatest(s, x) - x AS a, least(e, x + w) - x AS b, count(*) AS c FROM lines l JOIN runs r ON r.document_id = l.document_id AND r.y >= l.y AND r.y < l.y + l.h WHERE least(e, x + w) > greatest(s, x) GROUP BY ALL)",
        "px AS (SELECT document_id, ln, unnest(range(a, b)) AS p, c FROM part)", "col AS (SELECT document_id, ln, p, sum(c) AS n FROM px GROUP BY ALL)",
        "isle AS (SELECT *, p - row_number() OVER (PARTITION BY document_id, ln, n ORDER BY p) AS g FROM col)",
        "SELECT document_id, ln, min(p) AS x, max(p) AS x_end, n AS col_ink FROM isle GROUP BY document_id, ln, n, g"),
    "document_trees": q(LINES, """SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'APPROVED' ELSE 'UPLOADED' END AS state, 1 AS n_pages, 0 AS n_reviews_of_all, '' AS final_answer,
  CASE WHEN document_id % 3 = 0 THEN '' END AS question_text, CASE WHEN document_id % 3 = 0 THEN 0 END AS question_lines, CASE WHEN document_id % 2 = 0 THEN 'highlight' END AS mark_type, 0 AS n_crops,
  count(*) AS n_ocr, count(*) FILTER (ln % 4 <> 1) AS n_valid, count(*) AS n_pending, count(*) FILTER (ln % 5 = 0) AS n_unsure, count(*) FILTER (ln % 10 = 5) AS n_without_reason,
  count(*) FILTER (ln % 7 = 0) AS n_reviews, count(*) FILTER (ln % 7 = 0) AS n_plain_reviews, coalesce(sum(ln) FILTER (ln % 7 = 0), 0) AS latency,
  count(*) FILTER (ln % 3 = 0 OR text = '') AS n_without_text, TRUE AS same FROM lines GROUP BY document_id"""),
    "cleaned_marks": q(LINES, """blot AS (SELECT document_id, ln * 8 AS y0, 3 + length(text) % 3 AS h, length(text) % 11 AS a, length(text) % 11 + 3 + length(text) % 6 AS b, length(text) % 11 + 4 + length(text) % 6 + length(text) % 5 AS c FROM lines),
row AS (SELECT document_id, a, b, c, y0 + unnest(range(h)) AS y FROM blot),
px AS (SELECT document_id, y, unnest(range(a, b)) AS x FROM row UNION SELECT document_id, y, unnest(range(c, c + 4)) FROM row),
o AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)),
grown AS (SELECT DISTINCT document_id, y + i AS y, x + j AS x FROM px, o WHERE y + i >= 0 AND x + j >= 0),
closed AS (SELECT document_id, y, x FROM (SELECT document_id, y - i AS y, x - j AS x FROM grown, o WHERE y - i >= 0 AND x - j >= 0) GROUP BY document_id, y, x HAVING count(*) = (3 + least(2, y)) * (3 + least(2, x))),
left_ AS (SELECT document_id, y, x FROM (SELECT document_id, y - i AS y, x - j AS x FROM closed, o WHERE y - i >= 0 AND x - j >= 0) GROUP BY document_id, y, x HAVING count(*) = (3 + least(2, y)) * (3 + least(2, x))),
opened AS (SELECT DISTINCT document_id, y + i AS y, x + j AS x FROM left_, o WHERE y + i >= 0 AND x + j >= 0),
isle AS (SELECT *, x - row_number() OVER (PARTITION BY document_id, y ORDER BY x) AS g FROM opened)""",
        "SELECT document_id, y, min(x) AS x_start, max(x) + 1 AS x_end FROM isle GROUP BY document_id, y, g"),
    "highlight_outlines": q(LINES, MARKS, "SELECT document_id, 'highlight_' || printf('%03d', row_number() OVER (PARTITION BY document_id ORDER BY y0, x0)) AS id, corners AS n_corners, n AS area FROM found WHERE n >= 400"),
}
