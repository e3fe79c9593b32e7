"""DuckDB SQL for the queries of tidemark.plans.product, over the same tables."""

from __future__ import annotations

from . import texts_sql
from .catalogue_sql import _BRIEF, _C, _CLIP, _DIST, _DROP, _E, _L, _ROLL, _V

_REL = _E.replace("epoch_us(ts) // 1000", "epoch_us(ts) // 1000 - 1704067200000")
_CHANNELS = _C.removeprefix(_E + ", ")

# states of one event type: each ends where the next begins, the last one a step (the time between the first two frames) after its last frame
_STATES = """s0 AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w AS b, lead(ms) OVER w - ms AS gap, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY ms, event_id)),
s1 AS (SELECT *, sum(b::INT) OVER (PARTITION BY recording_id ORDER BY ms, event_id) AS run, min(CASE WHEN i = 1 THEN gap END) OVER (PARTITION BY recording_id) AS step FROM s0),
s2 AS (SELECT recording_id, run, event_type AS state_id, min(ms) / 1000 AS "start", max(ms) / 1000 + coalesce(any_value(step) / 1000, 0.5) AS stop, count(*)::INT AS sample_count FROM s1 GROUP BY 1, 2, 3),
s AS (SELECT s2.recording_id, (row_number() OVER w - 1)::INT AS pos, state_id, "start", coalesce(lead("start") OVER w, stop) AS "end", sample_count FROM s2 WHERE recording_id::BIGINT % 7 <> 0 WINDOW w AS (PARTITION BY recording_id ORDER BY run))"""

_RECORDINGS = """rec AS (SELECT recording_id, max(ms) / 1000 AS duration, recording_id::BIGINT % 7 <> 0 AS v, recording_id::BIGINT % 11 <> 0 AS a, recording_id::BIGINT % 3 <> 0 AS wide FROM e GROUP BY 1)"""

_FREEZE = """fz AS (SELECT recording_id, ms / 1000 AS "start", ms / 1000 + value / 10 AS "end", value / 10 AS d FROM e JOIN rec USING (recording_id) WHERE event_type = 'signup' AND v AND value / 10 >= 2),
fz2 AS (SELECT fz.*, a AND EXISTS (FROM lw) AS heard, EXISTS (FROM lw WHERE lw.recording_id = fz.recording_id AND rec.a AND lw."end" > fz."start" AND lw."start" < fz."end" AND rms_db > 60) AS active FROM fz JOIN rec USING (recording_id))"""

_PROGRESS = """k AS (SELECT recording_id, a, unnest(range(0, floor(duration / 43200)::BIGINT + 1)) AS bucket FROM rec WHERE v AND duration > 0),
loud AS (SELECT DISTINCT recording_id, floor("start" / 43200)::BIGINT AS bucket FROM lw WHERE rms_db > 60),
moved AS (SELECT DISTINCT recording_id, floor(ms / 1000 / 43200)::BIGINT AS bucket FROM s0 WHERE b AND i > 1),
sb AS (SELECT recording_id, state_id, unnest(range(floor("start" / 43200)::BIGINT, ceil("end" / 43200)::BIGINT)) AS bucket FROM s WHERE "start" < "end"),
changed AS (SELECT recording_id, bucket FROM sb GROUP BY 1, 2 HAVING count(DISTINCT state_id) > 1),
k1 AS (SELECT * FROM k WHERE NOT a OR NOT EXISTS (FROM loud WHERE loud.recording_id = k.recording_id AND loud.bucket = k.bucket)),
k2 AS (SELECT * FROM k1 ANTI JOIN moved USING (recording_id, bucket)), k3 AS (SELECT * FROM k2 ANTI JOIN changed USING (recording_id, bucket)),
k4 AS (SELECT *, bucket - row_number() OVER (PARTITION BY recording_id ORDER BY bucket) AS g FROM k3),
pr AS (SELECT recording_id, a, min(bucket) * 43200.0::DOUBLE AS "start", (max(bucket) + 1) * 43200.0::DOUBLE AS "end" FROM k4 GROUP BY recording_id, a, g HAVING count(*) >= 2)"""

_CHANNEL_RUNS = """cl AS (SELECT recording_id, idx, CASE WHEN count(*) < 2 THEN NULL WHEN max(level) > 40 AND min(level) <= 10 THEN 'missing' WHEN max(level) > 40 AND max(level) - min(level) >= 12 THEN 'imbalance' END AS label FROM c GROUP BY 1, 2),
cr0 AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS i FROM cl),
cr1 AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id, label ORDER BY idx) AS g FROM cr0),
cr AS (SELECT recording_id, label, min(idx) * 86400.0::DOUBLE AS "start", max(idx) * 86400.0::DOUBLE + 86400 AS "end" FROM cr1 WHERE label IS NOT NULL GROUP BY recording_id, label, g HAVING max(idx) - min(idx) >= 1)"""

_PEAKS = """p0 AS (SELECT *, ms / 1000 AS time, lag(ms / 1000) OVER w AS pt, lag(value) OVER w AS pv FROM e WHERE value >= 20 WINDOW w AS (PARTITION BY recording_id ORDER BY ms)),
p1 AS (SELECT *, sum(CASE WHEN time - pt > 10800 OR abs(value - pv) > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY ms) AS run FROM p0),
pk AS (SELECT recording_id, min(time) AS "start", max(time) + 7200 AS "end", max(value) AS top, avg(value) AS frequency FROM p1 GROUP BY recording_id, run HAVING max(time) + 7200 - min(time) >= 10800)"""

_STABLE = """sg AS (SELECT recording_id, sum(CASE WHEN "end" - "start" >= 2 THEN "end" - "start" ELSE 0 END) / nullif(sum("end" - "start"), 0) AS stability, count(*) AS n FROM s GROUP BY 1)"""
_GATED = """gated AS (SELECT s.* FROM s JOIN rec USING (recording_id) JOIN sg USING (recording_id) WHERE wide AND NOT coalesce(stability < 0.35, false))"""
_PATTERNS = f"{_BRIEF}, {_ROLL}".replace("FROM s WINDOW", "FROM gated WINDOW").replace("FROM s\n", "FROM gated\n").replace("FROM s WHERE", "FROM gated WHERE")
_PATTERNS = _PATTERNS.replace('CASE WHEN s3 = s1 THEN b3 ELSE e2 END AS "end"', 'CASE WHEN s3 = s1 THEN b3 ELSE e2 END AS "end", d0, d1, d2, d3').replace('lead("start", 3) OVER w AS b3', 'lead("start", 3) OVER w AS b3, "end" - "start" AS d0, ' + ", ".join(f'lead("end", {k}) OVER w - lead("start", {k}) OVER w AS d{k}' for k in (1, 2, 3)))

_ALL = f"""WITH {_L.replace(_E, _REL)}, {_CHANNELS}, {_RECORDINGS}, {_STATES}, {_FREEZE}, {_PROGRESS}, {_CHANNEL_RUNS}, {_PEAKS}, {_STABLE}, {_GATED}, {_PATTERNS}, {_CLIP}, {_DROP},
heard AS (SELECT recording_id FROM rec WHERE a), seen AS (SELECT recording_id FROM rec WHERE v),
ev AS (
  SELECT recording_id, ms / 1000 AS "start", ms / 1000 + value / 100 AS "end", 'blackout' AS type, CASE WHEN value / 100 >= 2 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' ELSE 'low' END AS severity, 'high' AS confidence, 'blackout' AS detector
  FROM e SEMI JOIN seen USING (recording_id) WHERE event_type = 'error' AND value / 100 >= 0.1
  UNION ALL SELECT recording_id, "start", "end", 'freeze', CASE WHEN heard AND active THEN 'low' WHEN d >= 6 THEN 'high' ELSE 'medium' END, CASE WHEN NOT heard THEN 'medium' WHEN active THEN 'low' WHEN d >= 6 THEN 'high' ELSE 'medium' END, 'freeze' FROM fz2
  UNION ALL SELECT recording_id, "start", "end", 'clipping', CASE WHEN "end" - "start" >= 64800 THEN 'high' ELSE 'medium' END, 'high', 'clipping' FROM clip SEMI JOIN heard USING (recording_id)
  UNION ALL SELECT recording_id, "start", "end", 'channel_' || label, CASE WHEN label = 'imbalance' THEN 'low' WHEN "end" - "start" >= 432000 THEN 'high' ELSE 'medium' END, CASE WHEN label = 'missing' THEN 'medium' ELSE 'low' END, 'channel_imbalance' FROM cr SEMI JOIN heard USING (recording_id)
  UNION ALL SELECT recording_id, "start", "end", 'progression_interruption', CASE WHEN "end" - "start" >= 259200 THEN 'high' ELSE 'medium' END, CASE WHEN a THEN 'medium' ELSE 'low' END, 'progression_interruption' FROM pr
  UNION ALL SELECT recording_id, "start", "end", 'possible_audio_dropout', CASE WHEN "end" - "start" >= 43200 THEN 'high' ELSE 'medium' END, 'medium', 'audio_dropout' FROM dropout SEMI JOIN heard USING (recording_id)
  UNION ALL SELECT recording_id, "start", "end", 'slide_rollback_pattern', CASE WHEN d1 < 20000 THEN 'medium' ELSE 'low' END, CASE WHEN d1 < 20000 AND confirmed_repeat THEN 'medium' ELSE 'low' END, 'slide_rollback_pattern' FROM roll
  UNION ALL SELECT recording_id, "start", "end", 'brief_unexpected_slide', 'medium', 'low', 'brief_unexpected_slide' FROM brief
  UNION ALL SELECT recording_id, "start", "end", 'possible_feedback_howling', 'medium', CASE WHEN top >= 100 THEN 'medium' ELSE 'low' END, 'feedback_howling_experimental' FROM pk SEMI JOIN heard USING (recording_id)
), evc AS (SELECT *, CASE WHEN type IN ('blackout', 'freeze') THEN 'video' WHEN type LIKE '%slide%' THEN 'presentation' WHEN type LIKE 'progress%' THEN 'progress' ELSE 'audio' END AS category FROM ev)"""


# the facts that findings state; states are numbered by their first time
_NUMBERED = """nr AS (SELECT recording_id, state_id, row_number() OVER (PARTITION BY recording_id ORDER BY min(pos)) - 1 AS id FROM s GROUP BY 1, 2),
cv AS (SELECT cr.recording_id, label, "start", "end", string_agg('ch' || k || ': ' || printf('%.1f', level) || ' dBFS', ', ' ORDER BY k) AS levels
  FROM cr JOIN (SELECT *, coalesce(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type), 0) AS k FROM c) c ON c.recording_id = cr.recording_id AND c.idx = (cr."end" - 86400) // 86400 GROUP BY ALL),
rv AS (SELECT roll.*, a.id AS n0, b.id AS n1 FROM roll JOIN nr a ON a.recording_id = roll.recording_id AND a.state_id = roll.state_id JOIN nr b ON b.recording_id = roll.recording_id AND b.state_id = other_state),
bv AS (SELECT brief.*, x.id AS n, y.id AS before, z.id AS behind FROM brief JOIN nr x USING (recording_id, state_id)
  JOIN nr y ON y.recording_id = brief.recording_id AND y.state_id = previous_state JOIN nr z ON z.recording_id = brief.recording_id AND z.state_id = next_state)"""
_SPAN = '"end" - "start"'


def _typed(kind: str, relation: str, columns: str = "*") -> str:
    return f"(SELECT {columns}, {kind} AS type FROM {relation})"


_BLACK = """e SEMI JOIN seen USING (recording_id) WHERE event_type = 'error' AND value / 100 >= 0.1"""
_FINDINGS = texts_sql.findings([
    (_typed("'blackout'", _BLACK, 'recording_id, ms / 1000 AS "start", ms / 1000 + value / 100 AS "end", value / 100 AS d'), "'blackout'", {"duration": "d"}),
    (_typed("'freeze'", "fz2"), "CASE WHEN NOT heard THEN 'freeze_alone' WHEN active THEN 'freeze_active' ELSE 'freeze_quiet' END", {"duration": "d"}),
    (_typed("'clipping'", "clip SEMI JOIN heard USING (recording_id)"), "'clipping'", {"duration": "duration", "peak": "max_peak_db", "flat": "max_flat_factor"}),
    (_typed("'channel_' || label", "cv SEMI JOIN heard USING (recording_id)"), "'channel_' || label", {"duration": _SPAN, "levels": "levels"}),
    (_typed("'progression_interruption'", "pr"), "CASE WHEN a THEN 'progress_audio' ELSE 'progress_alone' END", {"duration": _SPAN}),
    (_typed("'possible_audio_dropout'", "dropout SEMI JOIN heard USING (recording_id)"), "'dropout'", {"duration": "duration", "level": "first_level", "context": "43200"}),
    (_typed("'slide_rollback_pattern'", "rv"), "CASE WHEN d1 < 20000 THEN CASE WHEN confirmed_repeat THEN 'rollback_confirmed' ELSE 'rollback_brief' END WHEN confirmed_repeat THEN 'rollback_long_repeat' ELSE 'rollback_long' END", {"s0": "n0", "s1": "n1", "d0": "d0", "d1": "d1", "d2": "d2", "d3": "d3"}),
    (_typed("'brief_unexpected_slide'", "bv"), "'brief'", {"duration": _SPAN, "state": "n", "previous": "before", "next": "behind"}),
    (_typed("'possible_feedback_howling'", "pk SEMI JOIN heard USING (recording_id)"), "'feedback'", {"duration": _SPAN, "frequency": "frequency", "concentration": "top"}),
])
_SAID = f"""{_NUMBERED}, fnd AS ({_FINDINGS}), snt(lang, variant, said, meant) AS (VALUES {texts_sql.rows(texts_sql.SENTENCES)}),
said AS (SELECT recording_id, lang, type, "start", "end", list_transform(said, lambda t: {texts_sql.filled()}) AS observations, meant AS interpretation FROM fnd JOIN snt USING (variant)),
told AS (SELECT said.*, severity, confidence, category, detector, list_position(['blackout', 'freeze', 'clipping', 'channel_imbalance', 'progression_interruption', 'audio_dropout', 'slide_rollback_pattern', 'brief_unexpected_slide', 'feedback_howling_experimental'], detector) AS ord
  FROM said JOIN evc USING (recording_id, type, "start", "end"))"""


def _markdown(lang: str) -> str:
    """SQL of whole Markdown reports in a language."""
    p = {k: texts_sql.literal(v)[1:-1] for k, v in texts_sql.PARTS[lang].items()}
    span = f"{texts_sql.clock('_start')} || ' - ' || {texts_sql.clock('_end')}"
    length = "printf('%.2f', _end - _start) || 's'"
    return f"""SELECT rec.recording_id, '{lang}' AS lang, array_to_string(['# {p["title"]}', '', '**{p["file"]}:** `/media/' || rec.recording_id || '`  ',
  '**{p["duration"]}:** ' || CASE WHEN duration > 0 THEN {texts_sql.clock("duration")} ELSE '{p["unknown"]}' END || '  ',
  '**{p["total"]}:** ' || coalesce(n, 0) || ' ({p["high"]}: ' || coalesce(high, 0) || ', {p["medium"]}: ' || coalesce(medium, 0) || ', {p["low"]}: ' || coalesce(low, 0) || ')', '', '## {p["timeline"]}', ''
  ] || CASE WHEN n > 0 THEN ['{p["table"]}', '|---|---|---|---|---|---|'] || lines ELSE ['{p["no_findings"]}'] END || ['', '## {p["detailed"]}', ''] || coalesce(flatten(details), ['{p["none"]}'])
  || CASE WHEN limits IS NULL THEN [] ELSE ['## {p["limitations"]}', ''] || limits || [''] END, chr(10)) AS markdown
FROM rec LEFT JOIN (
  SELECT recording_id, count(*) AS n, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
    list('| ' || {span} || ' | ' || {length} || ' | ' || wc.word || ' | ' || ws.word || ' | ' || wf.word || ' | ' || type || ' |' ORDER BY _start, _end, ord, type) AS lines,
    list(['### ' || {span} || ' (' || {length} || ') -- ' || upper(ws.word) || ' / ' || type, '', '- **{p["category"]}**: ' || wc.word, '- **{p["confidence"]}**: ' || wf.word, '- **{p["detector"]}**: ' || detector, '', '**{p["observed"]}:**']
      || list_transform(observations, lambda o: '- ' || o) || ['', '**{p["meant"]}:** ' || interpretation, '', '**{p["review"]}**', ''] ORDER BY _start, _end, ord, type) AS details
  FROM (SELECT *, "start" AS _start, "end" AS _end FROM told WHERE lang = '{lang}') t
  JOIN wrd ws ON ws.lang = t.lang AND ws.kind = 'severity' AND ws.key = severity JOIN wrd wc ON wc.lang = t.lang AND wc.kind = 'category' AND wc.key = category
  JOIN wrd wf ON wf.lang = t.lang AND wf.kind = 'severity' AND wf.key = confidence GROUP BY recording_id
) f USING (recording_id) LEFT JOIN (SELECT recording_id, list('- ' || limitation ORDER BY ord) AS limits FROM lm GROUP BY 1) USING (recording_id)"""


_CLOCK = """CASE WHEN x IS NULL THEN '' ELSE printf('%02d:%02d:%02d.%03d', x // 3600000, x // 60000 % 60, x // 1000 % 60, x % 1000) END"""

_HEX = "h AS (SELECT doc_id::VARCHAR AS recording_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_BYTE = "('0x' || substr(h, 1 + 2 * ({})::BIGINT, 2))::INT"
#: Samples of 16 bits, little-endian, of the texts' bytes.
_PCM = f"""{_HEX}, hc AS (SELECT recording_id, c, substr(h, 1 + 4096 * c, 4096) AS h FROM (SELECT *, unnest(range(0, length(h) // 4096 + 1)) AS c FROM h)),
n AS (SELECT recording_id, c, h, unnest(range(0, length(h) // 4)) AS i FROM hc),
x0 AS (SELECT recording_id, c * 1024 + i AS i, {_BYTE.format('2 * i')} + 256 * {_BYTE.format('2 * i + 1')} AS u FROM n),
x AS (SELECT recording_id, i, (CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) / 32768.0::DOUBLE AS y FROM x0)"""

_PROBE = """o AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders), pb AS (
  SELECT k, k % 5 = 0 AS failed, CASE WHEN k % 5 = 0 OR k % 8 = 0 THEN 0.0 ELSE k % 1000 + 0.5 END::DOUBLE AS duration, CASE WHEN k % 5 <> 0 THEN floor(p)::BIGINT END AS bitrate,
    k % 5 NOT IN (0, 1) AS has_video, k % 5 NOT IN (0, 2) AS has_audio, CASE WHEN k % 5 NOT IN (0, 1) THEN 320 * (k % 4 + 1) END::INT AS width, CASE WHEN k % 5 NOT IN (0, 1) THEN 180 * (k % 3 + 1) END::INT AS height,
    CASE WHEN k % 5 NOT IN (0, 2) THEN k % 3 ELSE 0 END::INT AS channels, CASE WHEN k % 5 IN (0, 1) OR k % 6 = 1 THEN NULL WHEN k % 6 = 0 THEN 25.0 ELSE 30000.0 / 1001 END::DOUBLE AS frame_rate,
    CASE WHEN k % 5 NOT IN (0, 1) THEN CASE WHEN k % 4 = 0 THEN 'yuv422p' ELSE 'yuv420p' END END AS pix_fmt, CASE WHEN k % 5 NOT IN (0, 1) THEN 'h264' END AS codec_name
  FROM o
), pr AS (SELECT *, width || 'x' || height AS resolution FROM pb)"""

#: Why detectors were left out.
_LIMITS = """lim(ord, name, needs) AS (VALUES (0, 'blackout', 'v'), (1, 'freeze', 'v'), (2, 'clipping', 'a'), (4, 'progression_interruption', 'v'), (5, 'audio_dropout', 'a'), (6, 'slide_rollback_pattern', 'v'), (7, 'brief_unexpected_slide', 'v')), lm AS (SELECT recording_id, -1 AS ord, '''/media/' || recording_id || ''' could not be probed as a media file with video or audio streams; no detectors were run.' AS limitation FROM rec WHERE NOT v AND NOT a
UNION ALL SELECT recording_id, ord, 'Detector ''' || name || ''' skipped: input has no ' || CASE needs WHEN 'v' THEN 'video' ELSE 'audio' END || ' stream.' FROM rec, lim WHERE (v OR a) AND CASE needs WHEN 'v' THEN NOT v ELSE NOT a END
UNION ALL SELECT recording_id, 3, 'Detector ''channel_imbalance'' skipped: input has 0 audio channel(s); channel-imbalance detection needs at least 2.' FROM rec WHERE v AND NOT a
UNION ALL SELECT recording_id, ord, 'Detector ''' || name || ''' skipped: ' || CASE WHEN NOT wide THEN 'content is not landscape (aspect ratio 0.56 < 1.2); slide decks and screen shares are virtually always landscape, so this is very unlikely to be one.'
    ELSE 'content does not look slide-like (stability ratio ' || printf('%.2f', stability) || ' < 0.35); this detector assumes long-held slide states and would otherwise flood the report on ordinary video.' END
  FROM rec JOIN sg USING (recording_id), lim WHERE v AND ord IN (6, 7) AND (NOT wide OR stability < 0.35) AND n >= CASE ord WHEN 6 THEN 3 ELSE 2 END)"""
_COMPARED = ("resolution", "frame_rate", "codec_name", "pix_fmt", "bitrate", "duration")

SQL: dict[str, str] = {
    "analysis_events": f"""{_ALL} SELECT recording_id, round("start", 5) AS "start", round("end", 5) AS "end", type, category, severity, confidence, detector, true AS requires_human_review FROM evc""",
    "analysis_limitations": f"{_ALL}, {_LIMITS} SELECT recording_id, ord, limitation FROM lm",
    "analysis_index": f"""{_ALL} SELECT rec.recording_id, '/media/' || rec.recording_id AS path, true AS ok, any_value(duration) AS duration, count(type) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
FROM rec LEFT JOIN evc USING (recording_id) GROUP BY 1""",
    "analysis_summary": f"""{_ALL} SELECT recording_id, count(*) AS total_events, count(*) FILTER (category = 'video') AS video, count(*) FILTER (category = 'audio') AS audio, count(*) FILTER (category = 'presentation') AS presentation, count(*) FILTER (category = 'progress') AS progress FROM evc GROUP BY 1""",
    "analysis_texts": f"""{_ALL}, {_SAID} SELECT recording_id, type, round("start", 3) AS "start", lang, array_to_string(observations, chr(10)) AS observations, interpretation FROM said""",
    "analysis_explained": f"""{_ALL}, {_SAID} SELECT recording_id, type, round("start", 3) AS "start", 'Event: ' || type || ' (' || category || ')' || chr(10) || 'Time: ' || printf('%.2fs - %.2fs (%.2fs)', "start", "end", "end" - "start") || chr(10) || 'Severity: ' || severity || '   Confidence: ' || confidence || chr(10) || chr(10)
|| 'Observed:' || chr(10) || array_to_string(list_transform(observations, lambda o: '  - ' || o || chr(10)), '') || chr(10) || 'Possible interpretation:' || chr(10) || '  ' || interpretation || chr(10) || chr(10) || 'Human verification required.' || chr(10) AS explanation FROM told WHERE lang = 'en'""",
    "analysis_markdown": f"""{_ALL}, {_SAID}, {_LIMITS}, wrd(lang, kind, key, word) AS (VALUES {texts_sql.rows(texts_sql.WORDS)}) {_markdown("en")} UNION ALL {_markdown("ja")}""",
    "analysis_json": f"""{_ALL}, {_SAID} SELECT recording_id, (row_number() OVER (PARTITION BY recording_id ORDER BY "start", "end", ord, type) - 1)::INT AS pos, type, category, severity, confidence, detector, true AS requires_human_review,
  printf('%.3f', "start")::DOUBLE AS "start", printf('%.3f', "end")::DOUBLE AS "end", printf('%.3f', "end" - "start")::DOUBLE AS duration, {texts_sql.clock('"start"')} AS start_timestamp, {texts_sql.clock('"end"')} AS end_timestamp,
  array_to_string(observations, chr(10)) AS observations, interpretation, '/media/' || recording_id AS source_files FROM told WHERE lang = 'en'""",
    "analysis_reports": f"""{_ALL}, r AS (SELECT rec.recording_id, count(type) AS n, count(*) FILTER (severity = 'high') AS high, round_even(min(evc."start") * 1000, 0)::BIGINT AS x FROM rec LEFT JOIN evc USING (recording_id) GROUP BY 1)
SELECT recording_id, '/media/' || recording_id AS path, n AS total_events, high, n AS in_json, n AS in_markdown, n AS in_html, {_CLOCK} AS first FROM r""",
    "incident_windows": f"""{_ALL}, t AS (SELECT recording_id, "start", "end", severity, 0 AS d FROM ev WHERE type = 'clipping' UNION ALL SELECT recording_id, "start", "end", severity, 1 FROM ev WHERE type = 'possible_audio_dropout'),
t2 AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY "start", "end", d)::INT AS incident FROM t)
SELECT lw.recording_id, incident, lw."start", rms_db FROM t2 JOIN lw ON lw.recording_id = t2.recording_id AND lw."start" >= greatest(t2."start" - 1.5, 0) AND lw."start" <= greatest(t2."start" - 1.5, 0) + greatest(t2."end" - t2."start" + 3, 0.5) WHERE severity = 'high'""",
    "slide_states": f"""WITH {_REL}, {_STATES}, first AS (SELECT recording_id, state_id, row_number() OVER (PARTITION BY recording_id ORDER BY min(pos)) - 1 AS id FROM s GROUP BY 1, 2)
SELECT recording_id, pos, round("start", 5) AS "start", round("end", 5) AS "end", id::INT AS state_id, sample_count FROM s JOIN first USING (recording_id, state_id)""",
    "probe_recordings": f"""WITH {_PROBE} SELECT k::VARCHAR AS recording_id, failed, duration, coalesce(bitrate, -1) AS bitrate, has_video, has_audio, coalesce(width, 0) AS width, coalesce(height, 0) AS height, channels, round(frame_rate, 6) AS frame_rate, resolution, round(width / height, 6) AS aspect, pix_fmt FROM pr""",
    "freeze_log": f"""WITH {_E}, f AS (SELECT recording_id, recording_id::BIGINT AS n, event_id + 0.25::DOUBLE AS "start", event_id + 3.75::DOUBLE AS stop, length(event_type) + 0.5::DOUBLE AS d FROM e),
g AS (SELECT recording_id, "start", CASE WHEN n % 2 = 0 THEN "start" + d ELSE stop END AS "end" FROM f WHERE n % 2 = 0 OR n % 5 <> 0)
SELECT recording_id, 'freeze' AS kind, "start", "end", "end" - "start" AS duration FROM g""",
    "silence_log": f"""WITH {_E} SELECT recording_id, 'silence' AS kind, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * (event_id + 0.5::DOUBLE) AS "start", event_id + 7.5::DOUBLE AS "end", length(event_type)::DOUBLE AS duration FROM e WHERE recording_id::BIGINT % 4 <> 0""",
    "channel_log": f"""WITH {_E}, f AS (SELECT recording_id, event_id, (row_number() OVER (PARTITION BY recording_id ORDER BY event_id) - 1)::INT AS idx, length(event_type) AS n FROM e)
SELECT recording_id, idx, event_id * 1000 + 250 AS start_ms, event_id + 0.25::DOUBLE AS "start", event_id + 0.75::DOUBLE AS "end", channel, level
FROM (SELECT *, 2 AS channel, -(n + 0.5::DOUBLE) AS level FROM f UNION ALL SELECT *, 1, -120.0::DOUBLE FROM f WHERE event_id % 2 = 0)""",
    "raw_frames": f"""WITH {_HEX}, f AS (SELECT recording_id, idx, substr(h, 1 + 2048 * idx, 2048) AS h FROM (SELECT recording_id, h, unnest(range(0, length(h) // 2048))::INT AS idx FROM h)),
v AS (SELECT recording_id, idx, list_transform(range(0, 1024), lambda i: {_BYTE.format('i')}) AS v FROM f),
m AS (SELECT *, list_sum(v) / 1024 AS mean FROM v)
SELECT recording_id, idx, idx * 500::BIGINT AS time_ms, idx / 2.0::DOUBLE AS time, md5(array_to_string(list_transform(v, lambda x: (x >= mean)::INT), '')) AS hash_md5, least(floor(mean / 256 * 32), 31)::INT AS bucket FROM m""",
    "still_segments": f"""WITH {_HEX}, f AS (SELECT recording_id, idx, substr(h, 1 + 128 * idx, 128) AS h FROM (SELECT recording_id, h, unnest(range(0, length(h) // 128))::INT AS idx FROM h)),
v AS (SELECT recording_id, idx, list_transform(range(0, 64), lambda i: {_BYTE.format('i')}) AS v FROM f),
w AS (SELECT *, lag(v) OVER (PARTITION BY recording_id ORDER BY idx) AS p FROM v),
d AS (SELECT recording_id, idx, coalesce(list_sum(list_transform(list_zip(v, p), lambda z: abs(z[1] - z[2]))) / 64 <= 255 * power(10, -22.0::DOUBLE / 20), false) AND p IS NOT NULL AS hit FROM w),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM d WHERE hit)
SELECT recording_id, 'freeze' AS kind, min(idx) / 2 AS "start", max(idx) / 2 + 0.5 AS "end", max(idx) / 2 + 0.5 - min(idx) / 2 AS duration FROM g GROUP BY recording_id, g HAVING max(idx) / 2 + 0.5 - min(idx) / 2 >= 1""",
    "sample_levels": f"""WITH {_PCM}, w AS (SELECT recording_id, (i // 50)::INT AS idx, avg(y * y) AS ms, max(abs(y)) AS peak, count(*) AS n, count(*) FILTER (abs(y) >= 0.999) AS lim FROM x GROUP BY 1, 2)
SELECT recording_id, idx, idx * 500::BIGINT AS start_ms, idx * 0.5::DOUBLE AS "start", idx * 0.5::DOUBLE + 0.5 AS "end", CASE WHEN ms = 0 THEN -120 ELSE round(10 * log10(nullif(ms, 0)), 6) END::DOUBLE AS rms_db,
CASE WHEN peak = 0 THEN -120 ELSE round(10 * log10(nullif(peak * peak, 0)), 6) END::DOUBLE AS peak_db, round(greatest(lim - 1, 0) / n * 10, 6) AS flat_factor FROM w""",
    "channel_samples": f"""WITH {_REL}, c AS (SELECT recording_id, (ms // 86400000)::INT AS idx, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS channel, avg(value / 500 * (value / 500)) AS ms2 FROM e GROUP BY 1, 2, 3)
SELECT recording_id, idx, idx * 86400.0::DOUBLE AS "start", idx * 86400.0::DOUBLE + 86400 AS "end", coalesce(channel, 0)::INT AS channel, round(10 * log10(ms2), 6) AS level FROM c""",
    "spectral_peaks": f"""WITH {_PCM}, w AS (SELECT recording_id, i // 256 AS w, i % 256 AS t, y, y * (0.5 - 0.5 * cos(2 * pi() * (i % 256) / 255)) AS z FROM x),
full_ AS (SELECT recording_id, w, sqrt(avg(y * y)) AS rms FROM w GROUP BY 1, 2 HAVING count(*) = 256),
f AS (SELECT recording_id, w, k, sqrt(power(sum(z * cos(2 * pi() * k * t / 256)), 2) + power(sum(z * sin(2 * pi() * k * t / 256)), 2)) AS m FROM w SEMI JOIN full_ USING (recording_id, w), (SELECT unnest(range(20, 31)) AS k) GROUP BY 1, 2, 3),
p AS (SELECT recording_id, w, sum(m) AS total, arg_max(k, m) AS peak FROM f GROUP BY 1, 2)
SELECT recording_id, w::DOUBLE AS time, CASE WHEN any_value(total) <= 1e-9 THEN 0 ELSE any_value(peak) END::DOUBLE AS dominant_freq, round(CASE WHEN any_value(total) <= 1e-9 THEN 0 ELSE sum(m) FILTER (abs(k - peak) <= 2) / any_value(total) END, 4) AS concentration, round(any_value(rms), 4) AS rms
FROM f JOIN p USING (recording_id, w) JOIN full_ USING (recording_id, w) GROUP BY 1, 2""",
    "compare_frames": """WITH l AS (SELECT l_orderkey % 50 AS pair_id, l_orderkey // 50 AS pixel, l_linenumber AS frame, max(l_quantity) * 5 AS b, max(l_tax) AS t FROM lineitem WHERE l_linenumber * 10 < 45 GROUP BY 1, 2, 3),
f AS (SELECT pair_id, frame, avg((a - b) * (a - b)) AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov, count(*) AS n FROM (SELECT *, b * (1 - t) AS a FROM l) GROUP BY 1, 2),
g AS (SELECT pair_id, sum(mse * n) / sum(n) AS mse, max(mse) AS worst, avg(((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS ssim FROM f GROUP BY 1)
SELECT pair_id, round(10 * log10(65025 / mse), 5) AS psnr_avg_db, round(10 * log10(65025 / worst), 5) AS psnr_min_db, round(ssim, 5) AS ssim_avg FROM g""",
}


def _comparison() -> str:
    from .comparison import LIMITS, REASONS

    q = lambda s: "'" + s.replace("'", "''") + "'"
    diff = ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _COMPARED)
    degraded = "coalesce(ssim < 0.92, false) OR psnr < 35"
    return f"""WITH {_PROBE}, m AS (SELECT k AS pair_id, CASE WHEN k % 9 <> 0 THEN 0.9::DOUBLE + (k % 10) / 100 END AS ssim, 30.0::DOUBLE + k % 10 AS psnr FROM o WHERE k % 3 = 0),
c AS (SELECT a.k AS pair_id, '/in/' || a.k AS source_path, '/in/' || b.k AS export_path, array_to_string(list_filter([{diff}], lambda x: x IS NOT NULL), ',') AS changed,
  a.resolution IS DISTINCT FROM b.resolution OR a.pix_fmt IS DISTINCT FROM b.pix_fmt AS format_changed FROM pr a JOIN pr b ON b.k = a.k + 1),
j AS (SELECT c.*, m.pair_id IS NOT NULL AS has, ssim, psnr FROM c LEFT JOIN m USING (pair_id))
SELECT pair_id, source_path, export_path, changed, format_changed, CASE WHEN NOT has THEN 'inconclusive' WHEN {degraded} THEN 'additional_downstream_degradation' ELSE 'source_degradation_already_present' END AS conclusion,
array_to_string(list_filter([CASE WHEN format_changed THEN {q(REASONS['no_spec'])} END, CASE WHEN NOT has THEN {q(REASONS['no_metrics'])} END,
  CASE WHEN has THEN 'SSIM (export vs. source, compared at 320x180): ' || coalesce(ssim::VARCHAR, 'None') || '.' END, CASE WHEN has THEN 'PSNR average: ' || psnr::VARCHAR || ' dB, minimum: 25.0 dB.' END,
  CASE WHEN has THEN CASE WHEN {degraded} THEN {q(REASONS['worse'])} ELSE {q(REASONS['same'])} END END], lambda x: x IS NOT NULL), chr(10)) AS reasoning,
array_to_string(list_filter([CASE WHEN format_changed THEN {q(LIMITS['no_spec'])} END, CASE WHEN NOT has THEN {q(LIMITS['no_metrics'])} END, CASE WHEN has THEN {q(LIMITS['aligned'].format(60.0))} END, CASE WHEN has THEN {q(LIMITS['who'])} END], lambda x: x IS NOT NULL), chr(10)) AS limitations FROM j"""


def _online() -> str:
    """States by a fold over the segments, with the list of known pictures as its state."""
    anchors = f"""w AS (SELECT (label % 4)::VARCHAR AS rec, vec_id::DOUBLE AS time, b, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS i FROM v),
z AS (SELECT rec, i, time, b AS anchor, 0 AS pos, 0 AS d FROM w WHERE i = 1
  UNION ALL SELECT rec, i, time, CASE WHEN d > 30 THEN b ELSE anchor END, pos + (d > 30)::INT, CASE WHEN d > 30 THEN 0 ELSE d END
  FROM (SELECT w.rec, w.i, w.time, w.b, z.anchor, z.pos, {_DIST.format('w.b', 'z.anchor')} AS d FROM z JOIN w ON w.rec = z.rec AND w.i = z.i + 1)),
g AS (SELECT rec, pos, min(time) AS "start", max(time) AS last, count(*)::INT AS sample_count, any_value(anchor) AS b FROM z GROUP BY 1, 2)"""
    far = "list_transform(known, lambda k: list_sum(list_transform(list_zip(g.b, k), lambda x: (x[1] <> x[2])::INT)))"
    return f"""WITH RECURSIVE {_V}, {anchors},
y AS (SELECT rec, pos, [b] AS known, 0 AS state_id FROM g WHERE pos = 0
  UNION ALL SELECT rec, pos, CASE WHEN least_ <= 24 THEN list_transform(known, lambda k, n: CASE WHEN n = place THEN b ELSE k END) ELSE list_append(known, b) END, CASE WHEN least_ <= 24 THEN place - 1 ELSE len(known) END::INT
  FROM (SELECT *, list_min(far) AS least_, list_position(far, list_min(far)) AS place FROM (SELECT g.rec, g.pos, g.b, y.known, {far} AS far FROM y JOIN g ON g.rec = y.rec AND g.pos = y.pos + 1)))
SELECT g.rec AS recording_id, g.pos, "start", coalesce(lead("start") OVER (PARTITION BY g.rec ORDER BY g.pos), last + 1) AS "end", state_id, sample_count FROM g JOIN y ON y.rec = g.rec AND y.pos = g.pos"""


SQL["compare_exports"] = _comparison()
SQL["online_states"] = _online()
