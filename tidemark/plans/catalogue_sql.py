"""DuckDB SQL for the queries of tidemark.plans.catalogue, over the same tables."""

from __future__ import annotations

_E = "e AS (SELECT user_id::VARCHAR AS recording_id, event_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events)"
_L = f"""{_E}, l AS (
  SELECT recording_id, ms // 21600000 AS idx, round(sqrt(avg(value * value)), 6) AS rms_db, max(value) AS peak_db, (count(*) FILTER (value >= 100))::DOUBLE AS flat_factor
  FROM e GROUP BY 1, 2
), lw AS (SELECT *, idx * 21600.0::DOUBLE AS "start", idx * 21600.0::DOUBLE + 21600 AS "end" FROM l)"""
_C = f"""{_E}, c AS (SELECT recording_id, ms // 86400000 AS idx, event_type, round(sqrt(avg(value * value)), 6) AS level FROM e GROUP BY 1, 2, 3)"""
_CL = f"""{_C}, cl AS (
  SELECT recording_id, idx, CASE WHEN count(*) < 2 THEN NULL WHEN max(level) > 40 AND min(level) <= 10 THEN 'missing'
    WHEN max(level) > 40 AND max(level) - min(level) >= 12 THEN 'imbalance' END AS label FROM c GROUP BY 1, 2)"""
_S = f"""{_E}, s0 AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY recording_id ORDER BY ms, event_id) AS b FROM e),
s1 AS (SELECT *, sum(b::INT) OVER (PARTITION BY recording_id ORDER BY ms, event_id) AS run FROM s0),
s2 AS (SELECT recording_id, run, event_type AS state_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS n FROM s1 GROUP BY 1, 2, 3),
s3 AS (SELECT recording_id, (row_number() OVER w - 1)::INT AS pos, state_id, start_ms, coalesce(lead(start_ms) OVER w, last_ms) AS end_ms, n FROM s2 WINDOW w AS (PARTITION BY recording_id ORDER BY run)),
s AS (SELECT *, start_ms / 1000 AS "start", end_ms / 1000 AS "end" FROM s3)"""
_CLIP = """q0 AS (SELECT *, idx - row_number() OVER (PARTITION BY recording_id, hit ORDER BY idx) AS g FROM (
    SELECT *, peak_db >= 150 AND flat_factor >= 1 AS hit, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS i FROM lw)),
q1 AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id, hit ORDER BY idx) AS r FROM q0),
clip AS (SELECT recording_id, min("start") AS "start", max("end") AS "end", max(peak_db) AS max_peak_db, max(flat_factor) AS max_flat_factor, count(*) AS n, max("end") - min("start") AS duration
  FROM q1 WHERE hit GROUP BY recording_id, r)"""
_DROP = """d0 AS (SELECT *, rms_db <= 20 AS quiet,
    bool_and(rms_db > 30) OVER (PARTITION BY recording_id ORDER BY idx RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
    bool_and(rms_db > 30) OVER (PARTITION BY recording_id ORDER BY idx RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS ahead,
    row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS i FROM lw),
d1 AS (SELECT *, lead(ahead) OVER (PARTITION BY recording_id ORDER BY idx) AS after, i - row_number() OVER (PARTITION BY recording_id, quiet ORDER BY idx) AS r FROM d0),
d2 AS (SELECT recording_id, min("start") AS "start", max("end") AS "end", min_by(rms_db, idx) AS first_level, count(*) AS n, coalesce(min_by(before, idx), false) AS b,
    coalesce(arg_max_null(after, idx), false) AS a FROM d1 WHERE quiet GROUP BY recording_id, r),
dropout AS (SELECT recording_id, "start", "end", first_level, n, "end" - "start" AS duration FROM d2 WHERE a AND b AND "end" - "start" BETWEEN 21600 AND 129600)"""
_BRIEF = """br0 AS (SELECT *, lag(state_id) OVER w AS previous_state, lead(state_id) OVER w AS next_state FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
brief AS (SELECT * FROM br0 WHERE previous_state IS NOT NULL AND next_state IS NOT NULL AND "end" - "start" < 4320)"""
_ROLL = """r0 AS (SELECT *, lead(state_id, 1) OVER w AS s1, lead(state_id, 2) OVER w AS s2, lead(state_id, 3) OVER w AS s3, lead("end", 2) OVER w AS e2, lead("start", 3) OVER w AS b3
  FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY pos)),
r1 AS (SELECT *, coalesce(s2 = state_id AND s1 <> state_id, false) AS hit FROM r0),
r2 AS (SELECT *, pos - row_number() OVER (PARTITION BY recording_id, hit ORDER BY pos) AS g FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY recording_id, g ORDER BY pos) AS i FROM r2 WHERE hit),
roll AS (SELECT recording_id, pos, state_id, s1 AS other_state, "end" AS "start", CASE WHEN s3 = s1 THEN b3 ELSE e2 END AS "end", coalesce(s3 = s1, false) AS confirmed_repeat FROM r3 WHERE i % 2 = 1)"""
_T = f"""{_L}, {_S.removeprefix(_E + ', ')}, {_CLIP}, {_DROP}, {_BRIEF}, {_ROLL}, t AS (
  SELECT recording_id, "start", "end", 'clipping' AS type, 'audio' AS category, CASE WHEN "end" - "start" >= 64800 THEN 'high' ELSE 'medium' END AS severity, 0 AS detector_ord FROM clip
  UNION ALL SELECT recording_id, "start", "end", 'possible_audio_dropout', 'audio', CASE WHEN "end" - "start" >= 43200 THEN 'high' ELSE 'medium' END, 1 FROM dropout
  UNION ALL SELECT recording_id, "start", "end", 'brief_unexpected_slide', 'presentation', 'medium', 2 FROM brief
  UNION ALL SELECT recording_id, "start", "end", 'slide_rollback_pattern', 'presentation', 'low', 3 FROM roll)"""
_PLAN = """n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY "start", "end", detector_ord) AS incident FROM t),
plan AS (SELECT recording_id, incident::INT AS incident, type, severity, greatest("start" - 1, 0) AS before_at, "start" AS event_at, "end" + 1 AS after_at,
    greatest("start" - 1.5, 0) AS clip_start, greatest("end" - "start" + 3.0, 0.5) AS clip_length FROM n WHERE severity = 'high')"""
_V = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE >= list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding))::INT) AS b FROM embeddings)"""
_DIST = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] <> z[2])::INT))::INT"
_Q = """f AS (SELECT {key}, l_linenumber, avg((a - b) * (a - b)) AS mse, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cov, count(*) AS n
  FROM (SELECT *, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem) GROUP BY ALL),
g AS (SELECT {key}, sum(mse * n) / sum(n) AS mse, max(mse) AS worst, avg(((2 * ma * mb + 1e6) * (2 * cov + 9e6)) / ((ma * ma + mb * mb + 1e6) * (va + vb + 9e6))) AS ssim FROM f GROUP BY ALL)"""

SQL: dict[str, str] = {
    "level_envelope": f'WITH {_L} SELECT recording_id, idx, "start", "end", rms_db, peak_db, flat_factor FROM lw',
    "clipping_runs": f"WITH {_L}, {_CLIP} FROM clip",
    "dropout_context": f"WITH {_L}, {_DROP} SELECT *, CASE WHEN duration >= 43200 THEN 'high' ELSE 'medium' END AS severity FROM dropout",
    "channel_levels": f"WITH {_C} FROM c",
    "channel_classify": f"WITH {_CL} FROM cl",
    "channel_runs": f"""WITH {_CL}, k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS i FROM cl),
r AS (SELECT *, i - row_number() OVER (PARTITION BY recording_id, label ORDER BY idx) AS g FROM k)
SELECT recording_id, label, min(idx) * 86400.0::DOUBLE AS "start", max(idx) * 86400.0::DOUBLE + 86400 AS "end", count(*) AS n, (max(idx) - min(idx) + 1) * 86400.0::DOUBLE AS duration
FROM r WHERE label IS NOT NULL GROUP BY recording_id, label, g HAVING max(idx) - min(idx) >= 1""",
    "state_runs": f"WITH {_S} FROM s3",
    "rollback_pattern": f"WITH {_S}, {_ROLL} FROM roll",
    "brief_states": f'WITH {_S}, {_BRIEF} SELECT recording_id, pos, state_id, previous_state, next_state, round("end" - "start", 3) AS duration FROM brief',
    "stability_ratio": f"""WITH {_S} SELECT recording_id, round(sum(CASE WHEN "end" - "start" >= 7200 THEN "end" - "start" ELSE 0 END) / nullif(sum("end" - "start"), 0), 6) AS stability, count(*) AS n_states FROM s GROUP BY 1""",
    "presentation_gate": f"""WITH {_S}, g AS (SELECT recording_id, sum(CASE WHEN "end" - "start" >= 21600 THEN "end" - "start" ELSE 0 END) / nullif(sum("end" - "start"), 0) AS stability FROM s GROUP BY 1)
SELECT recording_id, CASE WHEN (recording_id::BIGINT % 3 + 1) * 0.7::DOUBLE < 1.2 THEN 'not landscape' WHEN stability < 0.9 THEN 'not look slide-like' ELSE '' END AS gate FROM g""",
    "severity_bands": f"""WITH {_S} SELECT CASE WHEN "end" - "start" >= 86400 THEN 'high' WHEN "end" - "start" >= 21600 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS total_ms FROM s GROUP BY 1""",
    "freeze_audio_overlap": f"""WITH {_L}, {_S.removeprefix(_E + ', ')}, x AS (SELECT recording_id, "start", "end" FROM s WHERE "end" - "start" >= 21600)
SELECT x.*, EXISTS (FROM lw WHERE lw.recording_id = x.recording_id AND lw."end" > x."start" AND lw."start" < x."end" AND rms_db > 100) AS audio_active FROM x""",
    "persistent_peak_runs": f"""WITH {_E}, p AS (SELECT *, ms / 1000 AS time, lag(ms / 1000) OVER w AS pt, lag(value) OVER w AS pv FROM e WHERE value >= 20 WINDOW w AS (PARTITION BY recording_id ORDER BY ms)),
r AS (SELECT *, sum(CASE WHEN time - pt > 10800 OR abs(value - pv) > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY ms) AS run FROM p)
SELECT recording_id, min(time) AS "start", max(time) + 7200 AS "end", round(avg(value), 6) AS dominant_frequency_hz, max(value) AS max_concentration, count(*) AS n FROM r GROUP BY recording_id, run HAVING max(time) + 7200 - min(time) >= 10800""",
    "average_hash": f"WITH {_V} SELECT vec_id, array_to_string(b, '') AS bits FROM v",
    "hamming_pairs": f"WITH {_V} SELECT x.vec_id, {_DIST.format('x.b', 'y.b')} AS distance FROM v x JOIN v y ON y.vec_id = x.vec_id + 1",
    "visual_activity": f"""WITH {_V}, w AS (SELECT (label % 4)::VARCHAR AS recording_id, vec_id::DOUBLE AS time, b, lag(b) OVER (PARTITION BY label % 4 ORDER BY vec_id) AS p FROM v)
SELECT recording_id, time, {_DIST.format('b', 'p')} AS distance FROM w WHERE p IS NOT NULL""",
    "anchor_segments": f"""WITH RECURSIVE {_V}, w AS (SELECT (label % 4)::VARCHAR AS rec, vec_id::DOUBLE AS time, b, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS i FROM v),
z AS (SELECT rec, i, time, b AS anchor, 0 AS pos, 0 AS d FROM w WHERE i = 1
  UNION ALL SELECT rec, i, time, CASE WHEN d > 30 THEN b ELSE anchor END, pos + (d > 30)::INT, CASE WHEN d > 30 THEN 0 ELSE d END
  FROM (SELECT w.rec, w.i, w.time, w.b, z.anchor, z.pos, {_DIST.format('w.b', 'z.anchor')} AS d FROM z JOIN w ON w.rec = z.rec AND w.i = z.i + 1)),
g AS (SELECT rec, pos, min(time) AS "start", max(time) AS last, count(*)::INT AS sample_count, max(d) AS max_internal_distance FROM z GROUP BY 1, 2)
SELECT rec AS recording_id, pos, "start", coalesce(lead("start") OVER (PARTITION BY rec ORDER BY pos), last + 1) AS "end", sample_count, max_internal_distance FROM g""",
    "progress_buckets": f"""WITH {_L}, {_S.removeprefix(_E + ', ')}, k AS (SELECT recording_id, unnest(range(0, floor((max(ms) / 1000 - 1704067200) / 43200)::BIGINT + 1)) AS bucket FROM e GROUP BY 1),
loud AS (SELECT DISTINCT recording_id, floor(("start" - 1704067200) / 43200)::BIGINT AS bucket FROM lw WHERE rms_db > 60),
mv AS (SELECT recording_id, floor((ms / 1000 - 1704067200) / 43200)::BIGINT AS bucket, abs(value - lag(value) OVER (PARTITION BY recording_id ORDER BY ms, event_id)) AS d FROM e),
moved AS (SELECT recording_id, bucket FROM mv WHERE d IS NOT NULL GROUP BY 1, 2 HAVING max(d) > 60),
sb AS (SELECT recording_id, state_id, unnest(range(floor(("start" - 1704067200) / 43200)::BIGINT, ceil(("end" - 1704067200) / 43200)::BIGINT)) AS bucket FROM s WHERE "start" < "end"),
changed AS (SELECT recording_id, bucket FROM sb GROUP BY 1, 2 HAVING count(DISTINCT state_id) > 1),
b AS (SELECT * FROM k ANTI JOIN loud USING (recording_id, bucket)), b2 AS (SELECT * FROM b ANTI JOIN moved USING (recording_id, bucket)), b3 AS (SELECT * FROM b2 ANTI JOIN changed USING (recording_id, bucket)),
r AS (SELECT *, bucket - row_number() OVER (PARTITION BY recording_id ORDER BY bucket) AS g FROM b3)
SELECT recording_id, min(bucket) AS first_bucket, count(*) AS n FROM r GROUP BY recording_id, g HAVING count(*) >= 2""",
    "metadata_diff": """WITH m AS (SELECT l_returnflag AS f, count(*) AS n, max(l_quantity)::BIGINT AS max_qty, round(min(l_discount) * 100)::BIGINT AS min_disc FROM lineitem GROUP BY 1),
u(f, ord, field, value) AS (SELECT f, 0, 'n', n::VARCHAR FROM m UNION ALL SELECT f, 1, 'max_qty', max_qty::VARCHAR FROM m UNION ALL SELECT f, 2, 'min_disc', min_disc::VARCHAR FROM m)
SELECT 1 AS pair_id, a.ord, a.field, a.value AS source_value, b.value AS export_value, a.value IS DISTINCT FROM b.value AS changed FROM u a JOIN u b ON a.field = b.field WHERE a.f = 'R' AND b.f = 'N'""",
    "psnr_compare": f"WITH {_Q.format(key='l_returnflag, l_linestatus')} SELECT l_returnflag, l_linestatus, round(10 * log10(1e10 / mse), 4) AS psnr_avg_db, round(10 * log10(1e10 / worst), 4) AS psnr_min_db, round(ssim, 4) AS ssim_avg FROM g",
    "quality_classify": f"""WITH {_Q.format(key='l_returnflag')} SELECT l_returnflag, round(10 * log10(1e10 / mse), 4) AS psnr_avg_db,
CASE WHEN ssim < 0.5 OR 10 * log10(1e10 / mse) < 29 THEN 'additional_downstream_degradation' ELSE 'source_degradation_already_present' END AS conclusion FROM g""",
    "unified_timeline": f"WITH {_T} FROM t",
    "summary_rollup": f"""WITH {_T} SELECT recording_id, count(*) AS total_events, count(*) FILTER (severity = 'low') AS n_low, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'high') AS n_high,
count(*) FILTER (category = 'audio') AS n_audio, count(*) FILTER (category = 'presentation') AS n_presentation FROM t GROUP BY 1""",
    "timeline_filter": f"""WITH {_T} SELECT recording_id, "start", "end", type, severity FROM t WHERE category = 'audio' AND severity IN ('medium', 'high')""",
    "evidence_plan": f"WITH {_T}, {_PLAN} FROM plan",
    "batch_index": f"""WITH {_T} SELECT recording_id, any_value(d) AS duration, count(type) AS total, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
FROM (SELECT recording_id, (max(ms) - min(ms)) / 1000 AS d FROM e GROUP BY 1) LEFT JOIN t USING (recording_id) GROUP BY 1""",
    "nearest_frame": f"""WITH {_T}, {_PLAN}, f AS (SELECT recording_id, event_id::INT AS frame_idx, ms / 1000 AS frame_time FROM e)
SELECT plan.recording_id, incident, event_at, frame_idx, frame_time FROM plan ASOF LEFT JOIN f ON plan.recording_id = f.recording_id AND plan.event_at <= f.frame_time""",
    "timestamp_format": """WITH x AS (SELECT event_id, round_even(value * 371.25::DOUBLE * 1000, 0)::BIGINT AS ms FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS at FROM x""",
    "slugify": """SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'recording') AS slug FROM pages""",
    "i18n_labels": f"""WITH {_T}, lb(severity, lang, label) AS (VALUES ('low', 'en', 'low'), ('medium', 'en', 'medium'), ('high', 'en', 'high'), ('low', 'ja', '低'), ('medium', 'ja', '中'), ('high', 'ja', '高')),
w AS (SELECT type, severity, count(*) AS n, unnest(['ja', 'fr']) AS lang FROM t GROUP BY 1, 2)
SELECT w.type, w.severity, w.lang, w.n, coalesce(lb.label, en.label, w.severity) AS label FROM w LEFT JOIN lb ON lb.severity = w.severity AND lb.lang = w.lang LEFT JOIN lb en ON en.severity = w.severity AND en.lang = 'en'""",
    "parse_segment_log": f"""WITH {_E} SELECT recording_id, 'black' AS kind, event_id + 0.25::DOUBLE AS "start", event_id + length(event_type) + 0.75::DOUBLE AS "end", length(event_type) + 0.5::DOUBLE AS duration FROM e""",
    "parse_level_log": f"""WITH {_E} SELECT recording_id, event_id * 1000 + 500 AS start_ms, event_id + 0.5::DOUBLE AS "start", event_id + 1.0::DOUBLE AS "end", -(length(event_type) + 0.25::DOUBLE) AS rms_db,
CASE WHEN event_id % 3 = 0 THEN -120.0 ELSE -1.5 END::DOUBLE AS peak_db, 0.0::DOUBLE AS flat_factor FROM e""",
}
