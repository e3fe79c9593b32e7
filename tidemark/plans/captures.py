"""Queries over captured bytes: levels, silence, pictures and long recordings, with their SQL. Texts stand for captures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clips, levels, pictures, segments, silence, slugs
from ..sources import media
from . import catalogue, product
from .catalogue_sql import _DIST, _V
from .product_sql import _BYTE, _HEX, _PCM


def sample_silence(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of three samples or more that stay under -3 dB."""
    s = silence.silence_segments(media.pcm_blocks(product._raw(spark, sf), rate=100, block=1000), -3.0, 0.03)
    return s.select("recording_id", "kind", *[F.round(c, 6).alias(c) for c in ("start", "end", "duration")])


def interleaved_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of two channels that take turns."""
    w = levels.block_channel_levels(media.pcm_blocks(product._raw(spark, sf), rate=50, block=1001), 2)
    return w.select("recording_id", "idx", "start", "end", F.explode("channel_rms_db").alias("channel", "level")).withColumn("level", F.round("level", 6))


def captured_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Two clips of each capture as WAV files: their digests."""
    raw = product._raw(spark, sf)
    late = (F.col("recording_id").cast("long") % 7) / 2
    plan = raw.select("recording_id", F.inline(F.array(*[F.struct(F.lit(i).alias("incident"), s.cast("double").alias("clip_start"), F.lit(n).alias("clip_length")) for i, s, n in ((1, F.lit(0.5), 2.0), (2, late, 1.5))])))
    made = clips.wav_clips(media.pcm_blocks(raw, rate=100, block=64), plan)
    return made.select("recording_id", "incident", "first", "n", F.md5("content").alias("md5"))


def _pictures(spark: SparkSession, sf: str, width, height, fps: float) -> DataFrame:
    d = catalogue._read(spark, sf, "documents")
    raw = d.select(F.col("doc_id").cast("string").alias("recording_id"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("content"))
    return media.sized_frames(raw, fps)


def scaled_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of several sizes at ten a second, chosen at two a second and scaled to one size."""
    k = F.col("doc_id")
    frames = pictures.at_rate(_pictures(spark, sf, 5 + k % 4, 4 + k % 3, 10.0), 2.0)
    return pictures.scaled(frames, 4, 3).select("recording_id", "idx", "time", F.lower(F.hex("pixels")).alias("pixels"))


def compare_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Each text as frames of 16 x 12 with the text after it as its export of 12 x 16, at the size both hold."""
    source = _pictures(spark, sf, F.lit(16), F.lit(12), 2.0)
    export = _pictures(spark, sf, F.lit(12), F.lit(16), 2.0).withColumn("recording_id", (F.col("recording_id").cast("long") - 1).cast("string"))
    q = pictures.picture_quality(source, export, ["recording_id"])
    return q.select("recording_id", "resolution", *[F.round(c, 6).alias(c) for c in ("psnr_avg_db", "psnr_min_db", "ssim_avg")])


def black_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of frames of 6 x 6 that are dark for the most part."""
    frames = media.frame_pixels(product._raw(spark, sf), grid=6)
    return media.measured_segments(media.black_frames(frames, 0.40, 0.6), "black", 0.5)


def long_recording_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of one recording of all vectors, found by chunks of 64 seconds at once."""
    d = catalogue._vectors(spark, sf).select(F.lit("all").alias("recording_id"), F.col("vec_id").cast("double").alias("time"), "hash", "bucket")
    return segments.chunked_segments(d, 30, 1.0, 64.0).select("recording_id", "pos", "start", "end", "sample_count", "max_internal_distance")


def page_slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Unique slugs of the pages' hosts, some of which end as if they were numbered."""
    k = F.col("page_id")
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/]*)", 1)
    d = catalogue._read(spark, sf, "pages").select("page_id", F.concat(host, F.when(k % 3 == 0, "-2").otherwise(""), F.when(k % 7 == 0, "-3").otherwise("")).alias("name"))
    return slugs.unique_slug_rows(d, "page_id").select("page_id", "slug")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (sample_silence, interleaved_levels, captured_clips, scaled_frames, compare_pictures, black_segments, long_recording_segments, page_slugs)}

_LE32 = "printf('%02x%02x%02x%02x', ({0}) % 256, ({0}) // 256 % 256, ({0}) // 65536 % 256, ({0}) // 16777216)"
_OVER = "greatest(0, least(({0} + 1) * {2}, ({1} + 1) * {3}) - greatest({0} * {2}, {1} * {3}))"
_SUM = "list_sum(list_transform(range(0, {n}), lambda q: {f}))"


SQL: dict[str, str] = {
    "sample_silence": f"""WITH {_PCM}, q AS (SELECT recording_id, i, i - row_number() OVER (PARTITION BY recording_id ORDER BY i) AS g FROM x WHERE abs(y * 32768) <= floor(32768 * power(10, -3.0::DOUBLE / 20)))
SELECT recording_id, 'silence' AS kind, round(min(i) / 100, 6) AS "start", round((max(i) + 1) / 100, 6) AS "end", round(count(*) / 100, 6) AS duration FROM q GROUP BY recording_id, g HAVING count(*) >= 3""",
    "interleaved_levels": f"""WITH {_PCM}, w AS (SELECT recording_id, (i // 2 // 25)::INT AS idx, (i % 2 + 1)::INT AS channel, avg(y * y) AS ms FROM x GROUP BY ALL)
SELECT recording_id, idx, idx * 0.5::DOUBLE AS "start", idx * 0.5::DOUBLE + 0.5 AS "end", channel, CASE WHEN ms = 0 THEN -120 ELSE round(10 * log10(nullif(ms, 0)), 6) END::DOUBLE AS level FROM w""",
    "captured_clips": f"""WITH {_HEX}, p AS (SELECT recording_id, h, length(h) // 4 AS total, unnest([1, 2])::INT AS incident FROM h),
c AS (SELECT recording_id, h, total, incident, CASE incident WHEN 1 THEN 50 ELSE recording_id::BIGINT % 7 * 50 END AS first, CASE incident WHEN 1 THEN 200 ELSE 150 END AS most FROM p),
n AS (SELECT *, least(most, total - first) AS n FROM c WHERE first < total)
SELECT recording_id, incident, first, n, md5(unhex('52494646' || {_LE32.format('36 + 2 * n')} || '57415645666d7420100000000100010064000000c800000002001000' || '64617461' || {_LE32.format('2 * n')} || substr(h, 4 * first + 1, 4 * n))) AS md5 FROM n""",
    "scaled_frames": f"""WITH d AS (SELECT doc_id::VARCHAR AS recording_id, (5 + doc_id % 4)::INT AS w, (4 + doc_id % 3)::INT AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
f AS (SELECT recording_id, w, r, unnest(range(0, length(h) // 2 // (w * r))) AS i FROM d),
k AS (SELECT recording_id, floor(i / 10.0::DOUBLE * 2 + 0.5)::BIGINT AS idx, max(i) AS i FROM f GROUP BY ALL),
c AS MATERIALIZED (SELECT recording_id, idx, w, r, substr(h, (1 + 2 * i * w * r)::BIGINT, 2 * w * r) AS h FROM k JOIN d USING (recording_id))
SELECT recording_id, idx, idx / 2.0::DOUBLE AS time, list_aggregate(list_transform(range(0, 12), lambda p: printf('%02x', ((2 * {_SUM.format(n='w * r', f=f"{_OVER.format('p // 4', 'q // w', 'r', '3')} * {_OVER.format('p % 4', 'q % w', 'w', '4')} * ('0x' || substr(h, 1 + 2 * q::BIGINT, 2))::INT")} + w * r) // (2 * w * r))::INT)), 'string_agg', '') AS pixels FROM c""",
    "compare_pictures": f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
f AS MATERIALIZED (SELECT doc_id, i, substr(h, 1 + 384 * i, 384) AS h FROM (SELECT *, unnest(range(0, length(h) // 384)) AS i FROM d)),
px AS MATERIALIZED (SELECT doc_id, i, q, ('0x' || substr(h, 1 + 2 * q::BIGINT, 2))::INT AS v FROM (SELECT *, unnest(range(0, 192)) AS q FROM f)),
o AS MATERIALIZED (SELECT t, s, {_OVER.format('t', 's', '16', '12')} AS w FROM (SELECT unnest(range(0, 12)) AS t), (SELECT unnest(range(0, 16)) AS s) WHERE w > 0),
a AS (SELECT doc_id, i, q // 16 AS y, t AS x, (24 * sum(w * v) + 192)::BIGINT // 384 AS v FROM px JOIN o ON s = q % 16 GROUP BY doc_id, i, q // 16, t),
b AS (SELECT doc_id - 1 AS doc_id, i, t AS y, q % 12 AS x, (24 * sum(w * v) + 192)::BIGINT // 384 AS v FROM px JOIN o ON s = q // 12 GROUP BY doc_id, i, q % 12, t),
p AS MATERIALIZED (SELECT doc_id, i, y, x, a.v AS a, b.v AS b FROM a JOIN b USING (doc_id, i, y, x)),
w AS (SELECT doc_id, i, wy, wx, sum(a) AS a, sum(b) AS b, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab FROM p, (VALUES (0), (4)) r(wy), (VALUES (0), (4)) c(wx) WHERE y BETWEEN wy AND wy + 7 AND x BETWEEN wx AND wx + 7 GROUP BY ALL),
s AS (SELECT doc_id, i, avg((2 * a * b / 4096 + 6.5025::DOUBLE) * (2 * (64 * ab - a * b) / 4096 + 58.5225::DOUBLE) / (((a * a + b * b) / 4096 + 6.5025::DOUBLE) * ((64 * aa - a * a + 64 * bb - b * b) / 4096 + 58.5225::DOUBLE))) AS ssim FROM w GROUP BY ALL),
m AS (SELECT doc_id, i, sum((a - b) * (a - b)) / 144 AS mse FROM p GROUP BY ALL)
SELECT doc_id::VARCHAR AS recording_id, '12x12' AS resolution, round(10 * log10(65025 / avg(mse)), 6) AS psnr_avg_db, round(10 * log10(65025 / max(mse)), 6) AS psnr_min_db, round(avg(ssim), 6) AS ssim_avg FROM m JOIN s USING (doc_id, i) GROUP BY doc_id""",
    "black_segments": f"""WITH {_HEX}, f AS (SELECT recording_id, idx, substr(h, 1 + 72 * idx, 72) AS h FROM (SELECT recording_id, h, unnest(range(0, length(h) // 72))::INT AS idx FROM h)),
d AS (SELECT recording_id, idx FROM f WHERE len(list_filter(range(0, 36), lambda i: {_BYTE.format('i')} < 0.40 * 255)) >= 0.6 * 36),
g AS (SELECT recording_id, idx, idx - row_number() OVER (PARTITION BY recording_id ORDER BY idx) AS g FROM d)
SELECT recording_id, 'black' AS kind, min(idx) / 2 AS "start", max(idx) / 2 + 0.5 AS "end", max(idx) / 2 + 0.5 - min(idx) / 2 AS duration FROM g GROUP BY recording_id, g HAVING max(idx) / 2 + 0.5 - min(idx) / 2 >= 0.5""",
    "long_recording_segments": f"""WITH RECURSIVE {_V}, w AS MATERIALIZED (SELECT vec_id::DOUBLE AS time, b, row_number() OVER (ORDER BY vec_id) AS i FROM v),
z AS (SELECT i, time, b AS anchor, 0 AS pos, 0 AS d FROM w WHERE i = 1
  UNION ALL SELECT i, time, CASE WHEN d > 30 THEN b ELSE anchor END, pos + (d > 30)::INT, CASE WHEN d > 30 THEN 0 ELSE d END
  FROM (SELECT w.i, w.time, w.b, z.anchor, z.pos, {_DIST.format('w.b', 'z.anchor')} AS d FROM z JOIN w ON w.i = z.i + 1)),
g AS (SELECT pos, min(time) AS "start", max(time) AS last, count(*)::INT AS sample_count, max(d) AS max_internal_distance FROM z GROUP BY pos)
SELECT 'all' AS recording_id, pos, "start", coalesce(lead("start") OVER (ORDER BY pos), last + 1) AS "end", sample_count, max_internal_distance FROM g""",
    "page_slugs": """WITH RECURSIVE n AS MATERIALIZED (SELECT page_id, row_number() OVER (ORDER BY page_id) AS i,
  regexp_extract(coalesce(url, ''), '://([^/]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '-2' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '-3' ELSE '' END AS name FROM pages),
b AS MATERIALIZED (SELECT page_id, i, CASE WHEN s = '' THEN 'recording' ELSE s END AS base FROM (SELECT *, regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM n)),
z AS (SELECT 0::BIGINT AS i, 0::BIGINT AS page_id, ''::VARCHAR AS slug, []::VARCHAR[] AS taken
  UNION ALL SELECT i, page_id, slug, list_append(taken, slug) FROM (SELECT b.i, b.page_id, taken, CASE WHEN NOT list_contains(taken, base) THEN base ELSE
    base || '-' || list_filter(range(2, b.i + 2), lambda k: NOT list_contains(taken, base || '-' || k))[1] END AS slug FROM z JOIN b ON b.i = z.i + 1))
SELECT page_id, slug FROM z WHERE i > 0""",
}
