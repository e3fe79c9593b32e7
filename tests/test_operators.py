"""Operators, sources and streams against plain statements of their rules."""

import json
import random

import numpy as np
import pytest

from tests.fixtures import A, B, Build, picture
from tidemark import timeline as tl
from tidemark.functions import hashing, scalar
from tidemark.operators import levels, overlap, quality, runs, spectral, states
from tidemark.plans import comparison
from tidemark.reporting import documents, texts
from tidemark.sources import logs, media, probe
from tidemark.streaming import signals as streams
from pyspark.sql import functions as F

LEVELS = "recording_id string, start_ms bigint, start double, end double, rms_db double"


def plain_dropouts(env):
    out, i = [], 0
    while i < len(env):
        if not env[i] <= -45:
            i += 1
            continue
        j = i
        while j < len(env) and env[j] <= -45:
            j += 1
        before, after = env[max(0, i - 4) : i], env[j : j + 4]
        if 0.4 <= (j - i) / 2 <= 6 and before and after and all(x > -35 for x in before + after):
            out.append((i / 2, j / 2))
        i = j
    return out


def test_dropouts_equal_a_plain_loop_on_random_levels(spark):
    rnd, rows, want = random.Random(1), [], []
    for k in range(60):
        env = [rnd.choice([-20.0, -34.9, -35.0, -45.0, -60.0, -20.0, -20.0]) for _ in range(40)]
        rows += [(str(k), i * 500, i / 2, i / 2 + 0.5, v) for i, v in enumerate(env)]
        want += [(str(k), *x) for x in plain_dropouts(env)]
    got = runs.dropouts(spark.createDataFrame(rows, LEVELS)).select("recording_id", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_rollbacks_equal_a_greedy_scan(spark):
    rnd, rows, want = random.Random(2), [], []
    for k in range(80):
        ids = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 14))]
        rows += [(str(k), i, float(i), i + 1.0, s) for i, s in enumerate(ids)]
        i = 0
        while i <= len(ids) - 3:
            hit = ids[i] == ids[i + 2] != ids[i + 1]
            if hit:
                want.append((str(k), i, i + 3 < len(ids) and ids[i + 3] == ids[i + 1]))
            i += 2 if hit else 1
    got = states.rollbacks(spark.createDataFrame(rows, "recording_id string, pos int, start double, end double, state_id int"))
    assert sorted(map(tuple, got.select("recording_id", "pos", "repeat").collect())) == sorted(want) and want


def plain_states(frames, stable, match):
    dist = lambda a, b: sum((x ^ y).bit_count() if (x ^ y) >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(a[0], b[0])) + (a[1] ^ b[1]).bit_count()
    segments, known, out = [], [], []
    for i, f in enumerate(frames):
        if not segments or dist(segments[-1][1], f) > stable:
            segments.append([i, f])
    for i, f in segments:
        d = [dist(f, k) for k in known]
        if d and min(d) <= match:
            best = d.index(min(d))
            known[best] = f
        else:
            best = len(known)
            known.append(f)
        out.append((i / 2, best))
    return out


def test_states_equal_a_plain_loop(spark):
    rnd, b, want = random.Random(3), Build(), []
    for k in range(12):
        pool = [([rnd.getrandbits(63) for _ in range(16)], rnd.randint(0, 31)) for _ in range(4)]
        frames = []
        for _ in range(60):
            h, u = rnd.choice(pool) if not frames or rnd.random() < 0.2 else frames[-1]
            h = list(h)
            for _ in range(rnd.randint(0, 20)):
                h[rnd.randint(0, 15)] ^= 1 << rnd.randint(0, 62)
            frames.append((h, u))
        b.frames(str(k), frames)
        want += [(str(k), *x) for x in plain_states(frames, 24, 48)]
    frames = b.signals(spark).frame_samples
    got = states.online_states(states.anchor_segments(frames)).select("recording_id", "start", "state_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_overlap_is_strict_and_false_without_rows(spark):
    left = spark.createDataFrame([("r", 1.0, 2.0), ("r", 2.0, 3.0), ("x", 0.0, 9.0)], "recording_id string, start double, end double")
    right = spark.createDataFrame([("r", 0.0, 1.0, True), ("r", 2.9, 50.0, True), ("r", 1.2, 1.3, False)], "recording_id string, start double, end double, hit boolean")
    got = overlap.overlap_any(left, right, F.col("hit"), 2.0).orderBy("recording_id", "start").collect()
    assert [x["any"] for x in got] == [False, True, False]


def test_spectral_windows_equal_whole_transform(spark):
    rate = 2000
    x = (np.sin(np.arange(5000) * 2 * np.pi * 440 / rate) * 12000).astype(np.int16)
    rows = [("t", i // 700, rate, x[i : i + 700].tolist()) for i in range(0, 5000, 700)]
    d = spark.createDataFrame(rows, "recording_id string, block int, sample_rate int, samples array<smallint>")
    got = spectral.spectral_windows(d, rate, low=100, high=900).orderBy("time").collect()
    assert [r.time for r in got] == [i * 0.25 for i in range(9)]
    assert all(r.dominant_freq == 440 and r.concentration > 0.9 for r in got)
    runs_ = runs.peak_runs(spark.createDataFrame(got)).collect()
    assert [(r.start, r.end) for r in runs_] == [(0.0, 2.25)]


def test_envelopes(spark):
    rows = [("r", c, i / 100, v) for i in range(100) for c, v in ((1, 0.5 if i < 50 else 0.0), (2, 1.0))]
    d = spark.createDataFrame(rows, "recording_id string, channel int, time double, value double")
    e = levels.level_envelope(d.where("channel = 1")).orderBy("idx").collect()
    assert [round(x.rms_db, 2) for x in e] == [-6.02, -120.0] and [x.end for x in e] == [0.5, 1.0]
    c = levels.channel_envelope(d).orderBy("idx").collect()
    assert round(c[0].channel_rms_db[1], 2) == -6.02 and c[1].channel_rms_db == {1: -120.0, 2: 0.0}


def test_logs(spark):
    def lines(*text):
        return spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "recording_id string, line_no int, line string")

    d = logs.black_segments(lines("x", "[b] black_start:3 black_end:4.0 black_duration:1"))
    assert [tuple(x) for x in d.collect()] == [("r", "black", 3.0, 4.0, 1.0)]
    d = logs.freeze_segments(lines("freeze_start: 0", "freeze_duration: 3", "freeze_end: 3", "freeze_start: 5.5"))
    assert [tuple(x)[2:] for x in d.collect()] == [(0.0, 3.0, 3.0)]
    d = logs.silence_segments(lines("silence_start: -0.01", "silence_end: 1 | silence_duration: 1.01", "silence_start: 4"))
    assert [tuple(x)[2:] for x in d.collect()] == [(-0.01, 1.0, 1.01)]
    text = ("lavfi.astats.Overall.RMS_level=-9", "frame:0 pts:0 pts_time:0", "lavfi.astats.Overall.RMS_level=-20.5", "lavfi.astats.Overall.Peak_level=-inf", "lavfi.astats.1.RMS_level=-3", "frame:1 pts:8 pts_time:0.5", "lavfi.astats.2.RMS_level=x")
    w = logs.level_windows(lines(*text)).orderBy("idx").collect()
    assert [(x.start, x.rms_db, x.peak_db, x.flat_factor) for x in w] == [(0.0, -20.5, -120.0, 0.0), (0.5, -120.0, -120.0, 0.0)]
    c = logs.channel_windows(lines(*text)).orderBy("start").collect()
    assert [x.channel_rms_db for x in c] == [{1: -3.0}, {2: -120.0}]


def test_probe(spark):
    doc = {"format": {"duration": "8.5", "bit_rate": "x", "format_name": "mp4"}, "streams": [{"codec_type": "video", "width": 320, "height": 240, "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1"}, {"codec_type": "audio", "channels": 2}]}
    other = {"format": {}, "streams": [{"codec_type": "video", "avg_frame_rate": "0/0", "r_frame_rate": "25/1"}]}
    d = spark.createDataFrame([("a", "/a", json.dumps(doc)), ("b", "/b", json.dumps(other)), ("c", "/c", "nope")], "recording_id string, path string, json string")
    a, b, c = probe.recordings(d).orderBy("recording_id").collect()
    assert (a.duration, a.bitrate, a.resolution, round(a.frame_rate, 3), a.channels, a.has_audio) == (8.5, None, "320x240", 29.97, 2, True)
    assert (b.duration, b.frame_rate, b.has_audio, b.channels) == (0.0, None, False, 0)
    assert c.error and not c.has_video


def test_raw_frames(spark, tmp_path):
    frame = bytes([0] * 512 + [200] * 512)
    (tmp_path / "clip.gray").write_bytes(frame * 3 + bytes(1024) + b"cut")
    px = media.frame_pixels(media.raw_files(spark, str(tmp_path)))
    got = media.frame_samples(px).orderBy("idx").collect()
    assert [x.time for x in got] == [0.0, 0.5, 1.0, 1.5] and got[0].recording_id == "clip"
    assert got[0].hash == [0] * 8 + [-1] * 8 and got[0].bucket == 12 and got[3].bucket == 0 and got[3].hash == [-1] * 16
    act = states.visual_activity(media.frame_samples(px)).orderBy("time").collect()
    assert [x.distance for x in act] == [0, 0, 512 + 2]
    black = media.measured_segments(media.black_frames(px), "black", 0.1).collect()
    assert [(x.start, x.end) for x in black] == [(1.5, 2.0)]
    still = media.measured_segments(media.still_frames(px), "freeze", 0.5).collect()
    assert [(x.start, x.end) for x in still] == [(0.5, 1.5)]
    (tmp_path / "pcm").mkdir()
    (tmp_path / "pcm/s.raw").write_bytes(np.arange(-3, 4, dtype="<i2").tobytes() + b"x")
    blocks = media.pcm_blocks(media.raw_files(spark, str(tmp_path / "pcm")), rate=2, block=4)
    assert [x.value * 32768 for x in media.block_samples(blocks).orderBy("time").collect()] == list(range(-3, 4))
    with pytest.raises(media.ToolMissing):
        media.media_tool("no-such-tool-here")


def test_scalars(spark):
    d = spark.createDataFrame([(0.0005, "a b/ü.mp4", " -INF "), (3661.0015, "__", "x"), (360000.0, "ok-1", "-3.5")], "s double, n string, v string")
    got = d.select(scalar.timestamp_text(F.col("s")), scalar.slug(F.col("n")), scalar.decibels(F.col("v"))).collect()
    assert [tuple(x) for x in got] == [("00:00:00.000", "a_b_.mp4", -120.0), ("01:01:01.002", "recording", -120.0), ("100:00:00.000", "ok-1", -3.5)]
    assert scalar.unique_slugs(["x", "x-2", "x", "x"]) == ["x", "x-2", "x-3", "x-4"]
    assert documents.clock(3661.0015) == "01:01:01.002"
    assert texts.label("ui", "title", "fr") == "Event Recording Audit" and texts.label("ui", "zz", "ja") == "zz"


def test_comparison(spark):
    info = {f: "x" for f in quality.FIELDS} | {"path": "/s", "duration": 8.50004, "bitrate": 5, "frame_rate": 25.0}
    pairs = spark.createDataFrame([("same", info, info | {"duration": 8.5}), ("bad", info, info | {"resolution": "160x120"}), ("none", info, info | {"pix_fmt": None})], "pair_id string, " + ", ".join(f"{s} struct<path:string,resolution:string,frame_rate:double,codec_name:string,pix_fmt:string,bits_per_raw_sample:string,color_space:string,color_transfer:string,bitrate:bigint,duration:double>" for s in ("source", "export")))
    m = spark.createDataFrame([("same", 0.99, 45.0, 40.0, "160x120"), ("bad", 0.80, 25.0, 20.0, "160x120")], "pair_id string, ssim_avg double, psnr_avg_db double, psnr_min_db double, resolution string")
    got = {x.pair_id: x for x in comparison.compare(pairs, m).collect()}
    assert got["same"].conclusion == "source_degradation_already_present" and got["same"].changed_fields == []
    assert got["bad"].conclusion == "additional_downstream_degradation" and got["bad"].changed_fields == ["resolution"]
    assert got["none"].conclusion == "inconclusive" and got["none"].changed_fields == ["pix_fmt"] and len(got["none"].limitations) == 2
    assert "SSIM (export vs. source, compared at 160x120): 0.99." in got["same"].reasoning
    assert json.loads(comparison.as_json(comparison.compare(pairs, None)).first().json)["conclusion"] == "inconclusive"


def test_frame_quality(spark):
    rows = [(f, p, v, v + (10 if f == 1 else 0)) for f in range(2) for p, v in enumerate(range(0, 200, 2))]
    d = spark.createDataFrame([("k", f, p, float(a), float(b)) for f, p, a, b in rows], "k string, frame int, pixel int, a double, b double")
    r = quality.frame_quality(d, ["k"]).first()
    assert round(r.psnr_min_db, 3) == round(10 * np.log10(255**2 / 100), 3) and round(r.psnr_avg_db, 3) == round(10 * np.log10(255**2 / 50), 3) and 0.98 < r.ssim_avg < 1
    same = quality.frame_quality(d.withColumn("b", F.col("a")), ["k"]).first()
    assert same.psnr_avg_db == float("inf") and round(same.ssim_avg, 9) == 1


def test_evidence_rows(spark):
    plan = spark.createDataFrame([("r", 1, 1.0, 0.5, 1.0)], "recording_id string, incident int, event_at double, clip_start double, clip_length double")
    frames = Build().frames("r", [A, B, A, picture(3)]).signals(spark).frame_samples
    assert [x.frame_idx for x in tl.nearest_frames(plan, frames, "event_at").collect()] == [2]
    assert sorted(x.idx for x in tl.clip_rows(frames, plan, "time").collect()) == [1, 2, 3]


def test_streams(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", t0 + dt.timedelta(milliseconds=100 * i), 0.5 if i < 5 else 0.0) for i in range(10)] + [("r", t0 + dt.timedelta(minutes=1), 1.0)]
    d = spark.createDataFrame(rows, "recording_id string, ts timestamp, value double")
    d.write.parquet(str(tmp_path / "in"))
    s = streams.level_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM levels ORDER BY start").collect()
    assert [round(x.rms_db, 2) for x in got] == [-6.02, -120.0]
    f = Build().frames("r", [A] * 3 + [B] * 2 + [A]).signals(spark).frame_samples
    f.coalesce(1).write.parquet(str(tmp_path / "frames"))
    s = streams.segment_stream(spark.readStream.schema(f.schema).parquet(str(tmp_path / "frames")))
    q = s.writeStream.format("memory").queryName("segs").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [(x.start, x.end, x.sample_count) for x in spark.sql("SELECT * FROM segs ORDER BY start").collect()] == [(0.0, 1.5, 3), (1.5, 2.5, 2)]


def test_distances(spark):
    d = spark.createDataFrame([([0, -1], [0, 0], 15, 16)], "a array<bigint>, b array<bigint>, x int, y int")
    assert d.select(hashing.frame_distance(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).first()[0] == 64 + 5
