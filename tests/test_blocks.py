"""Measurements from blocks of samples against plain scans, however samples are cut into blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import levels, silence, spectral
from tidemark.sources import media

BLOCK = "recording_id string, block int, sample_rate int, samples array<smallint>"


def cut(rec, x, size, rate=100):
    sizes = [size] * (len(x) // size + 1) if isinstance(size, int) else size
    out, at = [], 0
    for k, n in enumerate(sizes):
        out.append((rec, k, rate, x[at : at + n].tolist()))
        at += n
    return out + ([(rec, len(out), rate, x[at:].tolist())] if at < len(x) else [])


def waves(seed=0, n=2017):
    rng = np.random.default_rng(seed)
    x = rng.integers(-32768, 32768, n).astype(np.int16)
    for a in range(0, n, 90):
        x[a : a + int(rng.integers(0, 80))] = rng.choice([0, 20, -30])
    x[500:1100] = 3
    return x


SIZES = [1, 7, 64, 5000, [3, 0, 900, 1, 1, 600]]


def rounded(d, *columns):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in d.collect())


@pytest.mark.parametrize("size", SIZES)
def test_levels_equal_single_samples(spark, size):
    blocks = spark.createDataFrame(cut("a", waves(), size) + cut("b", waves(1, 333), 50) + [("none", 0, 100, []), ("null", 0, 100, None)], BLOCK)
    want = levels.level_envelope(media.block_samples(blocks), 0.5)
    columns = ("recording_id", "idx", "start_ms", "start", "end", "rms_db", "peak_db", "flat_factor")
    got = levels.block_levels(blocks, 0.5)
    assert got.columns == want.columns and rounded(got, *columns) == rounded(want, *columns)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("channels", [1, 2, 3])
def test_channel_levels_equal_single_samples(spark, channels):
    x = waves(2, 1001)
    blocks = spark.createDataFrame(cut("a", x, 70), BLOCK)
    single = [("a", i % channels + 1, (i // channels) / 100, float(v) / 32768) for i, v in enumerate(x.tolist())]
    want = levels.channel_envelope(spark.createDataFrame(single, "recording_id string, channel int, time double, value double"), 0.5)
    flat = lambda d: {r.idx: {k: round(v, 9) for k, v in r.channel_rms_db.items()} for r in d.collect()}
    assert flat(levels.block_channel_levels(blocks, channels, 0.5)) == flat(want)


def plain_silence(x, noise_db, least, rate=100):
    quiet = np.abs(x.astype(int)) <= int(np.floor(10 ** (noise_db / 20) * 32768))
    out, a = [], None
    for i, q in enumerate([*quiet.tolist(), False]):
        if q and a is None:
            a = i
        elif not q and a is not None:
            if i - a >= least * rate:
                out.append((a / rate, i / rate))
            a = None
    return out


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("least", [0.0, 0.3, 2.0])
def test_silence_equals_a_plain_scan(spark, size, least):
    x = waves(3)
    blocks = spark.createDataFrame(cut("a", x, size) + cut("quiet", np.zeros(640, np.int16), 64) + cut("loud", np.full(100, -32768, np.int16), 10), BLOCK).repartition(3)
    got = silence.silence_segments(blocks, -60.0, least).collect()
    want = {("a", *s) for s in plain_silence(x, -60.0, least)} | {("quiet", 0.0, 6.4)}
    assert {(r.recording_id, r.start, r.end) for r in got} == want and len(got) == len(want)
    assert all(r.kind == "silence" and r.duration == pytest.approx(r.end - r.start) for r in got)


def test_silence_ends_at_a_gap(spark):
    blocks = spark.createDataFrame([("a", 0, 10, 0, [0] * 10), ("a", 1, 10, 10, [0] * 10), ("a", 3, 10, 30, [0] * 10)], "recording_id string, block int, sample_rate int, first bigint, samples array<smallint>")
    assert [(r.start, r.end) for r in silence.silence_segments(blocks).orderBy("start").collect()] == [(0.0, 2.0), (3.0, 4.0)]
    assert silence.silence_segments(blocks.limit(0)).count() == 0


def plain_spectra(x, rate, window, hop, low, high):
    size, step = max(int(window * rate), 256), max(int(hop * rate), 1)
    freq = np.fft.rfftfreq(size, 1 / rate)
    band, out = (freq >= low) & (freq <= high), []
    for a in range(0, len(x) - size + 1, step):
        c = x[a : a + size] / 32768.0
        m = np.abs(np.fft.rfft(c * np.hanning(size)))[band]
        k = int(m.argmax())
        live = m.sum() > 1e-9
        out.append((a / rate, freq[band][k] if live else 0.0, m[max(0, k - 2) : k + 3].sum() / m.sum() if live else 0.0, np.sqrt((c * c).mean())))
    return out


@pytest.mark.parametrize("size", [33, 256, 10_000])
@pytest.mark.parametrize("span", [1, 3, 1024])
def test_spectra_equal_single_windows(spark, monkeypatch, size, span):
    monkeypatch.setattr(spectral, "SPAN", span)
    monkeypatch.setattr(spectral, "AT_ONCE", 2)
    x = waves(4, 3000)
    x[1000:1600] = 0
    blocks = spark.createDataFrame(cut("a", x, size) + cut("short", x[:200], 64), BLOCK)
    got = sorted((r.time, r.dominant_freq, r.concentration, r.rms) for r in spectral.spectral_windows(blocks, 1000, 0.3, 0.1, 100.0, 400.0).collect())
    np.testing.assert_allclose(got, plain_spectra(x, 1000, 0.3, 0.1, 100.0, 400.0), atol=1e-9)
