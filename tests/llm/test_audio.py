"""Audio features: lossless storage, the resampler against plain convolution, segments against a plain loop."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import audio

DOCS = "doc_id long, text string"


def test_storage_is_lossless_and_digests_are_those_of_the_stored_bytes(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "日本🤦" * 5000, "a"]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in audio.audio_features(d).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and audio.from_wav(bytes(r.media)) == data
        tensors = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert tensors["mel"].type.shape == [64, 32] and tensors.num_rows == -(-int(r.feature.split(";")[0]) // 64)
        assert tensors["start"][0].as_py() == 0 and tensors["end"][-1].as_py() <= len(data) / 16000 + 0.03
    assert got[2].feature == got[7].feature and got[0].feature == got[1].feature
    assert audio.audio_features(spark.createDataFrame([], DOCS), keep=()).count() == 0


@pytest.mark.parametrize(("rate", "target"), [(16000, 8000), (16000, 11025), (8000, 16000), (16000, 16000)])
def test_resampling_equals_convolution(rate, target):
    a = audio.Analyzer(audio.Settings(rate=rate, target=target))
    x = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    up = np.zeros(len(x) * a.up)
    up[:: a.up] = (x.astype(float) - 128) / 128
    want = np.convolve(up, a.filter)[a.half :][:: a.down]
    for first, last in ((0, 50), (100, 400), (len(want) - 700, len(want) - 600)):
        assert np.abs(a.resampled(x, first, last) - want[first:last]).max() < 1e-5


def test_long_clips_in_parts_equal_one_part(monkeypatch):
    a = audio.Analyzer(audio.Settings())
    data = audio.payload("hello world, some text. " * 3000)
    whole = a.run(data)
    monkeypatch.setattr(audio, "AT_ONCE", 128)
    parts = a.run(data)
    x, y = (pa.ipc.open_stream(t[0]).read_all() for t in (whole, parts))
    assert np.allclose(x["mel"].combine_chunks().storage.flatten(), y["mel"].combine_chunks().storage.flatten(), atol=1e-4)
    assert whole[1:] == parts[1:] and x["start"].to_pylist() == y["start"].to_pylist()


def test_filterbank_equals_plain_sums():
    s = audio.Settings()
    a, x = audio.Analyzer(s), np.random.default_rng(3).integers(0, 256, 1152).astype(np.uint8)
    y = np.asarray(a.resampled(x, 0, 200), float)
    y = (y - y.mean()) * np.hanning(200)
    k, t = np.arange(129)[:, None], np.arange(200)[None, :]
    power = (y * np.cos(2 * np.pi * k * t / 256)).sum(1) ** 2 + (y * np.sin(2 * np.pi * k * t / 256)).sum(1) ** 2
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(4000), 34) / 2595) - 1)
    want = []
    for low, top, high in zip(edges, edges[1:], edges[2:]):
        share = [max(0, min((f - low) / (top - low), (high - f) / (high - top))) for f in np.arange(129) * 8000 / 256]
        want.append(np.log(np.dot(power, share) + 1e-6))
    got = pa.ipc.open_stream(a.run(x.tobytes())[0]).read_all()["mel"].combine_chunks().storage.flatten().to_numpy()[:32]
    assert np.abs(got - want).max() < 1e-3


def test_segments_keep_their_state_between_the_thresholds():
    a = audio.Analyzer(audio.Settings())
    e = np.random.default_rng(2).choice([-10.0, -18.0, -20.0, -24.0, -24.1, -40.0], 2000)
    want, on, start = [], False, 0
    for i, v in enumerate([*e, -99.0]):
        if not on and v >= -18:
            on, start = True, i
        elif on and v < -24:
            on = False
            if i - start >= 5:
                want.append((start, i))
    assert a.segments(e) == want and want


def test_frames_hold_every_sample(spark):
    a = audio.Analyzer(audio.Settings())
    for n in range(192, 192 * 40, 192):
        assert (a.frames(n) - 1) * 80 < max(n // 2 - 200, 0) + 80 and (a.frames(n) - 1) * 80 + 200 >= n // 2
    for n in (192, 576, 768, 1920, 4032):
        texts = ["ab" * (n // 2), "ab" * (n // 2 - 1) + "az", "ab" * (n // 2 - 1)]
        assert len({a.run(audio.payload(t))[0] for t in texts}) == 3
    d = spark.createDataFrame([(0, "ab" * 288), (1, "ab" * 287 + "az")], DOCS)
    assert len({r.feature for r in audio.audio_features(d, keep=()).collect()}) == 2
