"""Files from tasks, clips as WAV files, and batches of folders at once."""

import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.fixtures import A, B, Build
from tidemark import cli, sinks
from tidemark.operators import clips


def tree(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names if not n.endswith(".crc")}


def test_files_by_path(spark, tmp_path):
    want = {f"r{i % 7}/deep {i}/ü.txt": bytes([i]) * i for i in range(60)} | {"top.bin": b""}
    d = spark.createDataFrame([(p, c) for p, c in want.items()] + [("none", None)], "path string, content binary").repartition(9)
    sinks.write_files(d, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == want | {"none": b""}
    sinks.write_files(spark.createDataFrame([("top.bin", "téxt")], "path string, content string"), f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == want | {"none": b"", "top.bin": "téxt".encode()}
    sinks.write_files(d.limit(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists() or tree(tmp_path / "empty") == {}


@pytest.mark.parametrize("bad", ["", "/etc/x", "a/../../x", "a//b", ".", "_temporary/x", None])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    d = spark.range(40).select(F.concat(F.lit("f"), "id").alias("path"), F.lit(b"x").alias("content")).repartition(4)
    d = d.withColumn("path", F.when(F.col("path") != "f17", F.col("path")).otherwise(F.lit(bad)))
    with pytest.raises(Exception, match="not a path below"):
        sinks.write_files(d, str(tmp_path / "out"))
    # a task that was being killed meanwhile may have left something where tasks write
    assert not (tmp_path / "out").exists() or set(os.listdir(tmp_path / "out")) <= {"_temporary"}


@pytest.mark.parametrize("size", [1, 10, 64, 5000])
@pytest.mark.parametrize("span", [16, 1 << 16])
def test_clips_equal_slices(spark, monkeypatch, size, span):
    monkeypatch.setattr(clips, "RANGE", span)
    x = np.random.default_rng(3).integers(-32768, 32768, 700).astype(np.int16)
    blocks = spark.createDataFrame([("a", k, 100, x[k * size : (k + 1) * size].tolist()) for k in range(-(-700 // size))] + [("b", 0, 100, [1, 2, 3])], "recording_id string, block int, sample_rate int, samples array<smallint>").repartition(3)
    plan = [("a", 1, 0.0, 0.5), ("a", 2, 1.234, 3.0), ("a", 3, 6.5, 9.0), ("a", 4, 8.0, 1.0), ("b", 1, 0.0, 5.0), ("c", 1, 0.0, 1.0), ("a", 5, -1.0, 1.5)]
    got = {(r.recording_id, r.incident): r for r in clips.wav_clips(blocks, spark.createDataFrame(plan, "recording_id string, incident int, clip_start double, clip_length double")).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("a", 5)}
    for rec, i, start, length in plan:
        if (rec, i) in got:
            source = x if rec == "a" else np.array([1, 2, 3], np.int16)
            want = source[max(0, int(np.floor(start * 100))) : int(np.floor((start + length) * 100))]
            with wave.open(io.BytesIO(bytes(got[rec, i].content))) as w:
                assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, 100)
                assert np.frombuffer(w.readframes(w.getnframes()), "<i2").tolist() == want.tolist()
            assert (got[rec, i].first, got[rec, i].n) == (max(0, int(np.floor(start * 100))), len(want))


def folders(spark, tmp_path):
    out = []
    for k in range(3):
        b = Build().recording(f"r {k}", 8.5).recording("same name", 4.0).frames(f"r {k}", [A] * 6 + [B] * 2 + [A] * 6)
        b.segment(f"r {k}", "black", 1, 4)
        for name, d in b.signals(spark).tables.items():
            d.write.parquet(str(tmp_path / f"in{k}/{name}.parquet"))
        out.append(str(tmp_path / f"in{k}"))
    # a folder whose table is no table
    (tmp_path / "broken/recordings.parquet").mkdir(parents=True)
    (tmp_path / "broken/recordings.parquet/part-0.parquet").write_bytes(b"nothing of the kind")
    return [out[0], str(tmp_path / "broken"), *out[1:]]


def test_concurrent_batches_give_the_same_index(spark, tmp_path):
    sources = folders(spark, tmp_path)
    for n in (1, 4):
        assert cli.main(["batch", *sources, "--out-dir", str(tmp_path / f"out{n}"), "--concurrency", str(n)]) == 0
    one, four = tree(tmp_path / "out1"), tree(tmp_path / "out4")
    assert one["index.md"] == four["index.md"] and one["index.html"] == four["index.html"]
    # evidence names its own place; all else is the same
    assert set(one) == set(four) and all(one[p].replace(b"/out1/", b"/out4/") == four[p] for p in one)
    lines = [r for r in one["index.md"].decode().splitlines() if r.startswith("| `")]
    assert [r.split("`")[1] for r in lines] == ["/media/r 0.mp4", "/media/same name.mp4", sources[1], "/media/r 1.mp4", "/media/same name.mp4", "/media/r 2.mp4", "/media/same name.mp4"]
    assert "same_name-3/report.md" in one["index.md"].decode() and "same_name-3/report.html" in one
    assert cli.main(["batch", sources[1], "--out-dir", str(tmp_path / "none")]) == 1
