"""Files that are read by ranges give what they give as a whole."""

import random

import pytest

from tidemark.sources import logs, media, raw


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


@pytest.fixture
def captures(tmp_path):
    rng = random.Random(7)
    for name, n in (("a.pcm", 1000), ("b.x.pcm", 37), ("odd.pcm", 101), ("empty.pcm", 0)):
        write(tmp_path / "pcm", name, bytes(rng.randrange(256) for _ in range(n)))
    write(tmp_path / "pcm", "_SUCCESS", b"")
    write(tmp_path / "pcm", ".hidden", b"1234")
    return str(tmp_path / "pcm")


def plain(reader):
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("split", [1, 64, 10_000])
def test_samples_equal_whole_files(spark, captures, split):
    want = {(r.recording_id, r.block, tuple(r.samples)) for r in media.pcm_blocks(media.raw_files(spark, captures + "/[abo]*"), block=16).collect()}
    got = raw.read_raw(spark, captures, "samples", block=16, split=split).collect()
    assert {(r.recording_id, r.block, tuple(r.samples)) for r in got} == want and len(got) == len(want)
    assert all(r.first == 16 * r.block and r.sample_rate == 22050 for r in got)


@pytest.mark.parametrize("split", [1, 100, 10_000])
def test_frames_equal_whole_files(spark, captures, split):
    want = {(r.recording_id, r.idx, r.time, bytes(r.pixels)) for r in media.frame_pixels(media.raw_files(spark, captures + "/[abo]*"), grid=4).collect()}
    got = raw.read_raw(spark, captures, "frames", width=4, height=4, split=split).collect()
    assert {(r.recording_id, r.idx, r.time, bytes(r.pixels)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("split", [1, 2, 3, 7, 50, 100_000])
@pytest.mark.parametrize("read", [1, 5, 1 << 20])
def test_lines_at_all_ranges(tmp_path, monkeypatch, split, read):
    monkeypatch.setattr(raw, "READ", read)
    texts = {"log.txt": "one\r\ntwo\n\n\nthrée\nlast", "end.txt": "a\nb\n", "nl.txt": "\n", "long.txt": "x" * 90 + "\ny"}
    for n, t in texts.items():
        write(tmp_path / "logs", n, t.encode())
    got = plain(raw.RawReader({"path": str(tmp_path / "logs"), "kind": "lines", "split": str(split)}))
    want = []
    for n, t in texts.items():
        at = 0
        for line in t.encode().split(b"\n")[: -1 if t.endswith("\n") else None]:
            want.append((n[:-4], at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
    assert sorted((r["recording_id"], r["line_no"], r["line"]) for r in got) == sorted(want)


def test_log_lines_feed_the_parsers(spark, tmp_path):
    text = "".join(f"[silencedetect] silence_start: {i}.5\n[silencedetect] silence_end: {i}.75 | silence_duration: 0.25\n" for i in range(200))
    write(tmp_path / "s", "rec.log", text.encode())
    lines = raw.read_raw(spark, str(tmp_path / "s"), "lines", split=300)
    assert lines.rdd.getNumPartitions() > 20
    assert [(r.start, r.end) for r in logs.silence_segments(lines).orderBy("start").collect()] == [(i + 0.5, i + 0.75) for i in range(200)]


def test_a_file_of_four_gigabytes_is_read_by_many(tmp_path):
    big = tmp_path / "big.pcm"
    with open(big, "wb") as f:
        f.truncate((4 << 30) + 6)
        f.seek((4 << 30))
        f.write(b"\x01\x00\x02\x00\x03\x00")
    reader = raw.RawReader({"path": str(big), "kind": "samples"})
    parts = reader.partitions()
    assert len(parts) == 33 and [p.start for p in parts[1:]] == [p.end for p in parts[:-1]] and (parts[0].start, parts[-1].end) == (0, (4 << 30) + 6)
    assert all(p.start % reader.unit == 0 for p in parts)
    last = [r for b in reader.read(parts[-1]) for r in b.to_pylist()]
    assert [(r["first"], r["samples"]) for r in last] == [(2 << 30, [1, 2, 3])]
    assert sum(len(b.column("samples").flatten()) for b in reader.read(parts[7])) == (128 << 20) // 2


def test_wrong_options(spark, tmp_path):
    with pytest.raises(Exception, match="kind must be"):
        raw.RawReader({"path": "x", "kind": "film"})
    with pytest.raises(FileNotFoundError):
        raw.RawReader({"path": str(tmp_path / "none")}).partitions()
    (tmp_path / "empty").mkdir()
    assert raw.RawReader({"path": str(tmp_path / "empty")}).partitions() == []
    assert raw.file_system(f"file://{tmp_path}")[1] == str(tmp_path)
