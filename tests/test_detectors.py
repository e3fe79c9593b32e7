"""Detectors and analysis over made-up recordings, with events worked out by hand from the rules."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.fixtures import A, B, Build, picture
from tidemark import detectors as d
from tidemark import timeline as tl
from tidemark.detectors.base import Signals
from tidemark.plans.analysis import analyze, batch_index, all_failed, build_detectors
from tidemark.reporting import documents


def found(spark, build, *chosen, **options):
    r = analyze(build.signals(spark), chosen=list(chosen) or None, **options)
    return tl.ordered(r.events).collect(), [x.limitation for x in r.limitations.collect()]


def brief(rows):
    return [(x.start, x.end, x.type, x.severity, x.confidence) for x in rows]


PREMATURE = [A] * 6 + [B] + [A] * 4 + [B] * 6


def test_premature_slide_with_freezes_gives_the_four_findings(spark):
    b = Build().recording("r", 8.5).frames("r", PREMATURE).segment("r", "freeze", 0, 3).segment("r", "freeze", 3.5, 5.5)
    rows, _ = found(spark, b)
    assert brief(rows) == [
        (0.0, 3.0, "freeze", "medium", "medium"),
        (3.0, 3.5, "brief_unexpected_slide", "medium", "low"),
        (3.0, 5.5, "slide_rollback_pattern", "medium", "medium"),
        (3.5, 5.5, "freeze", "medium", "medium"),
    ]
    m = rows[2].measurements
    assert m.sequence == [0, 1, 0, 1] and m.confirmed_repeat and m.sequence_durations == [3.0, 0.5, 2.0, 3.0]
    assert rows[1].measurements.previous_state == 0 and rows[1].measurements.next_state == 0
    assert rows[0].observations == ["Video showed no measurable change for 3.00s."]
    assert len({x.id for x in rows}) == 4 and all(len(x.id) == 12 for x in rows)


def test_missed_title_is_less_sure(spark):
    rows, _ = found(spark, Build().recording("r", 5.5).frames("r", [B] * 6 + [A] + [B] * 4))
    assert brief(rows) == [(3.0, 3.5, "brief_unexpected_slide", "medium", "low"), (3.0, 5.5, "slide_rollback_pattern", "medium", "low")]


def test_what_is_no_presentation_is_gated_with_a_reason(spark):
    b = Build().recording("tall", 12, width=360, height=640).frames("tall", ([A] * 4 + [B] * 4) * 3)
    b.recording("restless", 5).frames("restless", [picture(i * 5) if i % 2 else B for i in range(10)])
    rows, limits = found(spark, b, d.SlideRollback(), d.BriefSlide())
    assert not rows
    assert sum("landscape" in x for x in limits) == 2 and sum("slide-like" in x for x in limits) == 2


def test_dropouts(spark):
    b = Build()
    loud, quiet = [-20] * 4, [-120] * 2
    for name, levels in {"gap": loud + quiet + loud, "end": loud + quiet, "long": loud + [-120] * 13 + loud, "nan": [-20, -20, float("nan"), -20, *quiet, *loud], "edge": loud + [-45.0] + loud, "near": loud + [-44.9] + loud, "context": loud + [-35.0] + quiet + loud}.items():
        b.recording(name, 20, has_video=False, has_audio=True, channels=1).levels(name, levels)
    rows, limits = found(spark, b, d.Dropout())
    assert [(x.recording_id, x.start, x.end, x.severity) for x in rows] == [("edge", 2.0, 2.5, "medium"), ("gap", 2.0, 3.0, "medium")]
    assert rows[1].observations[0] == "Audio level dropped to near-silence (-120.0 dBFS or below) for 1.00s."
    short = Build().recording("s", 9, has_video=False, has_audio=True).levels("s", loud + quiet[:1] + loud, window=0.3)
    assert not found(spark, short, d.Dropout())[0]


def test_clipping_channels_and_bands(spark):
    b = Build().recording("clip", 2, has_video=False, has_audio=True, channels=2).levels("clip", [-3] * 4, peak=0.0, flat=5.0).channels("clip", [(-20, -120)] * 4)
    b.recording("fine", 2, has_video=False, has_audio=True, channels=2).levels("fine", [-3] * 4).channels("fine", [(-20, -21)] * 4)
    b.recording("imb", 2, has_video=False, has_audio=True, channels=2).channels("imb", [(-20, -35)] * 4)
    b.recording("split", 4, has_video=False, has_audio=True, channels=2).channels("split", [(-20, -60), (-20, -60), (-20, -40), (-20, -40)], window=1.0)
    b.recording("mono", 2, has_video=False, has_audio=True, channels=1)
    rows, limits = found(spark, b, d.Clipping(), d.ChannelImbalance())
    assert [(x.recording_id, x.start, x.end, x.type, x.severity, x.confidence) for x in rows] == [
        ("clip", 0.0, 2.0, "clipping", "medium", "high"),
        ("clip", 0.0, 2.0, "channel_missing", "medium", "medium"),
        ("imb", 0.0, 2.0, "channel_imbalance", "low", "low"),
        ("split", 0.0, 2.0, "channel_missing", "medium", "medium"),
        ("split", 2.0, 4.0, "channel_imbalance", "low", "low"),
    ]
    assert rows[1].measurements.channel_rms_db[2] < -90
    assert any("input has 1 audio channel(s)" in x for x in limits)


@pytest.mark.parametrize(("levels", "length", "grade"), [([-20] * 20, 3, ("low", "low")), ([-80] * 20, 3, ("medium", "medium")), ([-80] * 20, 6, ("high", "high")), (None, 6, ("high", "medium"))])
def test_freezes_are_judged_by_the_sound(spark, levels, length, grade):
    b = Build().recording("r", 10, has_audio=levels is not None, channels=2).segment("r", "freeze", 1, 1 + length)
    rows, _ = found(spark, b.levels("r", levels) if levels else b, d.Freeze())
    assert [(x.severity, x.confidence) for x in rows] == [grade]


def test_blackouts_by_duration(spark):
    b = Build().recording("r", 10)
    for start, length in ((0, 0.09), (1, 0.1), (2, 0.5), (4, 2.0)):
        b.segment("r", "black", start, start + length)
    rows, _ = found(spark, b, d.Blackout())
    assert [x.severity for x in rows] == ["low", "medium", "high"]


def test_progression(spark):
    b = Build().recording("q", 40, has_audio=True, channels=1).frames("q", [A] * 80).levels("q", [-120] * 80)
    rows, _ = found(spark, b, d.ProgressionInterruption())
    assert brief(rows) == [(0.0, 42.0, "progression_interruption", "medium", "medium")]
    assert brief(found(spark, b, d.ProgressionInterruption(least=10))[0])[0][3] == "high"
    assert found(spark, b, d.ProgressionInterruption(clamp_end=True))[0][0].end == 40.0
    b.levels("q", [-120] * 80)
    noise = Build().recording("q", 40, has_audio=True, channels=1).frames("q", [A] * 80).levels("q", [-120] * 40 + [-39] + [-120] * 39)
    assert not found(spark, noise, d.ProgressionInterruption())[0]


def test_feedback(spark):
    b = Build().recording("f", 3, has_video=False, has_audio=True).spectral("f", [(i / 4, 1000, 0.7, 0.1) for i in range(6)])
    b.recording("jump", 3, has_video=False, has_audio=True).spectral("jump", [(i / 4, 1000 + 100 * (i > 2), 0.7, 0.1) for i in range(6)])
    rows, _ = found(spark, b, profile="technical", feedback=True)
    assert [(x.recording_id, x.start, x.end, x.severity, x.confidence) for x in rows] == [("f", 0.0, 1.5, "medium", "medium")]
    assert rows[0].observations == ["A narrow-band spectral peak near 1000 Hz persisted for 1.50s.", "Peak-band energy concentration reached 70% of total in-band energy."]


def test_profiles():
    names = [x.name for x in build_detectors("full")]
    assert names == ["blackout", "freeze", "clipping", "channel_imbalance", "progression_interruption", "audio_dropout", "slide_rollback_pattern", "brief_unexpected_slide"]
    assert build_detectors("post_production") == []
    with pytest.raises(ValueError):
        build_detectors("none")


def test_reports_and_batch(spark, tmp_path):
    b = Build().recording("r", 8.5).frames("r", PREMATURE).recording("bad", 0, has_video=False, has_audio=False, error="can't read <it>")
    r = analyze(b.signals(spark))
    rendered = {x.recording_id: x for x in documents.reports(r, "ja").collect()}
    assert "# 収録監査レポート" in rendered["r"].markdown and "スライド状態0が3.00秒間表示されました。" in rendered["r"].markdown
    assert '"total_events": 2' in rendered["r"].json and "Slide state 0" in rendered["r"].json
    assert "could not be probed" in rendered["bad"].json and "unknown" not in rendered["r"].html
    documents.write_reports(documents.reports(r), str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*.*")) == sorted(["report.json", "report.md", "report.html"] * 2)
    assert "Total findings:** 2 (high: 0, medium: 2, low: 0)" in (tmp_path / "r/report.md").read_text()
    index = batch_index(r)
    rows = documents.index_rows(index, {})
    assert [(x["recording_id"], x["ok"], x["total"]) for x in rows] == [("bad", False, None), ("r", True, 2)]
    assert "error: can't read <it>" in documents.index_markdown(rows) and "&lt;it&gt;" in documents.index_html(rows)
    assert not all_failed(index)
    plan = tl.evidence_plan(r.events).collect()
    assert [(x.incident, x.before_at, x.after_at, x.clip_start) for x in plan] == [(1, 2.0, 4.5, 1.5), (2, 2.0, 6.5, 1.5)]
    assert tl.summary(r.events).first().by_severity == {"low": 0, "medium": 2, "high": 0}
    assert tl.filtered(r.events, "presentation", "high").count() == 0
    assert "Observed:\n  - Slide state" in tl.explained(r.events).first().explanation


def test_evidence_and_command_line(spark, tmp_path):
    from tidemark import cli
    from tidemark.reporting.evidence import write_evidence

    b = Build().recording("r 1", 8.5).frames("r 1", PREMATURE).segment("r 1", "black", 0, 0.2)
    s = b.signals(spark)
    events = analyze(s).events

    def still(source, second):
        if second == 4.5:
            raise OSError("no such moment")
        return f"{source} {second}".encode()

    got = {x.type: x for x in write_evidence(events, str(tmp_path / "ev"), still=still).collect()}
    assert got["blackout"].evidence == {} and got["brief_unexpected_slide"].evidence == {"error": "no such moment"}
    e = got["slide_rollback_pattern"].evidence
    assert set(e) == {"before_frame", "event_frame", "after_frame", "metadata", "explanation"} and "incident-0003" in e["metadata"]
    assert '"evidence": {}' in open(e["metadata"]).read() and open(e["before_frame"]).read() == "/media/r 1.mp4 2.0"
    for name, d in s.tables.items():
        d.write.parquet(str(tmp_path / f"in/{name}.parquet"))
    assert cli.main(["batch", str(tmp_path / "in"), "--out-dir", str(tmp_path / "out"), "--lang", "ja"]) == 0
    assert "r_1/report.md" in (tmp_path / "out/index.md").read_text() and "explanation" in (tmp_path / "out/r_1/report.md").read_text()


def test_reports_are_made_one_recording_at_a_time(monkeypatch):
    """Reports don't pile up: what a task hands on at once is bounded, whatever comes in at once."""
    monkeypatch.setattr(documents, "HELD", 5000)
    event = {k: "x" for k in ("id", "category", "type", "severity", "confidence", "possible_interpretation", "detector")} | {"variant": "blackout", "observations": ["o"], "source_files": [], "evidence": [], "requires_human_review": True, "measurements": {"duration": 1.0, "channel_rms_db": None}}
    rows = []
    for i in range(60):
        rows.append({"recording_id": f"r{i}", "side": 0, "media": {"path": f"/{i}", "duration": 500.0, "width": 320, "height": None if i == 7 else 240}, "limitations": ["l"] if i % 2 else None, "event": None})
        rows += [{"recording_id": f"r{i}", "side": 1, "media": None, "limitations": None, "event": event | {"start": 1.0 * k, "end": k + 1.0, "duration": 1.0, "facts": [("duration", 1.0)]}} for k in range(i % 4 * 10)]
    texts = ("id", "category", "type", "severity", "confidence", "possible_interpretation", "detector", "variant")
    measured = pa.struct([("duration", pa.float64()), ("channel_rms_db", pa.map_(pa.int32(), pa.float64()))])
    of_event = pa.struct([*[(k, pa.string()) for k in texts], *[(k, pa.float64()) for k in ("start", "end", "duration")], *[(k, pa.list_(pa.string())) for k in ("observations", "source_files")], ("evidence", pa.map_(pa.string(), pa.string())), ("facts", pa.map_(pa.string(), pa.float64())), ("requires_human_review", pa.bool_()), ("measurements", measured)])
    media = pa.struct([("path", pa.string()), ("duration", pa.float64()), ("width", pa.int32()), ("height", pa.int32())])
    table = pa.Table.from_pylist(rows, pa.schema([("recording_id", pa.string()), ("side", pa.int32()), ("media", media), ("limitations", pa.list_(pa.string())), ("event", of_event)]))
    made = list(documents._handed_on(documents._rendered(iter(table.to_batches(max_chunksize=77)), ("en", "ja"))))
    size = lambda r: sum(len(r[c]) for c in ("json", "markdown", "html"))
    held = [b.to_pylist() for b in made]
    assert all(sum(map(size, x[:-1])) < 5000 for x in held) and len(held) > 30
    got = {(r["recording_id"], r["lang"]): r for x in held for r in x}
    assert len(got) == sum(map(len, held)) == 120
    for i in range(60):
        own = json.loads(got[f"r{i}", "en"]["json"])
        assert [e["start"] for e in own["events"]] == [1.0 * k for k in range(i % 4 * 10)] and own["limitations"] == ["l"] * (i % 2)
        assert own["media"]["resolution"] == (None if i == 7 else [320, 240]) and got[f"r{i}", "ja"]["markdown"].count("\n### ") == i % 4 * 10


def test_a_task_runs_one_detector(spark):
    """Parts that lie by the same key are not lined up, else a task holds what all detectors sort."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # tables that Spark can't see to be empty or small
        rows = spark.range(8).select(F.col("id").cast("string").alias("recording_id"), (F.col("id") * 1.0).alias("start"), (F.col("id") + 5.0).alias("end"))
        s = Signals(spark, {
            "recordings": rows.select("recording_id", F.lit("/p").alias("path"), F.lit(9.0).alias("duration"), F.lit(True).alias("has_video"), F.lit(True).alias("has_audio"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit(2).alias("channels"), F.lit(25.0).alias("frame_rate"), F.lit(None).cast("string").alias("error")),
            "measured_segments": rows.select("recording_id", F.lit("black").alias("kind"), "start", "end", (F.col("end") - F.col("start")).alias("duration")),
        })
        found = analyze(s, chosen=[d.Blackout()] * 3)
        one = analyze(s, chosen=[d.Blackout()])
        many, few = (x.events.select("recording_id", "severity").rdd.getNumPartitions() for x in (found, one))
        assert many == 3 * few
        assert found.events.count() == 24
    finally:
        for k in conf:
            spark.conf.unset(k)
