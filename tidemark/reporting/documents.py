"""Reports of recordings as JSON, Markdown and HTML, and the index of a batch."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from html import escape
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.analysis import Result
from ..schema import SEVERITIES
from ..sinks import write_files
from .texts import LANGUAGES, label, told

#: Colours of the grades. Fixed values.
COLOURS = {"high": "#c0392b", "medium": "#b7791f", "low": "#6b7280"}

#: Rows of events that are looked at together, and characters of reports that are handed on together, at about.
AT_ONCE, HELD = 256, 1 << 22

_STYLE = "body{font:15px/1.5 sans-serif;margin:24px;color:#222}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 10px;text-align:left}.badge{color:#fff;border-radius:8px;padding:1px 8px}.finding{border:1px solid #ccc;padding:12px;margin:12px 0}.review{font-weight:bold}"


def clock(seconds: float) -> str:
    """HH:MM:SS.mmm, to the nearest millisecond."""
    ms = round(seconds * 1000)
    hours, ms = divmod(ms, 3_600_000)
    minutes, ms = divmod(ms, 60_000)
    return f"{hours:02d}:{minutes:02d}:{ms // 1000:02d}.{ms % 1000:03d}"


def _plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items() if v is not None}
    if hasattr(x, "tolist"):
        return x.tolist()
    return x


def event_dict(e: dict) -> dict:
    """An event as it stands in a report: times to three decimals, only what was measured."""
    out = {k: e[k] for k in ("id", "category", "type", "severity", "confidence", "possible_interpretation", "requires_human_review", "detector")}
    out |= {k: round(e[k], 3) for k in ("start", "end", "duration")}
    out |= {"observations": list(e["observations"]), "source_files": list(e["source_files"]), "evidence": _plain(dict(e["evidence"] or {}))}
    m = {k: dict(v) if k == "channel_rms_db" and v is not None else v for k, v in dict(e["measurements"]).items()}
    return out | {"measurements": _plain(m), "start_timestamp": clock(e["start"]), "end_timestamp": clock(e["end"])}


def counts(events: list[dict]) -> dict:
    by: dict[str, int] = {}
    for e in events:
        by[e["category"]] = by.get(e["category"], 0) + 1
    return {"total_events": len(events), "by_severity": {s: sum(e["severity"] == s for e in events) for s in SEVERITIES}, "by_category": by}


def json_report(media: dict, events: list[dict], limitations: list[str], extra: dict | None = None) -> str:
    """The whole report as a document; always in English. Entries of extra replace its own."""
    report = {"media": media, "summary": counts(events), "events": [event_dict(e) for e in events], "limitations": limitations} | (extra or {})
    return json.dumps(report, indent=2, ensure_ascii=False)


def _links(e: dict, folder: str | None) -> list[tuple[str, str]]:
    return [(k, os.path.relpath(p, folder) if folder else p) for k, p in dict(e["evidence"] or {}).items() if k != "error"]


def _texts(e: dict, language: str) -> tuple[list[str], str]:
    levels = dict(e["measurements"]).get("channel_rms_db")
    observations, interpretation = told(e["variant"], dict(e["facts"] or {}), dict(levels) if levels is not None else None, language)
    return observations, interpretation or label("ui", "no_interpretation", language)


def _head(media: dict, events: list[dict], language: str) -> tuple[str, str, dict]:
    duration = media.get("duration")
    return media.get("path") or label("ui", "unknown_file", language), clock(duration) if duration else label("ui", "unknown_duration", language), counts(events)["by_severity"]


def markdown_report(media: dict, events: list[dict], limitations: list[str], language: str = "en", folder: str | None = None) -> str:
    language = language if language in LANGUAGES else "en"
    t = lambda k: label("ui", k, language)
    path, duration, by = _head(media, events, language)
    grades = ", ".join(f"{label('severity', s, language)}: {by[s]}" for s in reversed(SEVERITIES))
    out = [f"# {t('title')}", "", f"**{t('file')}:** `{path}`  ", f"**{t('duration')}:** {duration}  ", f"**{t('total_findings')}:** {len(events)} ({grades})", "", f"## {t('timeline')}", ""]
    if events:
        out += ["| " + " | ".join(t(f"col_{c}") for c in ("time", "duration", "category", "severity", "confidence", "type")) + " |", "|---|---|---|---|---|---|"]
        out += [f"| {clock(e['start'])} - {clock(e['end'])} | {e['duration']:.2f}s | {label('category', e['category'], language)} | {label('severity', e['severity'], language)} | {label('confidence', e['confidence'], language)} | {e['type']} |" for e in events]
    else:
        out.append(t("no_findings"))
    out += ["", f"## {t('detailed_findings')}", ""]
    for e in events:
        observations, interpretation = _texts(e, language)
        out += [f"### {clock(e['start'])} - {clock(e['end'])} ({e['duration']:.2f}s) -- {label('severity', e['severity'], language).upper()} / {e['type']}", ""]
        out += [f"- **{t('col_category')}**: {label('category', e['category'], language)}", f"- **{t('col_confidence')}**: {label('confidence', e['confidence'], language)}", f"- **{t('detector')}**: {e['detector']}", "", f"**{t('observed')}:**"]
        out += [*[f"- {o}" for o in observations], "", f"**{t('possible_interpretation')}:** {interpretation}", ""]
        out.append(f"**{t('human_verification_required')}**" if e["requires_human_review"] else f"_{t('informational_entry')}_")
        if links := _links(e, folder):
            out += ["", f"**{t('evidence')}:** " + " · ".join(f"[{k}]({p})" for k, p in links)]
        out.append("")
    if not events:
        out.append(t("none"))
    if limitations:
        out += [f"## {t('limitations')}", "", *[f"- {x}" for x in limitations], ""]
    return "\n".join(out)


def _badge(severity: str, language: str) -> str:
    return f'<span class="badge" style="background:{COLOURS.get(severity, COLOURS["low"])}">{escape(label("severity", severity, language))}</span>'


def html_report(media: dict, events: list[dict], limitations: list[str], language: str = "en", folder: str | None = None) -> str:
    """A page that needs nothing but itself; every text in it is escaped."""
    language = language if language in LANGUAGES else "en"
    t = lambda k: escape(label("ui", k, language))
    path, duration, by = _head(media, events, language)
    cards = "".join(f"<li><b>{n}</b> {escape(name)}</li>" for name, n in [(label("ui", "total_findings", language), len(events)), *[(label("severity", s, language), by[s]) for s in reversed(SEVERITIES)]])
    rows = "".join(f'<tr><td>{clock(e["start"])}</td><td>{escape(label("category", e["category"], language))}</td><td>{_badge(e["severity"], language)}</td><td>{escape(label("confidence", e["confidence"], language))}</td><td>{escape(e["type"])}</td><td><a href="#finding-{escape(e["id"])}">{t("details")}</a></td></tr>' for e in events)
    parts = []
    for e in events:
        observations, interpretation = _texts(e, language)
        links = "".join(f'<a href="{escape(p)}">{escape(k)}</a> ' for k, p in _links(e, folder))
        parts.append(
            f'<div class="finding" id="finding-{escape(e["id"])}"><h3>{clock(e["start"])} &ndash; {clock(e["end"])} {_badge(e["severity"], language)}</h3>'
            f'<p>{escape(label("category", e["category"], language))} / {escape(e["type"])} &middot; {t("col_confidence")}: {escape(label("confidence", e["confidence"], language))} &middot; {t("detector")}: {escape(e["detector"])}</p>'
            f'<b>{t("observed")}:</b><ul>{"".join(f"<li>{escape(o)}</li>" for o in observations)}</ul><p>{t("possible_interpretation")}: {escape(interpretation)}</p>'
            + (f'<p class="review">{t("human_verification_required")}</p>' if e["requires_human_review"] else "") + (f"<p>{links}</p>" if links else "") + "</div>"
        )
    heads = "".join(f"<th>{t(f'col_{c}')}</th>" for c in ("time", "category", "severity", "confidence", "type"))
    limits = f'<h2>{t("limitations")}</h2><ul>{"".join(f"<li>{escape(x)}</li>" for x in limitations)}</ul>' if limitations else ""
    return (
        f'<!doctype html>\n<html lang="{language}"><head><meta charset="utf-8"><title>{t("title")}</title><style>{_STYLE}</style></head><body><h1>{t("title")}</h1><p>{escape(path)} &middot; {t("duration")} {escape(duration)}</p><ul>{cards}</ul>'
        f'<h2>{t("timeline")}</h2><table><thead><tr>{heads}<th></th></tr></thead><tbody>{rows}</tbody></table><h2>{t("detailed_findings")}</h2>{"".join(parts) or f"<p>{t('no_findings')}</p>"}{limits}</body></html>\n'
    )


_RENDERED = ("recording_id", "lang", "json", "markdown", "html")


def _rendered(batches: Iterator[pa.RecordBatch], languages: tuple[str, ...]) -> Iterator[tuple]:
    """Reports of recordings whose rows (recording_id, side, media, limitations, event) follow one another: heads (side 0), then events in order."""

    def of(rec: str | None, heads: list[tuple], found: list[dict]) -> Iterator[tuple]:
        for media, limits in heads:
            m, limits = dict(media), limits or []
            size = [m.pop("width", None), m.pop("height", None)]
            m["resolution"] = None if any(x is None for x in size) else [int(x) for x in size]
            plain = json_report(m, found, limits)
            for lang in languages:
                yield rec, lang, plain, markdown_report(m, found, limits, lang), html_report(m, found, limits, lang)

    at, heads, found = None, [], []
    for b in batches:
        for i in range(0, b.num_rows, AT_ONCE):
            for r in b.slice(i, AT_ONCE).to_pylist():
                # recordings without an id have nothing in common
                if r["recording_id"] != at or at is None:
                    yield from of(at, heads, found)
                    at, heads, found = r["recording_id"], [], []
                if r["side"] == 0:
                    heads.append((r["media"], r["limitations"]))
                elif heads:
                    found.append(r["event"])
    yield from of(at, heads, found)


def _handed_on(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of _RENDERED in batches of HELD characters at about."""
    out, held = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], list(_RENDERED))
    for row in rows:
        out.append(row)
        held += sum(map(len, row[2:]))
        if held >= HELD:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def reports(result: Result, language: str = "en") -> DataFrame:
    """(recording_id, json, markdown, html) of every recording, each rendered by the task that holds its events."""
    return reports_in(result, (language,)).drop("lang")


def reports_in(result: Result, languages: tuple[str, ...]) -> DataFrame:
    """(recording_id, lang, json, markdown, html) of every recording in each of the languages; events are found once for all of them.

    A task goes through its recordings in order and holds the events of one of them, and a few reports.
    """
    r = result.recordings
    optional = [c if c in r.columns else F.lit(None).cast("double" if c == "frame_rate" else "int").alias(c) for c in ("width", "height", "frame_rate")]
    media = r.select("recording_id", F.struct("path", "duration", "has_video", "has_audio", *optional).alias("media"))
    known = result.events.where("recording_id IS NOT NULL")
    limits = result.limitations.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "limitation"))), lambda x: x["limitation"]).alias("limitations"))
    # a recording's head comes before its events, and each row has one of them
    heads = media.join(limits, "recording_id", "left").select("recording_id", F.lit(0).alias("side"), "media", "limitations")
    rows = heads.unionByName(known.select("recording_id", F.lit(1).alias("side"), F.struct(*known.columns).alias("event")), allowMissingColumns=True)
    rows = rows.repartition("recording_id").sortWithinPartitions("recording_id", "side", *[f"event.{c}" for c in ("start", "end", "detector_ord", "seq_in_detector")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _handed_on(_rendered(batches, languages))

    return rows.mapInArrow(run, ", ".join(f"{c} string" for c in _RENDERED))


def report_files(rendered: DataFrame, slugs: DataFrame | None = None) -> DataFrame:
    """(path, content): report.json, report.md and report.html of each recording, in a folder of its slug (recording_id, slug; else its id)."""
    d = rendered.withColumn("slug", F.col("recording_id")) if slugs is None else rendered.join(slugs.select("recording_id", "slug"), "recording_id")
    each = F.inline(F.array(*[F.struct(F.concat("slug", F.lit(f"/report.{end}")).alias("path"), F.encode(name, "UTF-8").alias("content")) for name, end in (("json", "json"), ("markdown", "md"), ("html", "html"))]))
    return d.select(each)


def write_reports(rendered: DataFrame, folder: str, slugs: DataFrame | None = None) -> None:
    """Writes the report files below folder, each from the task that has rendered it."""
    write_files(report_files(rendered, slugs), folder)


def index_rows(index: DataFrame, slugs: dict[str, str]) -> list[dict]:
    return [r.asDict() | {"slug": slugs.get(r["recording_id"], r["recording_id"])} for r in index.toLocalIterator()]


def index_markdown(rows: list[dict], language: str = "en") -> str:
    """One line for each recording, in their order; a failed one has dashes and its error."""
    language = language if language in LANGUAGES else "en"
    t = lambda k: label("ui", k, language)
    heads = [t("col_venue"), t("col_status"), t("duration"), t("total_findings"), *[label("severity", s, language) for s in reversed(SEVERITIES)], t("col_report")]
    out = [f"# {t('batch_title')}", "", f"**{t('total_venues')}:** {len(rows)}", "", "| " + " | ".join(heads) + " |", "|" + "---|" * 8]
    for r in rows:
        duration = t("unknown_duration") if r["duration"] is None else clock(r["duration"])
        tail = [r["total"], r["high"], r["medium"], r["low"], f"[report.md]({r['slug']}/report.md)"] if r["ok"] else ["-"] * 5
        status = t("status_ok") if r["ok"] else f"{t('status_error')}: {r['error']}"
        out.append(f"| `{r['path']}` | {status} | {duration} | " + " | ".join(map(str, tail)) + " |")
    return "\n".join(out) + "\n"


def index_html(rows: list[dict], language: str = "en") -> str:
    language = language if language in LANGUAGES else "en"
    t = lambda k: escape(label("ui", k, language))
    heads = [t("col_venue"), t("col_status"), t("duration"), t("total_findings"), *[escape(label("severity", s, language)) for s in reversed(SEVERITIES)], t("col_report")]
    body = ""
    for r in rows:
        duration = t("unknown_duration") if r["duration"] is None else clock(r["duration"])
        tail = [r["total"], r["high"], r["medium"], r["low"], f'<a href="{escape(r["slug"])}/report.html">report.html</a>'] if r["ok"] else ["-"] * 5
        status = t("status_ok") if r["ok"] else f"{t('status_error')}: {escape(r['error'] or '')}"
        body += "<tr>" + "".join(f"<td>{c}</td>" for c in [escape(r["path"] or ""), status, duration, *tail]) + "</tr>"
    return f'<!doctype html>\n<html lang="{language}"><head><meta charset="utf-8"><title>{t("batch_title")}</title><style>{_STYLE}</style></head><body><h1>{t("batch_title")}</h1><p>{t("total_venues")}: {len(rows)}</p><table><thead><tr>{"".join(f"<th>{h}</th>" for h in heads)}</tr></thead><tbody>{body}</tbody></table></body></html>\n'
