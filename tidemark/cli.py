"""Command line: analyze, batch and compare over folders of signal tables (parquet)."""

from __future__ import annotations

import argparse
import json
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from .detectors.base import TABLES, Signals
from .functions.scalar import unique_slugs
from .plans import analysis, comparison
from .reporting import documents
from .reporting.evidence import write_evidence
from .reporting.texts import LANGUAGES
from .schema import SEVERITIES
from .sinks import write_files
from .storage import written


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def load(spark: SparkSession, folder: str) -> Signals:
    """Signals of the tables that a folder has, as <name>.parquet."""
    here = {n: f"{folder}/{n}.parquet" for n in TABLES}
    return Signals(spark, {n: spark.read.parquet(p) for n, p in here.items() if _exists(spark, p)})


def _put(spark: SparkSession, folder: str, texts: dict[str, str]) -> None:
    """Writes small texts below folder."""
    write_files(spark.createDataFrame([(n, t.encode()) for n, t in texts.items()], "path string, content binary"), folder)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "Report on the recordings of a folder."), ("batch", "Report on the recordings of several folders, with an index.")):
        p = sub.add_parser(name, help=text)
        p.add_argument("source" if name == "analyze" else "sources", nargs=None if name == "analyze" else "+")
        p.add_argument("--out-dir", default="audit-output")
        p.add_argument("--profile", default="full", choices=["full", *analysis.PROFILES])
        p.add_argument("--experimental-feedback", action="store_true")
        p.add_argument("--no-evidence", action="store_true")
        p.add_argument("--min-severity-for-evidence", default="medium", choices=SEVERITIES)
        p.add_argument("--lang", default="en", choices=LANGUAGES)
        if name == "batch":
            p.add_argument("--concurrency", type=int, default=1, help="folders that are worked on at once")
    p = sub.add_parser("compare", help="Compare pairs (pairs.parquet, and metrics.parquet where measured) of a folder.")
    p.add_argument("source")
    p.add_argument("--out-dir", default="audit-output")
    p.add_argument("--delivery-spec")
    p.add_argument("--max-compare-duration", type=float, default=60.0)
    return parser


def _report(signals: Signals, args: argparse.Namespace, slugs: dict[str, str]) -> list[dict]:
    result = analysis.analyze(signals, args.profile, args.experimental_feedback)
    result.events = written(result.events)
    index = analysis.batch_index(result)
    own = signals.spark.createDataFrame(list(slugs.items()), "recording_id string, slug string")
    if not args.no_evidence:
        blocks = signals.tables.get("pcm_blocks")
        result.events = write_evidence(result.events, f"{args.out_dir}/evidence", args.min_severity_for_evidence, slugs=own, blocks=blocks)
    documents.write_reports(documents.reports(result, args.lang), args.out_dir, own)
    rows = documents.index_rows(index, slugs)
    signals.release()
    return rows


def _said(problem: Exception) -> str:
    """The first line of what a failure comes from, without numbers of the session."""
    cause = getattr(problem, "java_exception", None)
    while cause is not None and cause.getCause() is not None:
        cause = cause.getCause()
    lines = str(problem if cause is None else cause.getMessage()).splitlines()
    return lines[0] if lines else type(problem).__name__


def _recordings(spark: SparkSession, folder: str) -> tuple[Signals | None, list[str], str | None]:
    """(signals, ids of the recordings in order, error) of a folder; one that can't be read has an error instead."""
    try:
        signals = load(spark, folder)
        return signals, [r["recording_id"] for r in signals.recordings.select("recording_id").orderBy("recording_id").toLocalIterator()], None
    except Exception as problem:  # one folder's failure is its own
        return None, [], _said(problem)


def run_batch(spark: SparkSession, folders: list[str], args: argparse.Namespace) -> list[dict]:
    """A row for each recording, by folder in the order given; folders are worked on `concurrency` at once, each in a scheduler pool of its own.

    Slugs are given out before, in that order, so they don't depend on which folder is done first. A
    folder that fails has one row with its error; the others go on.
    """
    loaded = [_recordings(spark, f) for f in folders]
    slugs = iter(unique_slugs([n for _, names, _ in loaded for n in names]))
    own = [{n: next(slugs) for n in names} for _, names, _ in loaded]

    def one(i: int) -> list[dict]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"folder-{i}")
        signals, names, error = loaded[i]
        try:
            if error is None:
                return _report(signals, args, own[i])
        except Exception as problem:
            error = _said(problem)
        none = dict.fromkeys(("total", "high", "medium", "low", "duration"))
        return [{"recording_id": folders[i], "path": folders[i], "slug": "", "ok": False, "error": error} | none]

    with ThreadPoolExecutor(max(1, getattr(args, "concurrency", 1))) as pool:
        return [row for rows in pool.map(inheritable_thread_target(spark)(one), range(len(folders))) for row in rows]


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidemark").config("spark.scheduler.mode", "FAIR").getOrCreate()
    if args.command == "compare":
        spec = "\n".join(r["value"] for r in spark.read.text(args.delivery_spec).toLocalIterator()) if args.delivery_spec else None
        metrics = f"{args.source}/metrics.parquet"
        done = comparison.compare(spark.read.parquet(f"{args.source}/pairs.parquet"), spark.read.parquet(metrics) if _exists(spark, metrics) else None, comparison.Comparison(args.max_compare_duration, json.loads(spec) if spec else None))
        _put(spark, args.out_dir, {"comparison.json": "".join(r["json"] + "\n" for r in comparison.as_json(done).orderBy("pair_id").toLocalIterator())})
        return 0
    rows = run_batch(spark, [args.source] if args.command == "analyze" else args.sources, args)
    if args.command == "batch":
        _put(spark, args.out_dir, {"index.md": documents.index_markdown(rows, args.lang), "index.html": documents.index_html(rows, args.lang)})
    failed = sum(not r["ok"] for r in rows)
    print(f"Processed {len(rows)} recording(s): {len(rows) - failed} ok, {failed} error(s)")
    return 1 if rows and failed == len(rows) else 0


if __name__ == "__main__":
    sys.exit(main())
