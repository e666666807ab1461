"""Command line: `python -m neurolith queries`, `query`, `settings`, `clean`, `study`. Reads and writes what Spark can reach."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from neurolith.operators import chain, optical_study
from neurolith.plans import registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="neurolith")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="the names of all queries")
    q = sub.add_parser("query", help="write a query's rows as Parquet")
    q.add_argument("name")
    q.add_argument("tables", help="folder of the Parquet tables")
    q.add_argument("out")
    s = sub.add_parser("settings", help="print the cleaning chain's settings as JSON")
    s.add_argument("--evoked", action="store_true")
    c = sub.add_parser("clean", help="run the cleaning chain over Parquet samples")
    c.add_argument("samples", help="session_id, signal, sample_idx, value")
    c.add_argument("out", help="folder for the tables of all stages, cleaned, channels, epochs, quality and errors among them")
    c.add_argument("--settings", help="JSON file")
    c.add_argument("--events", help="Parquet: session_id, onset, tag")
    t = sub.add_parser("study", help="run the optical study over a folder of sessions")
    t.add_argument("sessions", help="folder of session folders (participant=.../study_day=.../session_id=...)")
    t.add_argument("out", help="folder for the tables: processed, phase_by_phase, wide_by_session, session_changes, event_alignment, run_log, qc_summary, input_hashes, record")
    t.add_argument("--settings", help="JSON file; what it leaves out keeps its default")
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 where every recording of a cleaning run ended as an error, or no session of a study could be read."""
    a = parser().parse_args(argv)
    if a.command == "settings":
        print((chain.EVOKED if a.evoked else chain.Settings()).to_json())
        return 0
    registry.load()
    if a.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("neurolith").getOrCreate()
    if a.command == "query":
        registry.QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
        return 0
    if a.command == "study":
        optical = optical_study.Settings()
        if a.settings:
            with open(a.settings, encoding="utf-8") as f:
                optical = optical_study.Settings.from_json(f.read())
        log = optical_study.run_study(spark, a.sessions, a.out, optical)["run_log"]
        return 0 if log.filter("status = 'OK'").limit(1).count() else 1
    settings = chain.Settings()
    if a.settings:
        with open(a.settings, encoding="utf-8") as f:
            settings = chain.Settings.from_json(f.read())
    chain.run(spark.read.parquet(a.samples), settings, spark.read.parquet(a.events) if a.events else None, folder=a.out)
    done = spark.read.parquet(f"{a.out}/cleaned").limit(1).count()
    return 0 if done or not spark.read.parquet(f"{a.out}/errors").limit(1).count() else 1


if __name__ == "__main__":
    raise SystemExit(main())
