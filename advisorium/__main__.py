"""Command line: ``python -m advisorium COMMAND``; exit status 2 if a scan has findings, 1 on errors."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession


def session(name: str) -> SparkSession:
    builder = SparkSession.builder.appName(f"advisorium-{name}").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master := os.environ.get("SPARK_MASTER"):
        builder = builder.master(master)
    return builder.getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="advisorium")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("query", help="run a named query over a folder of tables and write its rows")
    a.add_argument("name")
    a.add_argument("tables")
    a.add_argument("out")
    a = sub.add_parser("ingest", help="take up what has landed for a source")
    a.add_argument("source")
    a.add_argument("folder", help="holds landing/, and gets archive/, records/ and checkpoint/")
    a.add_argument("--store", help="folder of a record store to merge into")
    a = sub.add_parser("scan", help="match inventories against statements")
    a.add_argument("inventories")
    a.add_argument("statements")
    a.add_argument("--minimum", default="possible", choices=["possible", "probable", "confirmed"])
    a.add_argument("--json", action="store_true", help="report as JSON")
    a = sub.add_parser("export", help="write the corpus as csv or ndjson")
    a.add_argument("corpus")
    a.add_argument("out")
    a.add_argument("--format", default="ndjson", choices=["ndjson", "csv"])
    a = sub.add_parser("bundle", help="pack, unpack or list recorded downloads")
    a.add_argument("action", choices=["pack", "unpack", "info"])
    a.add_argument("paths", nargs="+")
    a = sub.add_parser("sources", help="state of each source, or with --terms whom its data is owed to")
    a.add_argument("folder")
    a.add_argument("--terms", action="store_true")
    a = sub.add_parser("migrate", help="create the tables that a folder lacks")
    a.add_argument("folder")
    a = sub.add_parser("collect", help="run collectors over a recorded bundle into a landing folder, once or as they fall due")
    a.add_argument("bundle")
    a.add_argument("folder")
    a.add_argument("sources", nargs="*")
    a.add_argument("--backfill", action="store_true")
    a.add_argument("--keep-on", action="store_true")
    a = sub.add_parser("serve", help="answer HTTP requests over the tables of a folder")
    a.add_argument("folder", nargs="?")
    a = sub.add_parser("inventory", help="write the components of this machine")
    a.add_argument("out")
    a.add_argument("--root", default="/")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        from advisorium import __version__

        print(__version__)
        return 0
    if args.command == "bundle":
        from advisorium.sources import bundle

        if args.action == "info":
            for line in open(f"{args.paths[0]}/manifest.jsonl"):
                print(line, end="")
        else:
            print((bundle.pack if args.action == "pack" else bundle.unpack)(*args.paths[:2]))
        return 0
    spark = session(args.command)
    if args.command == "query":
        from advisorium.plans import problems, reference

        (problems.QUERIES | reference.QUERIES)[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    elif args.command == "ingest":
        from advisorium.operators import store
        from advisorium.sources import documents
        from advisorium.streaming import ingest

        parse = {"cvelist": documents.parse_cve5, "vulnrichment": documents.parse_cve5, "nvd": documents.parse_nvd, "fkie": documents.parse_nvd, "euvd": documents.parse_euvd, "csaf": documents.parse_csaf, "osv": documents.parse_osv, "ghsa": documents.parse_osv}.get(args.source, documents.parse_any)
        where = ingest.Landing(args.source, *(f"{args.folder}/{x}" for x in ("landing", "archive", "records", "checkpoint")))
        into = store.RecordStore(spark, args.store) if args.store else None
        ingest.start(spark, where, lambda raw: parse(raw, "content", args.source), store=into).awaitTermination()
    elif args.command == "scan":
        from pyspark.sql import functions as F

        from advisorium.operators import scan
        from advisorium.sinks import exports
        from advisorium.sources import inventory

        found = inventory.read_inventories(spark.read.format("binaryFile").load(args.inventories)).filter("refused is null")
        comps = scan.dedupe_components(found.withColumn("comp_id", F.xxhash64("path", "comp_no")))
        said = spark.read.parquet(args.statements)
        verdicts = scan.judge(scan.all_candidates(comps, said), comps, said)
        reduced = scan.reduce_verdicts(verdicts, args.minimum).cache()
        named = reduced.filter("outcome = 'finding'").join(comps.select("comp_id", "name"), "comp_id").orderBy("vuln_id", "name")
        for piece in exports.report_json(named) if args.json else exports.report_lines(named):
            print(piece)
        return exports.scan_status(reduced)
    elif args.command == "sources":
        from advisorium import serve
        from advisorium.streaming import ingest, runs

        shown = serve.attributions(spark) if args.terms else runs.SourceBook(spark, f"{args.folder}/runs").sources(sorted(ingest.CADENCE))
        for r in shown.collect():
            print("\t".join("" if v is None else str(v) for v in r))
    elif args.command == "migrate":
        from advisorium import serve

        print("\n".join(serve.bootstrap(spark, args.folder)))
    elif args.command == "collect":
        from datetime import datetime, timezone

        from advisorium import config
        from advisorium.sources import bundle, collectors
        from advisorium.streaming import runs

        book = runs.SourceBook(spark, f"{args.folder}/runs")
        walks = collectors.COLLECTORS | {"csaf": collectors.csaf(config.load().csaf_providers)}
        fetch = bundle.fetcher(args.bundle)

        def turn(source: str) -> None:
            work = runs.run_one(book, source, walks[source], fetch, runs.landing_sink(f"{args.folder}/{source}/landing"), datetime.now(timezone.utc), args.backfill)
            print(f"{source}\tseen {work.seen}\twritten {work.written}\tfailed {work.failed}")

        wanted = args.sources or config.load().sources or sorted(walks)
        if args.keep_on:
            runs.schedule(book, list(wanted), turn, lambda: False)
        for source in wanted:
            turn(source)
    elif args.command == "serve":
        from advisorium import config, serve

        settings = config.load()
        serve.serve(serve.Tables(spark, args.folder or settings.folder), settings)
    elif args.command == "inventory":
        from advisorium import serve

        serve.local_inventory(spark, args.root).write.mode("overwrite").parquet(args.out)
    elif args.command == "export":
        from advisorium.sinks import exports

        (exports.write_csv if args.format == "csv" else exports.write_ndjson)(spark.read.parquet(args.corpus), args.out)
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except (ValueError, KeyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        sys.exit(1)
