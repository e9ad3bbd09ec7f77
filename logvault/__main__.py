"""Command line: ``python -m logvault <command> ...``.

    ingest  SRC DST --layout variant [--malformed skip] [--keys b64|hex]
    search  ARCHIVE --layout variant [--dialect sql|kql|pairwise|es] [--where SQL]
    catalog ARCHIVE OUT --layout variant
    report  RESULTS OUT [--format parquet|csv]   (RESULTS: "<dir>/*/output.json" or Parquet)

Every command prints one JSON line. ``search --where`` counts the rows of the
archive view matching a Spark SQL condition (the archive is registered as
view ``logs``); without it the six standard searches are counted in one scan.
"""

from __future__ import annotations

import argparse
import json
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m logvault")
    p.add_argument("--master", default=None, help="Spark master for local runs (e.g. local[8])")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", help="log files -> archive")
    i.add_argument("src")
    i.add_argument("dst")
    i.add_argument("--layout", default="variant")
    i.add_argument("--malformed", default="fail", choices=["fail", "skip", "keep"])
    i.add_argument("--keys", default=None, choices=["b64", "hex"], help="encode keys while ingesting")
    i.add_argument("--mode", default="errorifexists")
    s = sub.add_parser("search", help="count hits in an archive")
    s.add_argument("archive")
    s.add_argument("--layout", default="variant")
    s.add_argument("--dialect", default=None, choices=["sql", "kql", "pairwise", "es"])
    s.add_argument("--where", default=None, help="Spark SQL condition over view `logs`")
    c = sub.add_parser("catalog", help="path catalogue of an archive")
    c.add_argument("archive")
    c.add_argument("out", help="folder of the catalogue (Parquet)")
    c.add_argument("--layout", default="variant", choices=["variant", "document", "pairwise"])
    r = sub.add_parser("report", help="result files (<tool>/output.json glob) or (tool, doc) Parquet -> sheets")
    r.add_argument("results", help="glob of JSON result files, or a Parquet folder of (tool, doc)")
    r.add_argument("out")
    r.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    return p


def main(argv: list[str] | None = None, spark=None) -> dict:
    from logvault.layouts import get_layout
    from logvault.session import get_spark

    args = _parser().parse_args(argv)
    spark = spark or get_spark(args.master)
    out: dict = {"command": args.command}
    if args.command == "ingest":
        from logvault.sinks.writers import ingest_files, write_layout
        from logvault.sources.lines import clean_lines, read_lines
        lay = get_layout(args.layout)
        if args.keys:
            cleaned, rejected = clean_lines(read_lines(spark, args.src), args.keys)
            write_layout(lay.build(cleaned), lay, args.dst, mode=args.mode)
        else:
            rejected = ingest_files(spark, args.src, lay, args.dst, malformed=args.malformed, mode=args.mode)
        out.update(archive=args.dst, layout=args.layout, rejected=rejected.count())
    elif args.command == "search":
        from logvault.operators.search import count_hits_many
        from logvault.plans.standard import DIALECT_OF_LAYOUT, searches
        from logvault.sources.archive import read_archive
        df = read_archive(spark, args.archive, args.layout, view="logs", require_data=True)
        if args.where:
            from logvault.functions.sql import register_sql_functions
            register_sql_functions(spark)
            out["hits"] = spark.sql(f"SELECT count(*) FROM logs WHERE {args.where}").first()[0]
        else:
            preds = searches(args.dialect or DIALECT_OF_LAYOUT[args.layout])
            out["hits"] = count_hits_many(df, get_layout(args.layout), preds).first().asDict()
    elif args.command == "catalog":
        from logvault.operators.flatten import path_catalog, path_catalog_pairwise
        from logvault.sources.archive import read_archive
        df = read_archive(spark, args.archive, args.layout)
        cat = path_catalog_pairwise(df) if args.layout == "pairwise" else path_catalog(df, "j")
        cat.orderBy("path", "type").write.parquet(args.out)
        out.update(out=args.out)
    elif args.command == "report":
        from logvault.operators.report import read_result_files, read_results, report, report_long
        from logvault.sinks.writers import write_report
        docs = (read_result_files(spark, args.results) if args.results.endswith(".json")
                else spark.read.parquet(args.results))
        wide = report(report_long(read_results(docs)))
        write_report(wide, args.out, fmt=args.format)
        out.update(out=args.out)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
