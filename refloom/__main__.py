"""python -m refloom scan|audit|renumber|relink|call: Word documents, and single tools of the library, from the command line.

Exit code 0: done and in order; 1: a discrepancy was found; 2: a wrong argument or an unreadable file.
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("refloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _documents(spark, path: str, name: str | None = None):
    from pyspark.sql import functions as F

    from refloom.sources.docx import read_documents

    docs = read_documents(spark, path)
    return docs.withColumn("doc_id", F.lit(name)) if name else docs


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="refloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="report the fields and placeholders of documents")
    scan.add_argument("path")
    audit = commands.add_parser("audit", help="reconcile a converted document with its source")
    audit.add_argument("source")
    audit.add_argument("output")
    audit.add_argument("mapping", help="JSON lines with item_key and doi")
    renumber = commands.add_parser("renumber", help="give citations ids of their own")
    renumber.add_argument("path")
    renumber.add_argument("--original", help="leave citations alone that this document shows")
    renumber.add_argument("--prefix", default="new")
    relink = commands.add_parser("relink", help="replace item keys")
    relink.add_argument("path")
    relink.add_argument("pairs", nargs="+", metavar="OLD=NEW")
    for p in (renumber, relink):
        p.add_argument("--out", help="folder to write to")
        p.add_argument("--dry-run", action="store_true", help="count the changes and write nothing")
    call = commands.add_parser("call", help="call one tool of the library")
    call.add_argument("tool")
    call.add_argument("arguments", nargs="?", default="{}", type=json.loads)
    args = parser.parse_args(argv)
    if args.command == "call":
        from refloom.sources.rpc import RpcError, shared_client

        try:
            print(json.dumps(shared_client().call(args.tool, args.arguments), ensure_ascii=False, indent=1))
        except RpcError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    paths = [getattr(args, n) for n in ("path", "source", "output", "mapping") if getattr(args, n, None)]
    if missing := [p for p in paths if "://" not in p and not any(c in p for c in "*?[{") and not os.path.exists(p)]:
        print(f"no such file: {missing[0]}", file=sys.stderr)
        return 2

    spark = _session()
    from refloom.plans import convert, repair
    from refloom.sources.docx import save_documents

    if args.command == "scan":
        rows = [json.loads(x) for x in convert.scan(_documents(spark, args.path)).toJSON().collect()]  # one short row a document
        print(json.dumps(rows, indent=1))
        return int(any(r["structure_errors"] for r in rows))
    if args.command == "audit":
        mapping = spark.read.schema("item_key string, doi string").json(args.mapping)
        found = repair.audit_documents(_documents(spark, args.source, "doc"), _documents(spark, args.output, "doc"), mapping)
        n = 0
        for n, r in enumerate(found.where("why is not null").toLocalIterator(), start=1):  # one JSON line each, however many
            print(json.dumps(r.asDict(), ensure_ascii=False))
        return int(n > 0)
    docs = _documents(spark, args.path, "doc" if getattr(args, "original", None) else None)
    if args.command == "renumber":
        out = repair.renumber_documents(docs, repair.new_displays(docs, _documents(spark, args.original, "doc")) if args.original else None, args.prefix)
    else:
        if bad := [p for p in args.pairs if "=" not in p]:
            print(f"not OLD=NEW: {bad[0]}", file=sys.stderr)
            return 2
        out = repair.relink_documents(docs, spark.createDataFrame([tuple(p.split("=", 1)) for p in args.pairs], "old string, new string"))
    out = out.cache()
    try:
        print(out.agg({"changed": "sum"}).first()[0] or 0)
        if args.out and not args.dry_run:
            save_documents(out, args.out)
    finally:
        out.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
