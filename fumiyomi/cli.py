"""Command line: lint, outline or terms over files. Exit code 0, 1 for errors, 2 where a finding is as severe as asked."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fumiyomi.operators.blocks import structured
from fumiyomi.functions.tokenizer import token_frame
from fumiyomi.operators import compare, outline, terms
from fumiyomi.operators.frames import sentences
from fumiyomi.plans.lint import analyzed
from fumiyomi.sources import sinks
from fumiyomi.sources.readers import InputError, config, documents, earlier_run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fumiyomi")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("lint", "outline", "terms"):
        c = sub.add_parser(name)
        c.add_argument("files", nargs="+")
        c.add_argument("--json", action="store_true")
        if name == "lint":
            c.add_argument("--format", choices=["text", "json", "github", "sarif"], default="text")
            c.add_argument("--genre", choices=["essay", "tech", "business"])
            c.add_argument("--experimental", action="store_true")
            c.add_argument("--fail-on", choices=["info", "warn", "critical"])
            c.add_argument("--baseline")
            c.add_argument("--config")
            c.add_argument("--no-config", action="store_true")
        if name == "terms":
            c.add_argument("--audit", action="store_true")
    return p


def run_lint(spark: SparkSession, a: argparse.Namespace, out) -> int:
    conf = config(None, "/nonexistent") if a.no_config else config(a.config)
    docs = documents(spark, a.files, a.genre or conf.genre)
    run = analyzed(docs, a.experimental)
    found = compare.suppressed(run.findings, conf.disabled_rules, conf.allow).persist()
    kind = "json" if a.json else a.format
    if kind == "json":
        reports = [json.loads(r["json"]) for r in sinks.json_reports(found, docs, run.stats).join(docs.select("doc_id", "ord"), "doc_id").orderBy("ord").collect()]
        if a.baseline:
            header, before = earlier_run(spark, a.baseline)
            now = found.select(F.col("doc_id").alias("file"), F.monotonically_increasing_id().alias("ord"), "category", "excerpt")
            status = compare.bag_match(now, before.join(F.broadcast(docs.select(F.col("file"))), "file", "left_semi")).groupBy("file", "status").count().collect()
            for r in reports:
                r["comparison"] = {s["status"]: s["count"] for s in status if s["file"] == r["file"]}
        print(json.dumps(reports[0] if len(reports) == 1 else reports, ensure_ascii=False, indent=2), file=out)
    elif kind == "github":
        for r in sinks.annotations(sinks.ordered(found)).collect():
            print(r["annotation"], file=out)
    elif kind == "sarif":
        logs = [json.loads(r["sarif"]) for r in sinks.sarif(found).orderBy("doc_id").collect()]
        print(json.dumps({"version": "2.1.0", "runs": [x for log in logs for x in log["runs"]]}, ensure_ascii=False), file=out)
    else:
        for r in sinks.ordered(found).collect():
            print(f"{r['doc_id']}:{r['line']}: {r['severity']} {r['category']} {r['excerpt']}", file=out)
        for r in sinks.breakdown(found).collect():
            print(f"{r['doc_id']} {r['category']} {r['n']}", file=out)
    code = sinks.exit_code(found, a.fail_on or conf.fail_on)
    spark.catalog.clearCache()
    return code


def run_terms(spark: SparkSession, a: argparse.Namespace, out) -> int:
    docs = documents(spark, a.files)
    masked = structured(docs.select("doc_id", "text"))
    found = terms.acronyms(masked.withColumn("raw", F.col("masked"))).withColumns({"turn": F.lit(0), "byte_start": F.lit(0)})
    runs = terms.token_terms(token_frame(sentences(masked))).withColumn("turn", F.lit(1))
    rows = terms.with_context(terms.registered(found.unionByName(runs)), docs)
    rows = terms.audit(rows).orderBy(F.col("total").desc(), "term") if a.audit else rows.drop("byte_start").orderBy("doc_id", "line", "term")
    for r in rows.collect():
        print(json.dumps(r.asDict(), ensure_ascii=False) if a.json else " ".join(map(str, r)), file=out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fumiyomi").getOrCreate()
    try:
        if a.command == "lint":
            return run_lint(spark, a, out)
        if a.command == "terms":
            return run_terms(spark, a, out)
        for r in outline.outline(documents(spark, a.files)).orderBy("doc_id", "line").collect():
            print(json.dumps(r.asDict(), ensure_ascii=False) if a.json else f"{r['line']}: {'#' * (r['level'] or 0)} {r['text']}", file=out)
        return 0
    except InputError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
