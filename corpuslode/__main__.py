"""Command line: python -m corpuslode ingest|query|extract|report ... (also as a spark-submit entry point)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpuslode")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="text files into an engine's folder")
    a.add_argument("source"), a.add_argument("engine"), a.add_argument("--chunker", default="heading"), a.add_argument("--pattern", default="*.{md,txt}")
    a = sub.add_parser("query", help="one query")
    a.add_argument("engine"), a.add_argument("text"), a.add_argument("-k", type=int, default=5), a.add_argument("--no-rewrite", action="store_true"), a.add_argument("--rerank", action="store_true"), a.add_argument("--explain", action="store_true")
    a = sub.add_parser("extract", help="chunks with keywords and entities as JSON")
    a.add_argument("source"), a.add_argument("output"), a.add_argument("--chunker", default="heading"), a.add_argument("--pattern", default="*.{md,txt}")
    a = sub.add_parser("report", help="metrics of a results file (dataset, rank, latency_ms)")
    a.add_argument("results"), a.add_argument("--output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from corpuslode.engine import SearchEngine, processed
    from corpuslode.operators.evaluate import summary
    from corpuslode.sources.readers import text_files
    from corpuslode.sources.sinks import report, write_documents

    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("corpuslode").getOrCreate()
    if o.command in ("ingest", "extract"):
        docs = text_files(spark, o.source, o.pattern).select(F.xxhash64("path").bitwiseAND((1 << 40) - 1).alias("doc_id"), "path", "text")
    if o.command == "ingest":
        SearchEngine(spark, o.engine, o.chunker).ingest(docs.select("doc_id", "text"))
    elif o.command == "extract":
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        write_documents(processed(docs.select("doc_id", "text"), o.chunker).join(docs.select("doc_id", name.alias("path")), "doc_id"), o.output)
    elif o.command == "query":
        q = spark.createDataFrame([(0, o.text)], "query_id long, text string")
        for r in SearchEngine(spark, o.engine).retrieve(q, o.k, not o.no_rewrite, o.rerank, explain=o.explain).orderBy("rank").collect():
            print(r.rank, round(r.score, 6), r.doc_id, r.heading or "", r.text[:200].replace("\n", " "))
    else:
        print(report(summary(spark.read.json(o.results), ["dataset"]), o.output))
    return 0


if __name__ == "__main__":
    sys.exit(main())
