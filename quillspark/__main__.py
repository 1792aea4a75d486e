"""python -m quillspark COMMAND: thin entry points over files of texts and JSON documents."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import boundaries, clean, clients, compare, onepass, records, report, scoring, segments
from quillspark.plans import lifecycles
from quillspark.sources import files

COMMANDS = {
    "clean": "texts -> clean texts",
    "score": "texts -> boundary clusters of a scorer",
    "segment": "texts -> segments and units by rules",
    "annotate": "texts -> units that a chat service names",
    "convert": "JSON documents of a scorer's arrays -> boundary tokens and clusters",
    "records": "texts and clusters -> records",
    "report": "texts and clusters -> pages",
    "compare": "two unit files -> scores",
    "pipeline": "texts -> clean texts, clusters, records and pages; a stage with the same parameters is read, not run again",
}


def _named(path: str) -> Callable:
    """module:name of a callable."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in COMMANDS.items():
        one = commands.add_parser(name, help=about)
        one.add_argument("input", help="texts; for convert the scorer's documents, for compare the predicted units")
        one.add_argument("output", help="folder to write")
        if name in ("records", "report"):
            one.add_argument("clusters", help="JSON documents of clusters, named like the texts")
        if name == "compare":
            one.add_argument("gold", help="JSON documents of units")
            one.add_argument("--tolerance", type=int, default=80)
        if name in ("score", "pipeline"):
            one.add_argument("--scorer", default="quillspark.operators.scoring:HashScorer", help="module:name of what makes a scorer")
        if name in ("score", "convert", "pipeline"):
            one.add_argument("--gap", type=int, default=20)
        if name == "pipeline":
            one.add_argument("--force", action="store_true", help="run all stages again")
            one.add_argument("--skip", action="append", default=[], choices=["clean", "records", "report"], help="leave a stage out")
        if name == "annotate":
            one.add_argument("--url", required=True)
            one.add_argument("--model", required=True)
            one.add_argument("--key-from", default="CHAT_API_KEY", help="environment variable that holds the key")
            one.add_argument("--timeout", type=float, default=120.0)
            one.add_argument("--requests", type=int, default=8, help="chunks asked for at once")
    return parser


def _clusters(texts: DataFrame, scorer: str, gap: int) -> DataFrame:
    return onepass.gap_clusters(texts, _named(scorer), gap, lifecycles.CONTEXT)


def _pipeline(spark: SparkSession, texts: DataFrame, args: argparse.Namespace) -> None:
    """Stages keyed by their parameters; later ones read what earlier ones wrote."""
    known = {"input": args.input, "clean": "clean" not in args.skip}
    kept = lambda name, build, **more: files.stage(spark, args.output, name, known | more, build, args.force)
    if "clean" not in args.skip:
        texts = kept("clean", lambda: clean.clean_documents(texts).select("doc_id", "name", "text"))
    found = kept("clusters", lambda: _clusters(texts, args.scorer, args.gap), scorer=args.scorer, gap=args.gap)
    if "records" not in args.skip:
        kept("records", lambda: records.build_records(found, texts), scorer=args.scorer, gap=args.gap)
    if "report" not in args.skip:
        pages = report.pages(found, texts).join(texts.select("doc_id", "name"), "doc_id")
        files.write_texts(pages.select("name", F.col("html").alias("text")), f"{args.output}/report")


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "compare":
        pick = lambda path: files.read_rows(spark, path, files.UNITS).select(F.lit(1).alias("key"), F.col("char_start").alias("pos"))
        compare.scored_match(pick(args.input), pick(args.gold), args.tolerance).write.mode("overwrite").json(args.output)
        return
    if args.command == "convert":
        raw = spark.read.schema(files.INFERENCE).json(args.input, multiLine=True).withColumn("name", files.name_of(F.input_file_name()))
        tokens = scoring.tokens_from_arrays(F.col("name"), F.col("inference_results"), raw)
        scoring.boundary_tokens(tokens).write.mode("overwrite").parquet(f"{args.output}/tokens")
        boundaries.gap_clusters(boundaries.boundary_positions(tokens), args.gap).write.mode("overwrite").parquet(f"{args.output}/clusters")
        return
    texts = files.read_texts(spark, args.input).withColumn("doc_id", F.xxhash64("name"))
    if args.command == "clean":
        files.write_texts(clean.clean_documents(texts).select("name", "text"), args.output)
    elif args.command == "score":
        _clusters(texts, args.scorer, args.gap).write.mode("overwrite").parquet(args.output)
    elif args.command == "segment":
        found, units = lifecycles.by_rules(texts, segments.Segmenter())
        found.write.mode("overwrite").parquet(f"{args.output}/segments")
        units.write.mode("overwrite").parquet(f"{args.output}/units")
    elif args.command == "annotate":
        client = clients.ChatClient(args.url, args.model, args.key_from, timeout=args.timeout)
        lifecycles.by_annotator(texts, client.connect, requests=args.requests).write.mode("overwrite").parquet(args.output)
    elif args.command == "pipeline":
        _pipeline(spark, texts, args)
    else:
        clusters = files.read_rows(spark, args.clusters, files.CLUSTERS).withColumn("doc_id", F.xxhash64("name"))
        if args.command == "records":
            files.write_lines(records.build_records(clusters, texts), args.output)
        else:
            pages = report.pages(clusters, texts).join(texts.select("doc_id", "name"), "doc_id")
            files.write_texts(pages.select("name", F.col("html").alias("text")), args.output)


if __name__ == "__main__":
    main()
