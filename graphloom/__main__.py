"""Command line: ``python -m graphloom load ...`` and ``python -m graphloom query ...``."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from graphloom.engine import BUILDERS, LAYOUTS, Engine
from graphloom.layouts.reductions import TYPES
from graphloom.runner import run_files
from graphloom.sources.ntriples import MALFORMED, cleaned, load_text, read_prefixes, read_table
from graphloom.storage import GraphStore


def _span(text: str) -> tuple[int, int]:
    a, b = text.split(",")
    return int(a), int(b)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", aliases=["l"], help="read triples and build a layout")
    load.add_argument("-d", "--database", required=True, help="folder of the graph")
    load.add_argument("-i", "--input", required=True, help="triples: a file or folder that Spark can read")
    load.add_argument("-f", "--format", required=True, choices=sorted(LAYOUTS), help="layout")
    load.add_argument("-F", "--field-separator", default="\t")
    load.add_argument("-L", "--line-separator", default="\n")
    load.add_argument("-n", "--ntriples", action="store_true", help="the input is N-Triples, not delimited text")
    load.add_argument("--parquet", action="store_true", help="the input is a Parquet table with the columns that -cs, -cp and -co name")
    load.add_argument("-cs", "--column-name-subject", default="s", help="the subject's column, in a Parquet input and in the table of -o")
    load.add_argument("-cp", "--column-name-predicate", default="p")
    load.add_argument("-co", "--column-name-object", default="o")
    load.add_argument("-c", "--columns", default="s,p,o", help="order of the fields in delimited text")
    load.add_argument("-P", "--prefix-file", help="lines of 'prefix: <namespace>'")
    load.add_argument("-s", "--strip-dot", action="store_true")
    load.add_argument("-u", "--unique", action="store_true", help="drop duplicates; without it the input is taken to have none")
    load.add_argument("--malformed", default="raise", choices=MALFORMED, help="what to do with a line that is no triple")
    load.add_argument("-m", "--mode", default="errorifexists", choices=["errorifexists", "overwrite", "ignore"])
    load.add_argument("-k", "--keep", action="store_true", help="st, xvp: keep the table of terms that the layout was built from")
    load.add_argument("-o", "--output", help="also save the triples under this table name in Spark's catalog")
    load.add_argument("-S", "--shuffle", action="store_true", help="join by shuffle, never by broadcast")
    load.add_argument("-t", "--threshold", type=float, default=1.0, help="xvp: write reductions below this selectivity")
    load.add_argument("-e", "--types", default=",".join(TYPES), help="xvp: kinds of reductions")
    load.add_argument("-em", "--evaluation-mode", action="store_true", help="xvp: write all that aren't empty")
    load.add_argument("-lp", "--predicates", help="xvp: file with a predicate per line")
    load.add_argument("-pp", "--predicate-range", type=_span, help="xvp: positions a,b of the first predicates")
    load.add_argument("--stats", metavar="DATABASE", help="register the triples in this database and compute their statistics")
    query = sub.add_parser("query", aliases=["q"], help="run SPARQL files")
    query.add_argument("-d", "--database", required=True)
    query.add_argument("-i", "--input", required=True, help="a query file or a folder of them")
    query.add_argument("-f", "--format", required=True, choices=sorted(LAYOUTS))
    query.add_argument("-b", "--benchmark", action="store_true")
    query.add_argument("-c", "--count", action="store_true")
    query.add_argument("-e", "--expand", action="store_true", help="results with full IRIs instead of prefixes")
    query.add_argument("-x", "--explain", action="store_true", help="write algebra and plan beside the files")
    query.add_argument("-o", "--output", help="folder for results")
    query.add_argument("-r", "--report", help="file for a JSON line per query")
    query.add_argument("-rn", "--result-name", default="", help="prefix of result names")
    query.add_argument("-s", "--straight", action="store_true", help="join in the order of the text")
    query.add_argument("-S", "--shuffle", action="store_true", help="join by shuffle, never by broadcast")
    query.add_argument("-opt", "--optimize", action=argparse.BooleanOptionalAction, default=True, help="rewrites of the algebra, on by default")
    query.add_argument("--no-opt", dest="optimize", action="store_false", help=argparse.SUPPRESS)
    query.add_argument("-t", "--threshold", type=float, default=1.0, help="xvp: largest selectivity to use")
    query.add_argument("-sp", "--partitions", type=int, help="shuffle partitions")
    for command in (load, query):
        command.add_argument("--set", action="append", default=[], metavar="OPTION=VALUE", help="a session option of Spark")
        command.add_argument("--codec", default="snappy", help="compression of the Parquet files that are written")
    return top


@contextlib.contextmanager
def _options(spark: SparkSession, args: argparse.Namespace) -> Iterator[None]:
    """The session options that the arguments ask for, for the time of the command."""
    asked = {"spark.sql.parquet.compression.codec": args.codec}
    if args.shuffle:
        asked |= {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    if getattr(args, "partitions", None):
        asked["spark.sql.shuffle.partitions"] = str(args.partitions)
    asked |= dict(x.split("=", 1) for x in args.set)
    before = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    with _options(spark, args):
        return _load(spark, args) if args.command in ("load", "l") else _query(spark, args)


def _load(spark: SparkSession, args: argparse.Namespace) -> int:
    prefixes = read_prefixes(spark, args.prefix_file) if args.prefix_file else None
    names = (args.column_name_subject, args.column_name_predicate, args.column_name_object)
    if args.parquet:
        triples = cleaned(read_table(spark, args.input, names), prefixes, args.strip_dot, args.unique)
    else:
        triples = load_text(
            spark, args.input, prefixes, delimited=not args.ntriples, field=args.field_separator, line=args.line_separator,
            columns=tuple(args.columns.split(",")), dot=args.strip_dot, unique=args.unique, malformed=args.malformed,
        )
    store = GraphStore.create(triples, args.database, prefixes, args.mode)
    if args.format == "xvp":
        listed = None
        if args.predicates:
            listed = [r[0].strip() for r in spark.read.text(args.predicates).collect() if r[0].strip()]
        BUILDERS["xvp"](store, args.threshold, args.types.split(","), listed, args.predicate_range, args.evaluation_mode, args.keep)
    elif args.format != "tt":
        BUILDERS[args.format](store, mode="ignore" if args.mode == "ignore" else "errorifexists", keep=args.keep)
    if args.output:
        store.triples().toDF(*names).write.mode("overwrite").saveAsTable(args.output)
    if args.stats:
        store.compute_stats(args.stats)
    print(json.dumps({"predicates": len(store.predicates), "triples": sum(p.rows for p in store.predicates.values())}))
    return 0


def _query(spark: SparkSession, args: argparse.Namespace) -> int:
    options = {"threshold": args.threshold} if args.format == "xvp" else {}
    engine = Engine.open(spark, args.database, args.format, optimizer=args.optimize, written_order=args.straight, **options)
    for r in run_files(engine, args.input, args.count, args.benchmark, args.output, args.report, args.result_name, args.explain, args.expand):
        print(json.dumps(vars(r)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
