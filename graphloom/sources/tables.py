"""Relational Parquet tables as triples: ``table:key`` subjects, ``tpch:<column>`` predicates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import XSD, Prefixes, quoted

BASE = "http://example.org/"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "document")
PREFIXES = Prefixes({"tpch": BASE + "tpch#", "xsd": XSD, **{t: f"{BASE}{t}/" for t in TABLES}})


@dataclass(frozen=True)
class Mapping:
    """table and its key; literals: columns as plain literals; links: column -> table of the IRI; tagged: column -> language column."""

    table: str
    subject: str
    key: str
    literals: tuple[str, ...] = ()
    links: tuple[tuple[str, str], ...] = ()
    tagged: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Edge:
    """A distinct pair of key columns of a table as a multi-valued predicate."""

    table: str
    subject: tuple[str, str]
    predicate: str
    object: tuple[str, str]


MAPPINGS = (
    Mapping("region", "region", "r_regionkey", ("r_name",)),
    Mapping("nation", "nation", "n_nationkey", ("n_name",), (("n_regionkey", "region"),)),
    Mapping("customer", "customer", "c_custkey", ("c_name", "c_acctbal", "c_mktsegment"), (("c_nationkey", "nation"),)),
    Mapping("supplier", "supplier", "s_suppkey", ("s_name", "s_acctbal"), (("s_nationkey", "nation"),)),
    Mapping("part", "part", "p_partkey", ("p_name", "p_brand", "p_size")),
    Mapping("orders", "orders", "o_orderkey", ("o_orderstatus", "o_totalprice", "o_orderpriority"), (("o_custkey", "customer"),)),
    Mapping("documents", "document", "doc_id", ("source",), (), (("source", "lang"),)),
)
EDGES = (
    Edge("lineitem", ("orders", "l_orderkey"), "hasPart", ("part", "l_partkey")),
    Edge("lineitem", ("orders", "l_orderkey"), "hasSupplier", ("supplier", "l_suppkey")),
    Edge("lineitem", ("part", "l_partkey"), "suppliedBy", ("supplier", "l_suppkey")),
)


def _iri(table: str, column: str):
    return F.concat(F.lit(table + ":"), F.col(column).cast("string"))


def map_table(df: DataFrame, m: Mapping) -> DataFrame:
    """One pass over the table: an array of (p, o) a row, exploded. Null cells give no triple."""
    pairs = [(c, quoted(F.col(c).cast("string"))) for c in m.literals]
    pairs += [(c, _iri(table, c)) for c, table in m.links]
    pairs += [(f"{c}_tagged", F.concat(quoted(F.col(c).cast("string")), F.lit("@"), F.col(tag))) for c, tag in m.tagged]
    cells = F.array(*[F.struct(F.lit("tpch:" + c).alias("p"), o.alias("o")) for c, o in pairs])
    out = df.where(F.col(m.key).isNotNull()).select(_iri(m.subject, m.key).alias("s"), F.explode(cells).alias("x"))
    return out.select("s", "x.p", "x.o").where("o is not null")


def map_edge(df: DataFrame, e: Edge) -> DataFrame:
    ends = [F.col(e.subject[1]).alias("a"), F.col(e.object[1]).alias("b")]
    pairs = df.select(*ends).where("a is not null and b is not null").distinct()
    return pairs.select(_iri(e.subject[0], "a").alias("s"), F.lit("tpch:" + e.predicate).alias("p"), _iri(e.object[0], "b").alias("o"))


def tables_as_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's tables as a set of triples. Keys are unique and edges distinct, so no further distinct is needed."""
    parts = [map_table(spark.read.parquet(f"{sf_dir}/{m.table}.parquet"), m) for m in MAPPINGS]
    parts += [map_edge(spark.read.parquet(f"{sf_dir}/{e.table}.parquet"), e) for e in EDGES]
    return reduce(DataFrame.unionByName, parts)
