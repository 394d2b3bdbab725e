"""The public API: open or build a graph, ask it SPARQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import Prefixes
from graphloom.layouts.base import Layout
from graphloom.layouts.property import NestedPropertyTable, PropertyTable, build_flat, build_nested
from graphloom.layouts.reductions import Reductions, SingleTable, build_reductions, build_single
from graphloom.layouts.triples import TripleTable
from graphloom.operators.compile import Compiler
from graphloom.plans.algebra import pretty
from graphloom.plans.optimize import optimize
from graphloom.plans.parser import parse
from graphloom.storage import GraphStore

LAYOUTS: dict[str, type[Layout]] = {x.name: x for x in (TripleTable, PropertyTable, NestedPropertyTable, SingleTable, Reductions)}
BUILDERS = {"pt": build_flat, "cpt": build_nested, "st": build_single, "xvp": build_reductions}


class Engine:
    """SPARQL over one layout of a graph."""

    def __init__(self, store: GraphStore, layout: str = "tt", optimizer: bool = True, written_order: bool = False, **options) -> None:
        """optimizer: algebra rewrites; written_order: join in the order of the query's text; options are the layout's, e.g. threshold."""
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout!r}; known are {sorted(LAYOUTS)}")
        self.store, self.optimizer = store, optimizer
        self.layout = LAYOUTS[layout](store, reorder=not written_order, **options)

    @staticmethod
    def open(spark: SparkSession, path: str, layout: str = "tt", **options) -> Engine:
        return Engine(GraphStore(spark, path), layout, **options)

    @staticmethod
    def load(triples: DataFrame, path: str, layouts: tuple[str, ...] = (), prefixes: Prefixes | None = None, mode: str = "errorifexists", **options) -> GraphStore:
        """Write the triple table and the named layouts; options go to the layout's builder."""
        store = GraphStore.create(triples, path, prefixes, mode)
        for layout in layouts:
            if layout != "tt":
                BUILDERS[layout](store, **options.get(layout, {}))
        return store

    def query(self, sparql: str) -> DataFrame:
        """The result as a lazy DataFrame: a column of encoded terms for each variable.

        Variables that differ by case alone are two columns, which Spark tells apart by name only
        under spark.sql.caseSensitive.
        """
        asked = parse(sparql)
        df = Compiler(self.layout).query(optimize(asked.op) if self.optimizer else asked.op)
        if asked.shown:
            df = df.toDF(*[asked.shown.get(c, c) for c in df.columns])
        return df

    def expanded(self, sparql: str) -> DataFrame:
        """The result with full IRIs instead of compacted ones."""
        df = self.query(sparql)
        names, inside = df.columns, [f"c{i}" for i in range(len(df.columns))]
        whole = self.store.prefixes.full_column
        out = [whole(F.col(c)).alias(c) if t == "string" else F.col(c) for c, (_, t) in zip(inside, df.dtypes, strict=True)]
        return df.toDF(*inside).select(*out).toDF(*names)

    def count(self, sparql: str) -> int:
        return self.query(sparql).count()

    def explain(self, sparql: str, mode: str = "formatted") -> str:
        """The query, its algebra before and after the rewrites, and Spark's plan; nothing is run."""
        op = parse(sparql).op
        df = self.query(sparql)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
        return "\n".join(["== Query ==", sparql.strip(), "== Algebra ==", pretty(op), "== Optimized ==", pretty(optimize(op)), "== Plan ==", plan])
