"""Property tables: one wide row a subject, arrays for multi-valued predicates, or one row a combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphloom.functions.terms import Var
from graphloom.layouts.base import Layout
from graphloom.operators.solution import Solution
from graphloom.plans.algebra import Triple
from graphloom.storage import GraphStore, Predicate

NESTED, FLAT = "nested_property_table", "property_table"


def nested_schema(store: GraphStore) -> ST.StructType:
    text = ST.StringType()
    fields = [ST.StructField(p.column, ST.ArrayType(text) if p.multi else text) for p in store.predicates.values()]
    return ST.StructType([ST.StructField("s", text), *fields])


def flat_schema(store: GraphStore) -> ST.StructType:
    return ST.StructType([ST.StructField(c, ST.StringType()) for c in ("s", *(p.column for p in store.predicates.values()))])


def pivoted(store: GraphStore) -> DataFrame:
    """One row a subject: one aggregation, with the predicates known from the catalog."""
    wide = store.triples().groupBy("s").pivot("p", list(store.predicates)).agg(F.collect_list("o"))
    columns = [F.col("s")]
    for term, p in store.predicates.items():
        values = F.col(f"`{term}`")
        columns.append((F.when(F.size(values) > 0, values) if p.multi else F.get(values, F.lit(0))).alias(p.column))
    return wide.select(*columns)


def build_nested(store: GraphStore, mode: str = "errorifexists", keep: bool = False) -> None:
    store.write(pivoted(store), NESTED, mode)


def build_flat(store: GraphStore, mode: str = "errorifexists", keep: bool = False) -> None:
    """The product of a subject's values: its rows grow with every multi-valued predicate."""
    out = pivoted(store)
    for p in store.predicates.values():
        if p.multi:
            out = out.withColumn(p.column, F.explode_outer(p.column))
    store.write(out, FLAT, mode)


def load_properties(store: GraphStore) -> DataFrame:
    """(p, is_complex): 1 for predicates with several values for some subject."""
    pairs = store.triples().groupBy("p", "s").count()
    return pairs.groupBy("p").agg((F.max("count") > 1).cast("int").alias("is_complex"))


class _Stars(Layout):
    """Patterns with one subject and constant predicates are read together."""

    def bgp(self, triples: tuple[Triple, ...]) -> Solution:
        stars: dict[object, list[Triple]] = {}
        parts: list[tuple[float, int, Solution]] = []
        loose: list[Triple] = []
        for t in self.ordered(triples):
            if isinstance(t.p, Var):
                loose.append(t)
            else:
                stars.setdefault(t.s, []).append(t)
        n = 0
        for star in stars.values():
            if any(self.encode(t.p) not in self.store.predicates for t in star):
                return self.nothing(sorted(set().union(*(t.vars() for t in triples))))
            for group in self.groups(star):
                parts.append((min(map(self.estimate, group)), n, self.star(group)))
                n += 1
        for t in loose:
            parts.append((self.estimate(t), n, self.scan(t)))
            n += 1
        return self.joined([p for *_, p in sorted(parts, key=lambda x: x[:2])])

    def groups(self, star: list[Triple]) -> list[list[Triple]]:
        return [star]

    def star(self, group: list[Triple]) -> Solution:
        raise NotImplementedError

    def predicate(self, t: Triple) -> Predicate:
        return self.store.predicates[self.encode(t.p)]


class PropertyTable(_Stars):
    """Stars on the flat table. Rows that differ in other predicates alone are made one again."""

    name = "pt"

    def groups(self, star: list[Triple]) -> list[list[Triple]]:
        """A predicate once a group; a second pattern with it is joined on the subject."""
        out: list[list[Triple]] = []
        for t in star:
            fit = next((g for g in out if all(x.p != t.p for x in g)), None)
            if fit is None:
                out.append([t])
            else:
                fit.append(t)
        return out

    def star(self, group: list[Triple]) -> Solution:
        columns = [self.predicate(t).column for t in group]
        rows = self.store.read(FLAT, flat_schema(self.store)).select("s", *columns)
        for c in columns:
            rows = rows.where(F.col(c).isNotNull())
        # rows repeat if a multi-valued predicate is there that the group doesn't read
        own = {self.predicate(t).term for t in group}
        found = self.pattern(rows, [(group[0].s, "s"), *[(t.o, c) for t, c in zip(group, columns, strict=True)]])
        repeats = any(p.multi for p in self.store.predicates.values() if p.term not in own)
        hides = any(not isinstance(t.o, Var) and self.predicate(t).multi for t in group)
        return Solution(found.df.distinct(), found.definite) if (repeats or hides) and found.vars else found


class NestedPropertyTable(_Stars):
    """Stars on the nested table: constants by array_contains, variables by explode, in one pass of one row."""

    name = "cpt"

    def star(self, group: list[Triple]) -> Solution:
        columns = dict.fromkeys(self.predicate(t).column for t in group)
        rows = self.store.read(NESTED, nested_schema(self.store)).select("s", *columns)
        subject = group[0].s
        if not isinstance(subject, Var):
            rows = rows.where(F.col("s") == self.encode(subject))
        for c in columns:
            rows = rows.where(F.col(c).isNotNull())
        parts = [(subject, "s")]
        for t in group:
            p = self.predicate(t)
            if p.multi and not isinstance(t.o, Var):
                rows = rows.where(F.array_contains(p.column, self.encode(t.o)))
        for i, t in enumerate(group):
            p = self.predicate(t)
            if not p.multi:
                parts.append((t.o, p.column))
            elif isinstance(t.o, Var):
                rows = rows.withColumn(f"__x{i}", F.explode(p.column))
                parts.append((t.o, f"__x{i}"))
        return self.pattern(rows, parts)
