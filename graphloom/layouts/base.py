"""What layouts share: scans of single patterns, and joins that follow shared variables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.terms import Term, Var
from graphloom.operators import solution as S
from graphloom.operators.solution import Solution
from graphloom.plans.algebra import Triple
from graphloom.plans.optimize import components, in_join_order
from graphloom.storage import GraphStore


class Layout(ABC):
    """bgp(triples) is the one thing a layout has to answer."""

    name: str

    def __init__(self, store: GraphStore, reorder: bool = True) -> None:
        self.store, self.reorder = store, reorder

    @abstractmethod
    def bgp(self, triples: tuple[Triple, ...]) -> Solution: ...

    def ordered(self, triples: tuple[Triple, ...]) -> list[Triple]:
        """In join order by the sizes of the predicates, or as written."""
        return in_join_order(list(triples), self.estimate) if self.reorder else list(triples)

    def encode(self, term: Term) -> str:
        return self.store.prefixes.encode(term)

    def estimate(self, t: Triple) -> float:
        """Rows that a pattern gives, from the catalog."""
        if isinstance(t.p, Var):
            rows, subjects, objects = (float(sum(getattr(p, k) for p in self.store.predicates.values())) for k in ("rows", "subjects", "objects"))
        elif (known := self.store.predicates.get(self.encode(t.p))) is None:
            return 0.0
        else:
            rows, subjects, objects = float(known.rows), float(known.subjects), float(known.objects)
        if not isinstance(t.s, Var):
            rows /= max(subjects, 1.0)
        if not isinstance(t.o, Var):
            rows /= max(objects, 1.0)
        return rows

    def nothing(self, names: list[str]) -> Solution:
        df = self.store.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names) if names else "__ string")
        return Solution(df if names else df.select(), frozenset(names))

    def one(self) -> Solution:
        """The solution of an empty pattern: one row that binds nothing."""
        return Solution(self.store.spark.range(1).select(), frozenset())

    def pattern(self, rows: DataFrame, parts: list[tuple[Term, str]]) -> Solution:
        """rows restricted to the constants of parts(term, column) and shown as their variables."""
        conditions: list[Column] = []
        shown: dict[str, str] = {}
        for term, column in parts:
            c = F.col(f"`{column}`")
            if not isinstance(term, Var):
                conditions.append(c == self.encode(term))
            elif term.name in shown:
                conditions.append(c == F.col(f"`{shown[term.name]}`"))
            else:
                shown[term.name] = column
        df = reduce(DataFrame.where, conditions, rows)
        if not shown:  # a statement about constants: is it there?
            return Solution(df.limit(1).select(), frozenset())
        return Solution(df.select(*[F.col(f"`{c}`").alias(v) for v, c in shown.items()]), frozenset(shown))

    def scan(self, t: Triple) -> Solution:
        """A pattern on the triple table; a constant predicate reads its partition alone."""
        if isinstance(t.p, Var):
            return self.pattern(self.store.triples(), [(t.s, "s"), (t.p, "p"), (t.o, "o")])
        return self.pattern(self.store.vertical(self.encode(t.p)), [(t.s, "s"), (t.o, "o")])

    def joined(self, parts: list[Solution]) -> Solution:
        """Inner join of all parts: within each component along shared variables, then across components."""
        if not parts:
            return self.one()
        groups = components([set(p.vars) for p in parts])
        out = []
        for group in groups:
            left = [parts[i] for i in group]
            now = left.pop(0)
            while left:
                # the part with most shared variables next; parts come in the order they should be joined
                best = max(range(len(left)), key=lambda i: (len(now.shared(left[i])), -i))
                now = S.join(now, left.pop(best))
            out.append(now)
        return reduce(S.join, out)
