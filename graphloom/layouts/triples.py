"""The triple table, partitioned by predicate."""

from __future__ import annotations

from graphloom.layouts.base import Layout
from graphloom.operators.solution import Solution
from graphloom.plans.algebra import Triple


class TripleTable(Layout):
    """One scan a pattern. A constant predicate prunes to one partition."""

    name = "tt"

    def bgp(self, triples: tuple[Triple, ...]) -> Solution:
        return self.joined([self.scan(t) for t in self.ordered(triples)])
