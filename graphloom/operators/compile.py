"""Algebra to DataFrames over any layout."""

from __future__ import annotations

from functools import singledispatchmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphloom.functions import terms as T
from graphloom.functions.expressions import ExpressionCompiler, Value
from graphloom.layouts.base import Layout
from graphloom.operators import solution as S
from graphloom.operators.solution import Keys, Solution
from graphloom.plans import algebra as A
from graphloom.plans.optimize import equated, lifted


class Compiler:
    def __init__(self, layout: Layout) -> None:
        self.layout, self.spark, self.prefixes = layout, layout.store.spark, layout.store.prefixes

    def query(self, op: A.Op) -> DataFrame:
        """The result: visible variables as encoded terms. ASK gives one row with a boolean column ``ask``."""
        return self.run(op).df

    def expressions(self, s: Solution) -> ExpressionCompiler:
        return ExpressionCompiler(self.prefixes, s.column)

    def term(self, s: Solution, e: A.Expr) -> Column:
        compiler = self.expressions(s)
        return compiler.term(compiler.value(e))

    @singledispatchmethod
    def run(self, op: A.Op) -> Solution:
        raise A.UnsupportedFeature(type(op).__name__)

    @run.register
    def _(self, op: A.BGP) -> Solution:
        return self.layout.bgp(op.triples)

    @run.register
    def _(self, op: A.Join) -> Solution:
        left, right = self.run(op.left), self.run(op.right)
        pairs = [(left.column(a), right.column(b)) for a, b in op.on]
        return S.join(left, right, Keys(tuple((T.canonical(x), T.canonical(y)) for x, y in pairs if x is not None and y is not None)))

    @run.register
    def _(self, op: A.LeftJoin) -> Solution:
        if any(A.exists_in(c) for c in op.conditions):
            return self.optional_exists(op)
        left, right = self.run(op.left), self.run(op.right)
        return S.left_join(left, right, self.all_of(op.conditions), self.keys(op.conditions, left, right))

    def optional_exists(self, op: A.LeftJoin) -> Solution:
        """OPTIONAL with EXISTS in its condition: the joined rows that meet it, and the left rows that none of them has."""
        left, both = self.run(op.left), A.Join(op.left, op.right)
        for c in op.conditions:
            both = A.Filter(c, both)
        found = self.run(both)
        own = Solution(found.df.select(*[f"`{v}`" for v in left.vars]), left.definite)
        if any(v not in left.definite for v in left.vars if v in A.in_scope(op.right)):
            raise A.UnsupportedFeature("EXISTS as a condition of OPTIONAL on a variable that may be unbound")
        kept = [F.col(f"`{v}`").alias(f"__o_{v}") for v in left.vars]
        hit = own.df.select(*kept).distinct()
        on = F.lit(True)
        for v in left.vars:
            on = on & F.col(f"`{v}`").eqNullSafe(F.col(f"`__o_{v}`"))
        return Solution(found.df.unionByName(left.df.join(hit, on, "left_anti"), allowMissingColumns=True), left.definite)

    def all_of(self, conditions: tuple[A.Expr, ...]) -> S.Condition | None:
        """The conditions of a join as one Column of the variables that it sees."""
        if not conditions:
            return None

        def condition(lookup: S.Lookup) -> Column:
            compiler = ExpressionCompiler(self.prefixes, lookup)
            out = F.lit(True)
            for c in conditions:
                out = out & compiler.condition(c)
            return out

        return condition

    def keys(self, conditions: tuple[A.Expr, ...], left: Solution, right: Solution) -> Keys:
        """The join keys that equalities among the conditions give; the conditions still decide."""
        pairs = [equated(c, set(left.vars), set(right.vars)) for c in conditions]
        return Keys(tuple((T.canonical(left.column(p[0])), T.canonical(right.column(p[1]))) for p in pairs if p is not None))

    def inner(self, e: A.Exists, left: Solution) -> tuple[Solution, tuple[A.Expr, ...]]:
        """The pattern of an EXISTS and the conditions that it shares with the variables around it."""
        pattern, conditions = lifted(e.pattern, set(left.vars))
        if hidden := A.outer_vars(pattern) & set(left.vars) - set(A.in_scope(pattern)):
            raise A.UnsupportedFeature(f"?{min(hidden)} of the pattern around EXISTS inside a part of it that isn't a filter of its own")
        return self.run(pattern), tuple(conditions)

    @run.register
    def _(self, op: A.Union) -> Solution:
        return S.union(self.run(op.left), self.run(op.right))

    @run.register
    def _(self, op: A.Minus) -> Solution:
        return S.minus(self.run(op.left), self.run(op.right))

    @run.register
    def _(self, op: A.Filter) -> Solution:
        child = self.run(op.child)
        if isinstance(op.condition, A.Exists):
            right, conditions = self.inner(op.condition, child)
            return S.exists(child, right, op.condition.negated, self.all_of(conditions), self.keys(conditions, child, right))
        bound = frozenset(_requires(op.condition)) & frozenset(child.vars)
        names, marks, now = child.vars, {}, child
        for i, e in enumerate(A.exists_in(op.condition)):
            right, conditions = self.inner(e, child)
            marks[id(e)] = f"__m{i}"
            now = S.marked(now, right, f"__m{i}", self.all_of(conditions))
        compiler = ExpressionCompiler(self.prefixes, child.column, lambda e: ~F.col(marks[id(e)]) if e.negated else F.col(marks[id(e)]))
        df = now.df.where(compiler.condition(op.condition))
        return Solution(df.select(*[f"`{v}`" for v in names]) if marks else df, child.definite | bound)

    @run.register
    def _(self, op: A.Extend) -> Solution:
        child = self.run(op.child)
        c = self.term(child, op.expr)
        sure = isinstance(op.expr, A.Const) or isinstance(op.expr, A.Ref) and op.expr.name in child.definite
        return Solution(child.df.withColumn(op.name, c), child.definite | ({op.name} if sure else set()))

    @run.register
    def _(self, op: A.Values) -> Solution:
        schema = ST.StructType([ST.StructField(n, ST.StringType()) for n in op.names])
        rows = [tuple(None if t is None else self.prefixes.encode(t) for t in row) for row in op.rows]
        definite = {n for i, n in enumerate(op.names) if rows and all(r[i] is not None for r in rows)}
        return Solution(self.spark.createDataFrame(rows, schema), frozenset(definite))

    @run.register
    def _(self, op: A.Group) -> Solution:
        child = self.run(op.child)
        df = child.df
        for k in op.keys:
            if k not in df.columns:
                df = df.withColumn(k, F.lit(None).cast("string"))
        child = Solution(df, child.definite)
        out = df.groupBy(*[F.col(f"`{k}`") for k in op.keys]).agg(
            *[self.aggregate(child, a).alias(n) for n, a in op.aggregates] or [F.lit(1).alias("__one")]
        )
        counted = {n for n, a in op.aggregates if a.name == "count"}
        names = [*op.keys, *(n for n, _ in op.aggregates)]
        return Solution(out.select(*[f"`{n}`" for n in names]), (child.definite & set(op.keys)) | counted)

    def aggregate(self, s: Solution, a: A.Aggregate) -> Column:
        compiler = self.expressions(s)
        as_term = lambda kind, c: compiler.term(Value(kind, c))
        if a.arg is None:
            return as_term("int", F.count_distinct(*[F.col(f"`{v}`") for v in s.vars]) if a.distinct else F.count("*"))
        value = compiler.value(a.arg)
        term, number = compiler.term(value), compiler.number(value)
        if a.name == "count":
            return as_term("int", F.count_distinct(term) if a.distinct else F.count(term))
        if a.name in ("sum", "avg"):
            # an error in one row is an error of the whole; no rows at all sum up to 0
            total, n = (F.sum_distinct(number), F.count_distinct(number)) if a.distinct else (F.sum(number), F.count(number))
            out = total if a.name == "sum" else F.try_divide(total, n)
            return F.when(F.count_if(number.isNull()) == 0, as_term("num", F.coalesce(out, F.lit(0.0))))
        if a.name in ("min", "max"):
            # numbers are below other terms, as in ORDER BY; what is unbound doesn't count
            best = {"min": F.min, "max": F.max}[a.name]
            return best(F.when(term.isNotNull(), F.struct(number.isNull().alias("other"), number.alias("n"), term.alias("t"))))["t"]
        if a.name == "sample":
            return F.min(term)
        text = compiler.text(value)
        parts = F.array_sort(F.collect_set(text) if a.distinct else F.collect_list(text))
        return as_term("str", F.array_join(parts, a.separator))

    @run.register
    def _(self, op: A.Project) -> Solution:
        return _projected(self.run(op.child), op.names)

    @run.register
    def _(self, op: A.Distinct) -> Solution:
        """Rows are made distinct before they are sorted: a hash of them would lose the order."""
        if isinstance(op.child, A.Project) and isinstance(op.child.child, A.OrderBy):
            return self.distinct_sorted(op.child.names, op.child.child)
        child = self.run(op.child)
        return Solution(child.df.distinct(), child.definite)

    def distinct_sorted(self, names: tuple[str, ...], order: A.OrderBy) -> Solution:
        """Distinct rows of names in the order of their first solution."""
        child = self.run(order.child)
        if set().union(*(A.expr_vars(e) for e, _ in order.keys)) <= set(names):
            out = _projected(child, names)
            out = Solution(out.df.distinct(), out.definite)
            return Solution(out.df.orderBy(*self.sort_keys(out, order)), out.definite)
        keys = self.sort_keys(child, order)
        shown = [F.col(f"`{n}`") for n in names if n in child.vars]
        first = Window.partitionBy(*shown or [F.lit(1)]).orderBy(*keys)
        rows = child.df.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
        return _projected(Solution(rows.orderBy(*keys), child.definite), names)

    @run.register
    def _(self, op: A.Reduced) -> Solution:
        """Duplicates may go or stay: they stay, which costs nothing."""
        return self.run(op.child)

    @run.register
    def _(self, op: A.OrderBy) -> Solution:
        child = self.run(op.child)
        return Solution(child.df.orderBy(*self.sort_keys(child, op)), child.definite)

    def sort_keys(self, s: Solution, order: A.OrderBy) -> list[Column]:
        """Unbound first, then numbers by value and others by their characters."""
        compiler = self.expressions(s)
        keys = []
        for e, up in order.keys:
            v = compiler.value(e)
            number, text = compiler.number(v), compiler.text(v)
            rank = F.when(text.isNull(), 0).when(number.isNotNull(), 1).otherwise(2)
            keys += [k.asc() if up else k.desc() for k in (rank, number, text)]
        return keys

    @run.register
    def _(self, op: A.Slice) -> Solution:
        child = self.run(op.child)
        df = child.df.offset(op.offset) if op.offset else child.df
        return Solution(df.limit(op.limit) if op.limit is not None else df, child.definite)

    @run.register
    def _(self, op: A.Ask) -> Solution:
        child = self.run(op.child)
        return Solution(child.df.limit(1).agg((F.count("*") > 0).alias("ask")), frozenset({"ask"}))


def _projected(s: Solution, names: tuple[str, ...]) -> Solution:
    out = [F.col(f"`{n}`") if n in s.vars else F.lit(None).cast("string").alias(n) for n in names]
    return Solution(s.df.select(*out), s.definite & set(names))


def _requires(e: A.Expr) -> set[str]:
    """Variables that a true condition must have bound."""
    if isinstance(e, A.Call) and e.name == "&&":
        return set().union(*map(_requires, e.args))
    if isinstance(e, A.Call) and e.name in ("=", "!=", "<", "<=", ">", ">=", "regex", "langmatches", "contains", "strstarts", "strends", "sameterm"):
        return set().union(*[a_vars for a in e.args if (a_vars := _strict(a))] or [set()])
    if isinstance(e, A.Call) and e.name == "bound" and isinstance(e.args[0], A.Ref):
        return {e.args[0].name}
    return set()


def _strict(e: A.Expr) -> set[str]:
    """Variables without which an expression is an error."""
    if isinstance(e, A.Ref):
        return {e.name}
    if isinstance(e, A.Call) and e.name in ("+", "-", "*", "/", "neg", "str", "lang") or isinstance(e, A.Call) and e.name.startswith("cast:"):
        return set().union(*map(_strict, e.args))
    return set()
