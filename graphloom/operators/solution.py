"""Solution sequences: DataFrames with a column per variable, and how they are joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that every row of the side with an unbound variable is sent to, where nothing else is shared.
SPREAD = 16
#: Beyond so many shared variables that may be unbound, sides aren't split by which of them are.
MOST_SPLIT = 4

Lookup = Callable[[str], Column | None]
Condition = Callable[[Lookup], Column]


@dataclass(frozen=True)
class Solution:
    """df has a string column for each variable; definite ones are bound in every row."""

    df: DataFrame
    definite: frozenset[str]

    @property
    def vars(self) -> list[str]:
        return self.df.columns

    def shared(self, other: Solution) -> list[str]:
        return [v for v in self.vars if v in other.vars]

    def certain(self, other: Solution) -> bool:
        return all(v in self.definite and v in other.definite for v in self.shared(other))

    def column(self, name: str) -> Column | None:
        return _c(name) if name in self.vars else None

    def loose(self, shared: list[str]) -> list[str]:
        return [v for v in shared if v not in self.definite]


@dataclass(frozen=True)
class Keys:
    """Columns that an equality of two variables makes join keys: a pair(left, right) is equal where the equality can hold."""

    pairs: tuple[tuple[Column, Column], ...] = ()


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _aside(s: Solution, shared: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """The right side with its shared variables under other names."""
    return s.df.select(*[_c(v).alias(f"__r_{v}" if v in shared else v) for v in s.vars], *extra)


def _compatible(left: Solution, right: Solution, shared: list[str]) -> Column:
    """Equal where both are bound. Definite variables are plain equalities, which join by hash."""
    out = F.lit(True)
    for v in shared:
        a, b = _c(v), _c(f"__r_{v}")
        same = a == b
        if v not in left.definite:
            same = same | a.isNull()
        if v not in right.definite:
            same = same | b.isNull()
        out = out & same
    return out


def _lookup(left: Solution, right: Solution, shared: list[str]) -> Lookup:
    """The variables of both sides, merged."""

    def lookup(name: str) -> Column | None:
        if name in shared:
            return F.coalesce(_c(name), _c(f"__r_{name}"))
        return _c(name) if name in left.vars or name in right.vars else None

    return lookup


def _merged(both: DataFrame, left: Solution, right: Solution, shared: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    out = [F.coalesce(_c(v), _c(f"__r_{v}")).alias(v) if v in shared else _c(v) for v in left.vars]
    return both.select(*out, *[_c(v) for v in right.vars if v not in shared], *also)


def _splits(names: list[str], df: DataFrame, mark: str = "") -> Iterator[tuple[set[str], DataFrame]]:
    """(unbound, rows): the rows by which of the names are unbound; every row is in one of them."""
    for n in range(len(names) + 1):
        for unbound in combinations(names, n):
            rows = df
            for v in names:
                c = _c(mark + v)
                rows = rows.where(c.isNull() if v in unbound else c.isNotNull())
            yield set(unbound), rows


def _spread(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a key __k on which every row of one meets every row of the other.

    The left side's rows go to SPREAD tasks each, the right side's to one of them: an equi-join that
    spills and needs no side to fit in memory.
    """
    left = left.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = F.pmod(F.xxhash64(*[_c(v) for v in right.columns]) if right.columns else F.rand(1).cast("long"), F.lit(SPREAD)).cast("int")
    return left, right.withColumn("__k_r", dealt)


def _inner(left: Solution, right: Solution, shared: list[str], condition: Condition | None = None, keys: Keys = Keys()) -> DataFrame:
    """The rows of both sides that are compatible, not merged yet: the right one's shared variables have __r_ before their name.

    A join needs an equality. Variables that are bound on both sides give one. Where there is none,
    both sides are split by which of the shared variables are unbound, so that the bound part still
    joins by equality and only rows that are compatible with everything meet everything.
    """
    lookup = _lookup(left, right, shared)

    def joined(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
        for i, (x, y) in enumerate(keys.pairs):
            a, b, on = a.withColumn(f"__x{i}", x), b.withColumn(f"__y{i}", y), on & (_c(f"__x{i}") == _c(f"__y{i}"))
        return a.join(b, on & condition(lookup) if condition is not None else on)

    aside = _aside(right, shared)
    uncertain = left.loose(shared) + right.loose(shared)
    sure = [v for v in shared if v not in uncertain]
    if keys.pairs or sure or not uncertain and shared or len(uncertain) > MOST_SPLIT:
        return joined(left.df, aside, _compatible(left, right, shared))
    parts = []
    for no_left, a in _splits(left.loose(shared), left.df):
        for no_right, b in _splits(right.loose(shared), aside, "__r_"):
            same = [v for v in shared if v not in no_left | no_right]
            if same:
                parts.append(joined(a, b, reduce(Column.__and__, [_c(v) == _c(f"__r_{v}") for v in same])))
            else:
                a_, b_ = _spread(a, b)
                parts.append(joined(a_, b_, F.col("__k") == F.col("__k_r")))
    names = [*left.vars, *aside.columns]
    return reduce(DataFrame.unionByName, [p.select(*map(_c, names)) for p in parts])


def join(left: Solution, right: Solution, keys: Keys = Keys()) -> Solution:
    """Inner join on all shared variables; without any and without keys, every pair."""
    shared, definite = left.shared(right), left.definite | right.definite
    if not shared and not keys.pairs:
        return Solution(left.df.crossJoin(right.df), definite)
    if left.certain(right) and not keys.pairs:
        return Solution(left.df.join(right.df, shared), definite)
    return Solution(_merged(_inner(left, right, shared, keys=keys), left, right, shared), definite)


def left_join(left: Solution, right: Solution, condition: Condition | None = None, keys: Keys = Keys()) -> Solution:
    """OPTIONAL: condition(lookup) is part of the join; it sees the merged variables of both sides."""
    shared = left.shared(right)
    definite = left.definite
    if left.certain(right) and not keys.pairs and condition is None and shared:
        return Solution(left.df.join(right.df, shared, "left"), definite)
    sure = [v for v in shared if v in left.definite and v in right.definite]
    if sure or keys.pairs or not left.vars:
        a, b, on = left.df, _aside(right, shared), _compatible(left, right, shared)
        for i, (x, y) in enumerate(keys.pairs):
            a, b, on = a.withColumn(f"__x{i}", x), b.withColumn(f"__y{i}", y), on & (_c(f"__x{i}") == _c(f"__y{i}"))
        on = on & condition(_lookup(left, right, shared)) if condition is not None else on
        return Solution(_merged(a.join(b, on, "left"), left, right, shared), definite)
    if not shared:
        a, b = _spread(left.df, right.df)
        on = F.col("__k") == F.col("__k_r")
        both = a.join(b, on & condition(_lookup(left, right, shared)) if condition is not None else on)
    else:
        both = _inner(left, right, shared, condition)
    # what found no partner: rows that are equal share their fate, so their values tell them apart well enough
    own = [f"__o_{v}" for v in left.vars]
    both = both.select("*", *[_c(v).alias(o) for v, o in zip(left.vars, own, strict=True)])
    hit = both.select(*map(_c, own)).distinct()
    missed = left.df.join(hit, reduce(Column.__and__, [_c(v).eqNullSafe(_c(o)) for v, o in zip(left.vars, own, strict=True)]), "left_anti")
    return Solution(_merged(both, left, right, shared).unionByName(missed, allowMissingColumns=True), definite)


def minus(left: Solution, right: Solution) -> Solution:
    """Drop rows that a row of the right side is compatible with and shares a bound variable with."""
    shared = left.shared(right)
    if not shared:
        return left
    if left.certain(right):
        return Solution(left.df.join(right.df.select(*map(_c, shared)), shared, "left_anti"), left.definite)
    right_only = _aside(right, shared).select(*[_c(f"__r_{v}") for v in shared])
    sure = [v for v in shared if v in left.definite and v in right.definite]
    if sure or len(left.loose(shared)) + len(right.loose(shared)) > MOST_SPLIT:
        some = reduce(Column.__or__, [_c(v).isNotNull() & _c(f"__r_{v}").isNotNull() for v in shared])
        return Solution(left.df.join(right_only, _compatible(left, right, shared) & some, "left_anti"), left.definite)
    parts = []
    for no_left, a in _splits(left.loose(shared), left.df):
        for no_right, b in _splits(right.loose(shared), right_only, "__r_"):
            if same := [v for v in shared if v not in no_left | no_right]:
                a = a.join(b, reduce(Column.__and__, [_c(v) == _c(f"__r_{v}") for v in same]), "left_anti")
        parts.append(a)
    return Solution(reduce(DataFrame.unionByName, parts), left.definite)


def exists(left: Solution, right: Solution, negated: bool, condition: Condition | None = None, keys: Keys = Keys()) -> Solution:
    """FILTER (NOT) EXISTS: a semi or anti join on the shared variables; condition(lookup) sees both sides."""
    shared, how = left.shared(right), "left_anti" if negated else "left_semi"
    if condition is None and not shared:
        there = right.df.limit(1).agg((F.count("*") > 0).alias("there")).scalar()
        return Solution(left.df.where(~there if negated else there), left.definite)
    if condition is None and left.certain(right):
        return Solution(left.df.join(right.df.select(*map(_c, shared)), shared, how), left.definite)
    a, b, on = left.df, _aside(right, shared), _compatible(left, right, shared)
    for i, (x, y) in enumerate(keys.pairs):
        a, b, on = a.withColumn(f"__x{i}", x), b.withColumn(f"__y{i}", y), on & (_c(f"__x{i}") == _c(f"__y{i}"))
    if condition is not None:
        on = on & condition(_lookup(left, right, shared))
    sure = [v for v in shared if v in left.definite and v in right.definite]
    loose = left.loose(shared)
    if sure or keys.pairs or right.loose(shared) or not loose or len(loose) > MOST_SPLIT:
        return Solution(a.join(b, on, how).select(*map(_c, left.vars)), left.definite)
    # only the left side may be unbound: its rows are dealt to one join for each set of unbound variables
    parts = []
    for unbound, rows in _splits(loose, left.df):
        same = [_c(v) == _c(f"__r_{v}") for v in shared if v not in unbound]
        if not same and condition is None:
            there = right.df.limit(1).agg((F.count("*") > 0).alias("there")).scalar()
            parts.append(rows.where(~there if negated else there))
            continue
        part_on = reduce(Column.__and__, same, F.lit(True))
        if condition is not None:
            part_on = part_on & condition(_lookup(left, right, shared))
        parts.append(rows.join(_aside(right, shared), part_on, how))
    return Solution(reduce(DataFrame.unionByName, parts), left.definite)


def marked(left: Solution, right: Solution, name: str, condition: Condition | None = None) -> Solution:
    """left with a boolean column name: whether a row of the right side is compatible with it and meets the condition.

    For EXISTS inside a larger expression. Left rows of the same values share the answer, so the keys that
    are found come back by an equality join on all of left's columns.
    """
    there = exists(left, right, False, condition)
    own = [f"__o_{v}" for v in left.vars]
    if not own:
        return Solution(left.df.withColumn(name, there.df.limit(1).agg((F.count("*") > 0).alias("there")).scalar()), left.definite)
    hit = there.df.select(*[_c(v).alias(o) for v, o in zip(left.vars, own, strict=True)]).distinct().withColumn(name, F.lit(True))
    on = reduce(Column.__and__, [_c(v).eqNullSafe(_c(o)) for v, o in zip(left.vars, own, strict=True)])
    both = left.df.join(hit, on, "left")
    return Solution(both.select(*map(_c, left.vars), F.coalesce(_c(name), F.lit(False)).alias(name)), left.definite)


def union(left: Solution, right: Solution) -> Solution:
    """All rows of both sides by name; what a side lacks is null."""
    return Solution(left.df.unionByName(right.df, allowMissingColumns=True), left.definite & right.definite)
