"""The SPARQL algebra: what a query means, before any layout is chosen."""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.functions.terms import Term, Var


class UnsupportedFeature(NotImplementedError):
    """Syntax that isn't supported is an error, never ignored."""


@dataclass(frozen=True)
class Triple:
    s: Term
    p: Term
    o: Term

    @property
    def terms(self) -> tuple[Term, Term, Term]:
        return self.s, self.p, self.o

    def vars(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}


# expressions


@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Call:
    """An operator or function by its lower-cased name."""

    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: Expr | None
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Exists:
    pattern: Op
    negated: bool


Expr = Const | Ref | Call | Aggregate | Exists


def expr_vars(e: Expr) -> set[str]:
    if isinstance(e, Ref):
        return {e.name}
    if isinstance(e, Call):
        return set().union(*map(expr_vars, e.args)) if e.args else set()
    if isinstance(e, Aggregate):
        return expr_vars(e.arg) if e.arg is not None else set()
    return set()


def exists_in(e: Expr) -> list[Exists]:
    """The EXISTS of an expression, from left to right."""
    if isinstance(e, Exists):
        return [e]
    return [x for a in e.args for x in exists_in(a)] if isinstance(e, Call) else []


# operators


@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Join:
    """on: pairs of a left and a right variable that a filter above wants to be equal. They help to join; the filter decides."""

    left: Op
    right: Op
    on: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class LeftJoin:
    left: Op
    right: Op
    conditions: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Union:
    left: Op
    right: Op


@dataclass(frozen=True)
class Minus:
    left: Op
    right: Op


@dataclass(frozen=True)
class Filter:
    condition: Expr
    child: Op


@dataclass(frozen=True)
class Extend:
    child: Op
    name: str
    expr: Expr


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple[Term | None, ...], ...]


@dataclass(frozen=True)
class Group:
    child: Op
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, Aggregate], ...]


@dataclass(frozen=True)
class Project:
    child: Op
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    child: Op


@dataclass(frozen=True)
class Reduced:
    child: Op


@dataclass(frozen=True)
class OrderBy:
    child: Op
    keys: tuple[tuple[Expr, bool], ...]


@dataclass(frozen=True)
class Slice:
    child: Op
    offset: int = 0
    limit: int | None = None


@dataclass(frozen=True)
class Ask:
    child: Op


Op = BGP | Join | LeftJoin | Union | Minus | Filter | Extend | Values | Group | Project | Distinct | Reduced | OrderBy | Slice | Ask


@dataclass
class Query:
    """shown: the written names of variables that differ from another one by case alone; inside they have a name of their own."""

    op: Op
    prefixes: dict[str, str] = field(default_factory=dict)
    shown: dict[str, str] = field(default_factory=dict)


def in_scope(op: Op) -> list[str]:
    """The visible variables of an operator, in order of first use."""
    if isinstance(op, BGP):
        return list(dict.fromkeys(t.name for tr in op.triples for t in tr.terms if isinstance(t, Var) and not t.hidden))
    if isinstance(op, Join | LeftJoin | Union):
        return list(dict.fromkeys([*in_scope(op.left), *in_scope(op.right)]))
    if isinstance(op, Minus):
        return in_scope(op.left)
    if isinstance(op, Extend):
        return list(dict.fromkeys([*in_scope(op.child), op.name]))
    if isinstance(op, Values | Project):
        return list(op.names)
    if isinstance(op, Group):
        return [*op.keys, *(n for n, _ in op.aggregates)]
    return in_scope(op.child)


def outer_vars(op: Op) -> set[str]:
    """Variables that an expression of op looks at although nothing below binds them: inside EXISTS they are those around it."""

    def of(expressions, scope: set[str]) -> set[str]:
        out: set[str] = set()
        for e in expressions:
            out |= expr_vars(e) - scope
            for x in exists_in(e):
                out |= (outer_vars(x.pattern) | set(in_scope(x.pattern))) - scope
        return out

    if isinstance(op, BGP | Values):
        return set()
    if isinstance(op, Filter):
        return outer_vars(op.child) | of([op.condition], set(in_scope(op.child)))
    if isinstance(op, LeftJoin):
        return outer_vars(op.left) | outer_vars(op.right) | of(op.conditions, set(in_scope(op)))
    if isinstance(op, Join | Union | Minus):
        return outer_vars(op.left) | outer_vars(op.right)
    own = {Extend: lambda: [op.expr], OrderBy: lambda: [e for e, _ in op.keys], Group: lambda: [a for _, a in op.aggregates]}.get(type(op), list)()
    return outer_vars(op.child) | of(own, set(in_scope(op.child)))


def pretty(op: Op, depth: int = 0) -> str:
    """An indented listing of the operator tree."""
    pad = "  " * depth
    if isinstance(op, BGP):
        return f"{pad}BGP\n" + "".join(f"{pad}  {' '.join(_text(t) for t in tr.terms)}\n" for tr in op.triples)
    own = {k: v for k, v in vars(op).items() if k not in ("left", "right", "child")}
    line = f"{pad}{type(op).__name__}" + (f" {own}" if own else "") + "\n"
    return line + "".join(pretty(getattr(op, k), depth + 1) for k in ("left", "right", "child") if hasattr(op, k))


def _text(t: Term) -> str:
    return "?" + t.name if isinstance(t, Var) else str(t)
