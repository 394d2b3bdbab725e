"""SPARQL expressions as Columns. An error is null, and a null condition drops its row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.plans import algebra as A


@dataclass(frozen=True)
class Value:
    """kind: term (an encoded term), num (double), int (long), bool or str (text without quotes)."""

    kind: str
    col: Column
    const: T.Term | None = None


class ExpressionCompiler:
    def __init__(self, prefixes: T.Prefixes, column: Callable[[str], Column | None], exists: Callable[[A.Exists], Column] | None = None) -> None:
        """column: a variable's column; exists: the boolean column of an EXISTS that is part of an expression."""
        self.prefixes, self.column, self.exists = prefixes, column, exists

    # views of a value

    def number(self, v: Value) -> Column:
        if v.kind in ("num", "int"):
            return v.col.cast("double")
        if v.kind == "term":
            if isinstance(v.const, T.Literal):
                return F.lit(T.number_of(v.const.value) if _numeric(v.const) else None).cast("double")
            return T.numeric(v.col)
        return T.number_of_column(v.col) if v.kind == "str" else F.lit(None).cast("double")

    def text(self, v: Value) -> Column:
        if v.kind == "term":
            return F.lit(v.const.value) if isinstance(v.const, T.Literal | T.IRI) else self.string(v.col)
        return v.col.cast("string")

    def string(self, c: Column) -> Column:
        """str() of an encoded term: full characters of an IRI, text of a literal."""
        return F.when(T.is_literal(c), T.lexical(c)).otherwise(self.prefixes.expand_column(c))

    def truth(self, v: Value) -> Column:
        if v.kind == "bool":
            return v.col
        if v.kind in ("num", "int"):
            return v.col != 0
        if v.kind == "str":
            return F.length(v.col) > 0
        text = T.lexical(v.col)
        typed = T.datatype(v.col).endswith("boolean>") | T.datatype(v.col).endswith(":boolean")
        own = F.when(typed, text.isin("true", "1")).when(T.numeric(v.col).isNotNull(), T.numeric(v.col) != 0).otherwise(F.length(text) > 0)
        return F.when(T.is_literal(v.col), own)

    def term(self, v: Value) -> Column:
        """The encoded term of any value."""
        if v.kind == "term":
            return v.col
        if v.kind == "str":
            return T.quoted(v.col)
        name = {"num": "double", "int": "integer", "bool": "boolean"}[v.kind]
        tail = '"^^' + self.prefixes.compact(T.XSD + name)
        return F.concat(F.lit('"'), v.col.cast("string"), F.lit(tail))

    # expressions

    def condition(self, e: A.Expr) -> Column:
        return self.truth(self.value(e))

    def value(self, e: A.Expr) -> Value:
        if isinstance(e, A.Const):
            return Value("term", F.lit(self.prefixes.encode(e.term)), e.term)
        if isinstance(e, A.Ref):
            c = self.column(e.name)
            return Value("term", F.lit(None).cast("string") if c is None else c)
        if isinstance(e, A.Call):
            return self.call(e)
        if isinstance(e, A.Exists) and self.exists is not None:
            return Value("bool", self.exists(e))
        raise A.UnsupportedFeature(f"{type(e).__name__} inside an expression")

    def call(self, e: A.Call) -> Value:
        name = e.name
        if name == "bound":
            if not isinstance(e.args[0], A.Ref):
                raise A.UnsupportedFeature("BOUND of an expression")
            return Value("bool", self.value(e.args[0]).col.isNotNull())
        if name in ("&&", "||"):
            return Value("bool", reduce(Column.__and__ if name == "&&" else Column.__or__, map(self.condition, e.args)))
        if name == "!":
            return Value("bool", ~self.condition(e.args[0]))
        args = [self.value(a) for a in e.args]
        if name in ("=", "!=", "<", "<=", ">", ">="):
            return Value("bool", self.compare(name, *args))
        if name == "in":
            return Value("bool", reduce(Column.__or__, [self.compare("=", args[0], x) for x in args[1:]], F.lit(False)))
        if name in ("+", "-", "*", "/"):
            x, y = map(self.number, args)
            return Value("num", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[name](x, y))
        if name.startswith("cast:"):
            return self.cast(name[5:], args[0])
        return getattr(self, "f_" + name)(*args)

    def compare(self, op: str, a: Value, b: Value) -> Column:
        """Numbers by value, texts by their characters, other terms for equality alone."""
        act = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op]
        does = lambda x, y: getattr(x, act)(y)
        if {"num", "int"} & {a.kind, b.kind} or _typed_number(a.const) or _typed_number(b.const):
            return does(self.number(a), self.number(b))
        if "bool" in (a.kind, b.kind):
            return does(self.truth(a), self.truth(b))
        if "str" in (a.kind, b.kind):
            return does(self.text(a), self.text(b))
        for const, other in ((a, b), (b, a)):
            if const.const is not None and not _numeric(const.const) and op in ("=", "!="):
                return does(other.col, const.col)
        x, y = self.number(a), self.number(b)
        both = x.isNotNull() & y.isNotNull()
        if op in ("=", "!="):
            return F.when(both, does(x, y)).otherwise(does(a.col, b.col))
        literals = T.is_literal(a.col) & T.is_literal(b.col)
        return F.when(both, does(x, y)).when(literals, does(T.lexical(a.col), T.lexical(b.col)))

    def cast(self, name: str, v: Value) -> Value:
        if name == "string":
            return Value("str", self.text(v))
        if name == "boolean":
            text = F.lower(self.text(v))
            return Value("bool", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))
        number = self.number(v)
        if name in ("integer", "int", "long"):
            whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
            return Value("int", whole.try_cast("long"))
        return Value("num", number)

    def f_str(self, v: Value) -> Value:
        return Value("str", self.text(v))

    def f_lang(self, v: Value) -> Value:
        return Value("str", T.lang(self.term(v)))

    def f_langmatches(self, v: Value, tag: Value) -> Value:
        have, want = F.lower(self.text(v)), F.lower(self.text(tag))
        fits = (have == want) | F.startswith(have, F.concat(want, F.lit("-")))
        return Value("bool", F.when(want == "*", F.length(have) > 0).otherwise(fits))

    def f_regex(self, v: Value, pattern: Value, flags: Value | None = None) -> Value:
        """A Java regular expression found anywhere in a literal's text."""
        if not isinstance(pattern.const, T.Literal) or flags is not None and not isinstance(flags.const, T.Literal):
            raise A.UnsupportedFeature("REGEX with a pattern that isn't a constant")
        mode = flags.const.value if flags is not None else ""
        if set(mode) - set("imsx"):
            raise A.UnsupportedFeature(f"REGEX flags {mode!r}")
        head = f"(?{mode})" if mode else ""
        hit = F.rlike(self.text(v), F.lit(head + pattern.const.value))
        return Value("bool", F.when(T.is_literal(v.col), hit) if v.kind == "term" else hit)

    def f_datatype(self, v: Value) -> Value:
        c = self.term(v)
        plain, tagged = (self.prefixes.compact(x) for x in (T.XSD + "string", T.RDF + "langString"))
        own = T.datatype(c)
        return Value("term", F.when(T.lang(c) != "", F.lit(tagged)).when(own == "", F.lit(plain)).otherwise(own))

    def f_isiri(self, v: Value) -> Value:
        return Value("bool", T.is_iri(self.term(v)))

    def f_isliteral(self, v: Value) -> Value:
        return Value("bool", T.is_literal(self.term(v)))

    def f_isblank(self, v: Value) -> Value:
        return Value("bool", T.is_blank(self.term(v)))

    def f_isnumeric(self, v: Value) -> Value:
        return Value("bool", F.when(self.term(v).isNotNull(), self.number(v).isNotNull()))

    def f_sameterm(self, a: Value, b: Value) -> Value:
        return Value("bool", self.term(a) == self.term(b))

    def f_coalesce(self, *vs: Value) -> Value:
        return Value("term", F.coalesce(*map(self.term, vs)))

    def f_if(self, test: Value, a: Value, b: Value) -> Value:
        c = self.truth(test)
        return Value("term", F.when(c, self.term(a)).when(~c, self.term(b)))

    def f_strlen(self, v: Value) -> Value:
        return Value("int", F.length(self.text(v)).cast("long"))

    def f_ucase(self, v: Value) -> Value:
        return Value("str", F.upper(self.text(v)))

    def f_lcase(self, v: Value) -> Value:
        return Value("str", F.lower(self.text(v)))

    def f_contains(self, v: Value, part: Value) -> Value:
        return Value("bool", F.contains(self.text(v), self.text(part)))

    def f_strstarts(self, v: Value, part: Value) -> Value:
        return Value("bool", F.startswith(self.text(v), self.text(part)))

    def f_strends(self, v: Value, part: Value) -> Value:
        return Value("bool", F.endswith(self.text(v), self.text(part)))

    def f_concat(self, *vs: Value) -> Value:
        return Value("str", F.concat(*map(self.text, vs)))

    def f_substr(self, v: Value, start: Value, length: Value | None = None) -> Value:
        at = self.number(start).cast("int")
        n = F.lit(2**31 - 1) if length is None else self.number(length).cast("int")
        return Value("str", F.substr(self.text(v), at, n))

    def f_abs(self, v: Value) -> Value:
        return Value("num", F.abs(self.number(v)))

    def f_ceil(self, v: Value) -> Value:
        return Value("num", F.ceil(self.number(v)).cast("double"))

    def f_floor(self, v: Value) -> Value:
        return Value("num", F.floor(self.number(v)).cast("double"))

    def f_round(self, v: Value) -> Value:
        return Value("num", F.floor(self.number(v) + 0.5).cast("double"))

    def f_neg(self, v: Value) -> Value:
        return Value("num", -self.number(v))


def _typed_number(term: T.Term | None) -> bool:
    """A number written as such: comparing it with anything but a number is an error."""
    return isinstance(term, T.Literal) and (term.datatype or "").removeprefix(T.XSD) in ("integer", "decimal", "double", "float", "int", "long")


def _numeric(term: T.Term) -> bool:
    """The constant is read as a number: by its lexical form, whatever its datatype but string and boolean."""
    if not isinstance(term, T.Literal) or term.lang or term.datatype in (T.XSD + "string", T.XSD + "boolean"):
        return False
    return T.number_of(term.value) is not None
