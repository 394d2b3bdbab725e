"""RDF terms as strings: their encoding and the Column functions that take them apart.

A term is one string in N-Triples form. An IRI whose namespace has a prefix is stored compacted
(``tpch:c_name``), any other in angle brackets; a literal has its quotes, escapes and language or
datatype; a blank node starts with ``_:``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    lang: str | None = None
    datatype: str | None = None


@dataclass(frozen=True)
class BNode:
    label: str


@dataclass(frozen=True)
class Var:
    name: str
    #: A blank node of a query is a variable that no result shows.
    hidden: bool = False


Term = IRI | Literal | BNode | Var


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


class Prefixes:
    """Namespaces and their prefixes; the longest namespace that fits is taken."""

    def __init__(self, prefixes: dict[str, str] | None = None) -> None:
        self.by_prefix = dict(prefixes or {})
        self.longest = sorted(self.by_prefix.items(), key=lambda x: (-len(x[1]), x[0]))

    def compact(self, iri: str) -> str:
        for prefix, namespace in self.longest:
            if namespace and iri.startswith(namespace):
                return f"{prefix}:{iri[len(namespace):]}"
        return f"<{iri}>"

    def encode(self, term: Term) -> str:
        if isinstance(term, IRI):
            return self.compact(term.value)
        if isinstance(term, BNode):
            return "_:" + term.label
        if isinstance(term, Var):
            raise TypeError("a variable has no encoding")
        quoted = f'"{escape(term.value)}"'
        if term.lang:
            return f"{quoted}@{term.lang}"
        return f"{quoted}^^{self.compact(term.datatype)}" if term.datatype else quoted

    def compact_column(self, c: Column) -> Column:
        """Compact the IRIs of a column of N-Triples terms; namespaces are compared as plain text."""
        out = None
        for prefix, namespace in self.longest:
            fits = F.startswith(c, F.lit("<" + namespace))
            inner = F.substr(c, F.lit(len(namespace) + 2), F.length(c) - F.lit(len(namespace) + 2))
            short = F.concat(F.lit(prefix + ":"), inner)
            out = F.when(fits, short) if out is None else out.when(fits, short)
        return c if out is None else out.otherwise(c)

    def expand_column(self, c: Column) -> Column:
        """The full IRI of a column of compacted or bracketed IRIs, without brackets."""
        out = F.when(F.startswith(c, F.lit("<")), F.substr(c, F.lit(2), F.length(c) - F.lit(2)))
        for prefix, namespace in self.longest:
            head = prefix + ":"
            out = out.when(F.startswith(c, F.lit(head)), F.concat(F.lit(namespace), F.substr(c, F.lit(len(head) + 1))))
        return out.otherwise(c)


    def full_column(self, c: Column) -> Column:
        """A column of terms as N-Triples writes them: full IRIs in angle brackets, also of datatypes."""
        tail = datatype(c)
        typed = F.concat(F.regexp_extract(c, r'(?s)^(".*"\^\^)[^"]+$', 1), F.lit("<"), self.expand_column(tail), F.lit(">"))
        literal = F.when(tail != "", typed).otherwise(c)
        return F.when(is_literal(c), literal).when(is_blank(c), c).otherwise(F.concat(F.lit("<"), self.expand_column(c), F.lit(">")))


def is_literal(c: Column) -> Column:
    return F.startswith(c, F.lit('"'))


def is_blank(c: Column) -> Column:
    return F.startswith(c, F.lit("_:"))


def is_iri(c: Column) -> Column:
    return ~is_literal(c) & ~is_blank(c)


_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^(.+))?$'
#: The lexical form of a number. Java and Python read more than this ("5d", "NaN", "1_000"), which no number of XSD is.
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
#: A number without a datatype or with one that isn't a text's; INF and NaN only of a floating type.
_NUMERIC = rf'^"({_NUMBER})"(?:\^\^(?!\S*[#:](?:string|boolean)>?$).+)?$'
_SPECIAL = r'^"([+-]?INF|NaN)"\^\^\S*[#:](?:double|float)>?$'


def number_of(text: str) -> float | None:
    """The value of a number's lexical form, None for any other text."""
    return float(text) if re.fullmatch(_NUMBER, text, re.A) else None


def number_of_column(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(f"^{_NUMBER}$")), text).try_cast("double")


def _unescaped(c: Column) -> Column:
    plain = c
    for written, meant in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(written), F.lit(meant))
    return F.when(F.contains(c, F.lit("\\")), plain).otherwise(c)


def lexical(c: Column) -> Column:
    """str(): a literal's text, an IRI's characters."""
    return F.when(is_literal(c), _unescaped(F.regexp_extract(c, _LITERAL, 1))).otherwise(c)


def lang(c: Column) -> Column:
    """A literal's language or the empty string; null, an error, for other terms."""
    return F.when(is_literal(c), F.regexp_extract(c, _LITERAL, 2))


def datatype(c: Column) -> Column:
    return F.when(is_literal(c), F.regexp_extract(c, _LITERAL, 3))


def numeric(c: Column) -> Column:
    """A literal's value as a double, null where it is none; never an ANSI cast error."""
    special = F.replace(F.regexp_extract(c, _SPECIAL, 1), F.lit("INF"), F.lit("Infinity"))
    value = F.nullif(F.regexp_extract(c, _NUMERIC, 1), F.lit("")).try_cast("double")
    return F.coalesce(value, F.when(F.rlike(c, F.lit(_SPECIAL)), special).try_cast("double"))


def canonical(c: Column) -> Column:
    """Equal for terms that compare as equal: a number's value, else the term itself."""
    number = numeric(c)
    return F.when(number.isNotNull(), F.concat(F.lit("#"), (number + F.lit(0.0)).cast("string"))).otherwise(c)


def quoted(text: Column) -> Column:
    """A plain literal of a text column."""
    out = text
    for meant, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(meant), F.lit(written))
    return F.concat(F.lit('"'), out, F.lit('"'))
