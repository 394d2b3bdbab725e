"""N-Triples and delimited text as triples(s, p, o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.terms import Prefixes
from graphloom.storage import SPO

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+?|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
_EMPTY = r"^\s*(?:#.*)?$"
_CODE = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
#: What happens to a line that is no triple: raise ends the read with the line, skip leaves it out.
MALFORMED = ("raise", "skip")


def _checked(rows: DataFrame, good: Column, blank: Column, line: Column, parts: list[Column], malformed: str) -> DataFrame:
    """The parts of good lines. A blank line is told apart in the same expression that raises: a filter before it may be evaluated later."""
    if malformed not in MALFORMED:
        raise ValueError(f"malformed is {malformed!r}; known are {MALFORMED}")
    if malformed == "skip":
        return rows.where(good).select(*parts)
    stop = F.raise_error(F.concat(F.lit("malformed line: "), line)).cast("string")
    found = rows.select(*[F.when(good, p).when(~blank, stop).alias(c) for p, c in zip(parts, SPO.names, strict=True)])
    return found.where("s is not null")


def decoded(c: Column, literal: bool) -> Column:
    """A term whose escapes are written as the engine writes them, so that equal terms are equal strings.

    \\uXXXX and \\UXXXXXXXX become the character, \\b, \\f and \\' too; in a literal a quote, a backslash,
    \\n, \\r and \\t stay escapes, and are so where they were written as codes or as a raw tab.
    """
    slash = "\x00"  # no text that Spark reads as a line of N-Triples has it

    def char(code: Column) -> Column:
        out = F.decode(F.unhex(F.lpad(F.substr(code, F.lit(3)), 8, "0")), "UTF-32")
        if literal:
            for meant, written in (("\\", slash), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
                out = F.replace(out, F.lit(meant), F.lit(written))
        return out

    held = F.replace(c, F.lit("\\\\"), F.lit(slash)) if literal else c
    codes = F.array_distinct(F.regexp_extract_all(held, F.lit(_CODE), F.lit(0)))
    held = F.reduce(codes, held, lambda text, code: F.replace(text, code, char(code)))
    if literal:
        for written, meant in (("\\b", "\b"), ("\\f", "\f"), ("\\'", "'"), (slash, "\\\\")):
            held = F.replace(held, F.lit(written), F.lit(meant))
    out = F.when(F.contains(c, F.lit("\\")), held).otherwise(c)
    return F.replace(out, F.lit("\t"), F.lit("\\t")) if literal else out


def normalised(c: Column) -> Column:
    """A term of N-Triples text in the engine's one spelling: escapes decoded, the language in lower case."""
    body, tail = F.regexp_extract(c, r'(?s)^(".*")([^"]*)$', 1), F.regexp_extract(c, r'(?s)^(".*")([^"]*)$', 2)
    tail = F.when(F.startswith(tail, F.lit("@")), F.lower(tail)).otherwise(decoded(tail, False))
    return F.when(F.startswith(c, F.lit('"')), F.concat(decoded(body, True), tail)).otherwise(decoded(c, False))


def read_ntriples(spark: SparkSession, path: str, malformed: str = "raise") -> DataFrame:
    """Real N-Triples: a line is a triple, a comment or empty; any other is malformed."""
    line = F.col("value")
    parts = [normalised(F.regexp_extract(line, _LINE, i)).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))]
    return _checked(spark.read.text(path), F.rlike(line, F.lit(_LINE)), F.rlike(line, F.lit(_EMPTY)), line, parts, malformed)


def read_delimited(
    spark: SparkSession, path: str, field: str = "\t", line: str = "\n", columns: tuple[str, str, str] = ("s", "p", "o"), malformed: str = "raise"
) -> DataFrame:
    """Three text fields a line, as they are: no quoting, no escapes. Extra fields are ignored, a line with fewer is malformed.

    columns name the fields in file order as they should be read, e.g. ("o", "p", "s").
    """
    parts = F.split(F.col("value"), f"\\Q{field}\\E", -1)
    raw, text = spark.read.option("lineSep", line).text(path), F.col("value")
    found = {c: F.get(parts, i).alias(c) for i, c in enumerate(columns)}
    return _checked(raw, F.size(parts) >= 3, text == "", text, [found[c] for c in SPO.names], malformed)


def read_table(spark: SparkSession, path: str, columns: tuple[str, str, str] = ("s", "p", "o")) -> DataFrame:
    """Triples of a Parquet table; columns name its subject, predicate and object."""
    return spark.read.parquet(path).select(*[F.col(f"`{c}`").cast("string").alias(x) for c, x in zip(columns, SPO.names, strict=True)])


def strip_dot(triples: DataFrame) -> DataFrame:
    """Drop a dot that ends the object, and the space around it."""
    return triples.withColumn("o", F.regexp_replace("o", r"\s*\.\s*$", ""))


def compact(triples: DataFrame, prefixes: Prefixes) -> DataFrame:
    return triples.select(*[prefixes.compact_column(F.col(c)).alias(c) for c in ("s", "p", "o")])


def read_prefixes(spark: SparkSession, path: str) -> Prefixes:
    """A file of ``prefix: <namespace>`` lines; lines with fewer than two fields are skipped."""
    fields = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(fields.alias("f")).where(F.size("f") >= 2).collect()
    out = {}
    for (f,) in rows:
        f = f[1:] if f[0] == "@prefix" else f
        if len(f) >= 2:
            out[f[0].removesuffix(":")] = f[1].strip("<>")
    return Prefixes(out)


def load_text(
    spark: SparkSession,
    path: str,
    prefixes: Prefixes | None = None,
    delimited: bool = False,
    field: str = "\t",
    line: str = "\n",
    columns: tuple[str, str, str] = ("s", "p", "o"),
    dot: bool = False,
    unique: bool = True,
    malformed: str = "raise",
) -> DataFrame:
    """Read, clean, compact and make distinct, in that order. A graph is a set: unique is the default."""
    out = read_delimited(spark, path, field, line, columns, malformed) if delimited else read_ntriples(spark, path, malformed)
    return cleaned(out, prefixes, dot, unique)


def cleaned(triples: DataFrame, prefixes: Prefixes | None = None, dot: bool = False, unique: bool = True) -> DataFrame:
    """Strip dots, compact and make distinct, in that order; what lacks a term is left out."""
    out = strip_dot(triples) if dot else triples
    out = compact(out, prefixes) if prefixes is not None else out
    out = out.where("s is not null and p is not null and o is not null")
    return (out.distinct() if unique else out).select(*[F.col(c).cast(SPO[c].dataType) for c in SPO.names])
