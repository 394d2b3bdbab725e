"""Semi-join reductions: a single table with flags, and a table for every selective pair of predicates."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from graphloom.functions.terms import Term, Var
from graphloom.layouts.base import Layout
from graphloom.operators.solution import Solution
from graphloom.plans.algebra import Triple
from graphloom.storage import SO, GraphStore

SINGLE, REDUCED, STATS, LOG, PROFILE = "single_table", "reductions", "reduction_stats", "reduction_log", "term_profile"
MASKS = "term_masks"
#: ss: the subject is a subject of the other predicate; so: the subject is an object of it; and so on.
TYPES = ("ss", "so", "os", "oo")
MOST_BROADCAST_IDS = 100_000
#: A row for every reduction that isn't empty. What was looked at is in COVERED, and a pair in there without a row is empty.
STATS_SCHEMA = "id long, p1 string, p2 string, type string, n_tuples long, n_rows long, sf double, build string"
_BITS = 63
COVERED = "reduction_covered"
COVERED_SCHEMA = "kinds array<string>, first array<string>, second array<string>"


def term_profile(store: GraphStore) -> DataFrame:
    """(k, as_s, as_o): for each term the predicates that have it as subject and as object.

    One aggregation for all kinds of neighbours. It collects sets, map-side first, so a term's row is no
    longer than the list of predicates however many triples it has.
    """
    ends = F.array(*[F.struct(F.col(c).alias("k"), F.lit(c == "s").alias("own")) for c in ("s", "o")])
    places = store.triples().select("p", F.explode(ends).alias("x")).select("p", "x.k", "x.own")
    sets = [F.collect_set(F.when(F.col("own") if own else ~F.col("own"), F.col("p"))).alias(c) for own, c in ((True, "as_s"), (False, "as_o"))]
    return places.groupBy("k").agg(*sets)


def profiled(store: GraphStore, kinds: Iterable[str] = TYPES, keep: bool = False) -> DataFrame:
    """triples with an array of predicates for each kind: a join with the terms' profile for each end that the kinds ask for.

    The profile is written first, so that both joins read it instead of counting again. keep leaves it there.
    """
    kinds = tuple(kinds)
    if not (keep and store.has(PROFILE)):
        store.write(term_profile(store), PROFILE, "overwrite")
    profile = store.read(PROFILE, ST.StructType([ST.StructField("k", ST.StringType()), *[ST.StructField(c, ST.ArrayType(ST.StringType())) for c in ("as_s", "as_o")]]))
    out = store.triples()
    for mine in ("s", "o"):
        own = [k for k in kinds if k[0] == mine]
        if own:
            sets = profile.select(F.col("k").alias("__k"), *[F.col(f"as_{k[1]}").alias(k) for k in own])
            out = out.join(sets, F.col(mine) == F.col("__k"), "left").drop("__k")
    return out


def term_masks(store: GraphStore) -> DataFrame:
    """(k, s_0, s_1, ..., o_0, o_1, ...): for each term a bit for every predicate that has it as subject, and as object.

    Bits are combined by a plain hash aggregation. 63 predicates share a column, for a layout that has three
    columns a predicate anyway.
    """
    spark, terms = store.spark, list(store.predicates)
    bits = spark.createDataFrame([(t, i // _BITS, 1 << i % _BITS) for i, t in enumerate(terms)], "p string, word int, bit long")
    ends = F.array(*[F.struct(F.col(c).alias("k"), F.lit(c).alias("end")) for c in ("s", "o")])
    places = store.triples().join(F.broadcast(bits), "p").select("word", "bit", F.explode(ends).alias("x")).select("word", "bit", "x.*")
    words = range(-(-len(terms) // _BITS))
    of = lambda c, w: F.bit_or(F.when((F.col("end") == c) & (F.col("word") == w), F.col("bit")).otherwise(0)).alias(f"{c}_{w}")
    return places.groupBy("k").agg(*[of(c, w) for c in ("s", "o") for w in words])


def build_single(store: GraphStore, mode: str = "errorifexists", keep: bool = False) -> None:
    """s, o and a flag ss_, so_, os_ for every predicate, partitioned by p."""
    store.write(term_masks(store), MASKS, "overwrite")
    masks, rows = store.read(MASKS), store.triples()
    for mine in ("s", "o"):
        own = masks.select(F.col("k").alias("__k"), *[F.col(c).alias(f"{mine}{c}") for c in masks.columns if c != "k"])
        rows = rows.join(own, F.col(mine) == F.col("__k")).drop("__k")
    flags = []
    for kind in ("ss", "so", "os"):
        for i, q in enumerate(store.predicates.values()):
            set_ = F.col(f"{kind}_{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0
            flags.append(set_.alias(f"{kind}_{q.column}"))
    spread = F.pmod(F.xxhash64("s"), F.lit(16))
    store.write(rows.repartition("p", spread).select("s", "o", "p", *flags), SINGLE, mode, "p")
    if not keep:
        store.drop(MASKS)


def single_schema(store: GraphStore) -> ST.StructType:
    flags = [f"{k}_{q.column}" for k in ("ss", "so", "os") for q in store.predicates.values()]
    fields = [ST.StructField("s", ST.StringType()), ST.StructField("o", ST.StringType())]
    return ST.StructType([*fields, *[ST.StructField(f, ST.BooleanType()) for f in flags], ST.StructField("p", ST.StringType())])


def reduction_sizes(store: GraphStore, kinds: Iterable[str] = TYPES) -> DataFrame:
    """(p1, p2, type, n_tuples) of all reductions that aren't empty, without building one.

    Keys are counted by (predicate, position, term) first; pairs of predicates meet at their terms,
    and a row of the join is a pair of predicates at a term, not a pair of triples.
    """
    rows = store.triples()
    places = {x: rows.groupBy("p", F.col(x).alias("k")).agg(F.count("*").alias("n")) for x in ("s", "o")}
    out = None
    for kind in kinds:
        mine = places[kind[0]].withColumnRenamed("p", "p1")
        theirs = places[kind[1]].select("k", F.col("p").alias("p2"))
        sizes = mine.join(theirs, "k").groupBy("p1", "p2").agg(F.sum("n").alias("n_tuples"))
        if kind in ("ss", "oo"):
            sizes = sizes.where("p1 <> p2")
        sizes = sizes.withColumn("type", F.lit(kind))
        out = sizes if out is None else out.unionByName(sizes)
    return out


def reduction_stats(store: GraphStore) -> DataFrame:
    """The recorded reductions that aren't empty; build names the folder of a written one and is null where none was written."""
    at = store.folder.latest(STATS)
    return store.spark.createDataFrame([], STATS_SCHEMA) if at is None else store.read(at).select(*[f.split()[0] for f in STATS_SCHEMA.split(", ")])


def covered(store: GraphStore) -> list[tuple[set[str], set[str], set[str]]]:
    """(kinds, first predicates, second predicates) that builds have looked at: one row a build."""
    at = store.folder.latest(STATS)
    if at is None:
        return []
    rows = store.read(f"{COVERED}/{at.rpartition('/')[2]}").collect()
    return [(set(r["kinds"]), set(r["first"]), set(r["second"])) for r in rows]


def build_reductions(
    store: GraphStore,
    threshold: float = 1.0,
    kinds: Iterable[str] = TYPES,
    predicates: Iterable[str] | None = None,
    span: tuple[int, int] | None = None,
    keep_all: bool = False,
    keep: bool = False,
) -> None:
    """Write every reduction with 0 < SF < threshold, and the statistics of all that were looked at.

    kinds, predicates (a list instead of all) and span (positions [a, b) of p1 in the sorted list)
    restrict what is built; what an earlier call recorded is kept and not built again. keep_all
    writes every reduction that isn't empty. All are written by one job, partitioned by their id,
    into a folder of this call's own. Only the statistics, which are written last, name that folder:
    a call that dies leaves nothing that is read, and the next one starts from the same records.
    """
    spark = store.spark
    kinds = tuple(kinds)
    if unknown := set(kinds) - set(TYPES):
        raise ValueError(f"unknown kinds {sorted(unknown)}; known are {TYPES}")
    began = time.time()
    wanted = sorted(set(predicates) & set(store.predicates)) if predicates is not None else sorted(store.predicates)
    first = wanted[slice(*span)] if span else wanted
    known, looked = reduction_stats(store), covered(store)
    for build in store.folder.names(REDUCED):
        if known.where(F.col("build") == build).isEmpty():
            store.drop(f"{REDUCED}/{build}")
    build = uuid.uuid4().hex

    def among(c: str, terms: Iterable[str]) -> Column:
        return F.array_contains(F.lit(sorted(terms)), F.col(c))

    fresh = reduction_sizes(store, kinds).where(among("p1", first) & among("p2", wanted))
    for done_kinds, done_first, done_second in looked:
        fresh = fresh.where(~(among("type", done_kinds) & among("p1", done_first) & among("p2", done_second)))
    rows = spark.createDataFrame([(p.term, p.rows) for p in store.predicates.values()], "p1 string, n_rows long")
    next_id = 1 + (known.agg(F.max("id")).first()[0] if not known.isEmpty() else -1)
    sized = fresh.join(rows, "p1").withColumn("sf", F.col("n_tuples") / F.col("n_rows"))
    sized = sized.withColumn("build", F.when(F.lit(True) if keep_all else F.col("sf") < threshold, build))
    numbered = sized.withColumn("id", F.monotonically_increasing_id() + F.lit(next_id))
    at = f"reduction_new-{build}"
    store.write(numbered.select(*[f.split()[0] for f in STATS_SCHEMA.split(", ")]), at)
    new = store.read(at)
    written = new.where("build is not null")
    n = written.count()
    if n:
        used = sorted(r[0] for r in written.select("type").distinct().collect())
        ids = written.select(F.col("id").alias("r"), F.col("p1").alias("p"), F.col("p2").alias("q"), F.col("type").alias("kind"))
        profiles = profiled(store, used, keep)
        parts = F.concat(*[_labelled(k) for k in used])
        exploded = profiles.select("s", "o", "p", F.explode(parts).alias("x")).select("s", "o", "p", "x.kind", "x.q")
        # a row per pair of predicates; only a schema of very many predicates makes it too long to broadcast
        ids = F.broadcast(ids) if n <= MOST_BROADCAST_IDS else ids
        chosen = exploded.join(ids, ["p", "q", "kind"]).select("s", "o", "r")
        spread = F.pmod(F.xxhash64("s"), F.lit(4))
        store.write(chosen.repartition("r", spread), f"{REDUCED}/{build}", "overwrite", "r")
        if not keep:
            store.drop(PROFILE)
    # what was looked at is in place before the statistics of the same number make it valid
    number = 1 + max((int(v) for v in store.folder.names(STATS) if v.isdigit()), default=0)
    spans = [*looked, (set(kinds), set(first), set(wanted))]
    rows = spark.createDataFrame([tuple(sorted(x) for x in r) for r in spans], COVERED_SCHEMA).coalesce(1)
    store.write(rows, f"{COVERED}/{number:08d}", "overwrite")
    store.folder.publish(known.unionByName(new).coalesce(1), STATS)
    for v in store.folder.names(COVERED):
        if int(v) < number:
            store.drop(f"{COVERED}/{v}")
    store.drop(at)
    log = [("build_reductions", f"threshold={threshold} kinds={','.join(kinds)}", time.time() - began, n)]
    spark.createDataFrame(log, "operation string, description string, seconds double, written long").coalesce(1).write.mode("append").parquet(f"{store.path}/{LOG}")


def _labelled(kind: str) -> Column:
    """A row's predicates of a kind, each with the kind."""
    return F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda q: F.struct(F.lit(kind).alias("kind"), q.alias("q")))


def _neighbours(t: Triple, others: Iterable[Triple]) -> list[tuple[str, Triple]]:
    """(kind, other pattern) for every variable that t shares with a pattern of constant predicate."""
    out = []
    for u in others:
        if isinstance(u.p, Var):
            continue
        for a, x in (("s", t.s), ("o", t.o)):
            for b, y in (("s", u.s), ("o", u.o)):
                if isinstance(x, Var) and x == y:
                    out.append((a + b, u))
    return out


class SingleTable(Layout):
    """One scan a pattern with the flags of its neighbours as filters that reach Parquet."""

    name = "st"

    def bgp(self, triples: tuple[Triple, ...]) -> Solution:
        ordered = self.ordered(triples)
        return self.joined([self.flagged(t, [u for u in ordered if u is not t]) for t in ordered])

    def flagged(self, t: Triple, others: list[Triple]) -> Solution:
        if isinstance(t.p, Var):
            return self.scan(t)
        term = self.encode(t.p)
        if term not in self.store.predicates:
            return self.nothing(sorted(t.vars()))
        rows = self.store.read(SINGLE, single_schema(self.store)).where(F.col("p") == term)
        flags: dict[str, Column] = {}
        for kind, u in _neighbours(t, others):
            q = self.store.predicates.get(self.encode(u.p))
            if q is None:
                return self.nothing(sorted(t.vars()))
            if kind != "oo" and not (kind == "ss" and q.term == term):
                flags[f"{kind}_{q.column}"] = F.col(f"{kind}_{q.column}")
        for c in flags.values():
            rows = rows.where(c)
        return self.pattern(rows, [(t.s, "s"), (t.o, "o")])


class Reductions(Layout):
    """For each pattern the smallest written reduction that its neighbours allow, else its partition."""

    name = "xvp"

    def __init__(self, store: GraphStore, reorder: bool = True, threshold: float = 1.0) -> None:
        super().__init__(store, reorder)
        self.threshold = threshold
        self.stats = {(r["p1"], r["p2"], r["type"]): r for r in reduction_stats(store).collect()}
        self.covered = covered(store)
        self._factor: dict[Triple, float] = {}

    def choose(self, t: Triple, others: Iterable[Triple]) -> tuple[object | None, bool]:
        """(best reduction or None, the pattern is known to be empty)."""
        best = None
        p1 = self.encode(t.p)
        for kind, u in _neighbours(t, others):
            p2 = self.encode(u.p)
            r = self.stats.get((p1, p2, kind))
            if r is None:
                if any(kind in k and p1 in a and p2 in b for k, a, b in self.covered) and not (p1 == p2 and kind in ("ss", "oo")):
                    return None, True
                continue  # never looked at: nothing is known
            if r["build"] is not None and r["sf"] <= self.threshold and r["sf"] < 1 and (best is None or r["sf"] < best["sf"]):
                best = r
        return best, False

    def estimate(self, t: Triple) -> float:
        return super().estimate(t) * self._factor.get(t, 1.0)

    def bgp(self, triples: tuple[Triple, ...]) -> Solution:
        chosen: dict[Triple, object | None] = {}
        for t in triples:
            if isinstance(t.p, Var):
                continue
            chosen[t], empty = self.choose(t, [u for u in triples if u is not t])
            if empty:
                return self.nothing(sorted(set().union(*(x.vars() for x in triples))))
        self._factor = {t: r["sf"] for t, r in chosen.items() if r is not None}
        return self.joined([self.reduced(t, chosen.get(t)) for t in self.ordered(triples)])

    def reduced(self, t: Triple, r) -> Solution:
        if r is None:
            return self.scan(t)
        rows = self.store.spark.read.schema(SO).parquet(f"{self.store.path}/{REDUCED}/{r['build']}/r={r['id']}")
        ends: list[tuple[Term, str]] = [(t.s, "s"), (t.o, "o")]
        return self.pattern(rows, ends)
