"""The registered SPARQL queries over the driver's tables, each with DuckDB SQL over the same tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import BUILDERS, Engine
from graphloom.functions import terms as T
from graphloom.layouts.property import FLAT, NESTED, load_properties
from graphloom.layouts.reductions import SINGLE, STATS, build_reductions, reduction_sizes, reduction_stats
from graphloom.sources.ntriples import load_text
from graphloom.sources.tables import EDGES, MAPPINGS, PREFIXES, tables_as_triples
from graphloom.storage import GraphStore

_FOLDERS = {"pt": FLAT, "cpt": NESTED, "st": SINGLE}
_stores: dict[tuple[str, str], GraphStore] = {}
_XVP_THRESHOLD = 0.75


def _folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a temporary one of this machine only where all tasks run here too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    if not (spark.sparkContext.master or "").startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="graphloom-graph-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own + "/graph"


def store_for(spark: SparkSession, sf_dir: str, layout: str = "tt") -> GraphStore:
    """The graph of the tables in sf_dir, loaded once an application; layouts are added when first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = GraphStore.create(tables_as_triples(spark, sf_dir), _folder(spark), PREFIXES)
    store = _stores[key]
    if layout != "tt" and not (store.folder.latest(STATS) if layout == "xvp" else store.has(_FOLDERS[layout])):
        BUILDERS[layout](store, **({"threshold": _XVP_THRESHOLD} if layout == "xvp" else {}))
    return store


def shown(c: Column, kind: str) -> Column:
    """A term for people and oracles: a literal's text, an IRI as stored, or a number."""
    if kind.startswith("num"):
        return F.round(T.numeric(c), int(kind[3:])) if kind[3:] else T.numeric(c)
    if kind == "int":
        return T.numeric(c).cast("long")
    return T.lexical(c)


PREFIX = "".join(f"PREFIX {p}: <{ns}>\n" for p, ns in PREFIXES.by_prefix.items())


@dataclass(frozen=True)
class Case:
    """sparql and SQL with the same result columns; kinds: columns that are numbers."""

    sparql: str
    sql: str
    kinds: dict[str, str] = field(default_factory=dict)
    layout: str = "tt"

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(store_for(spark, sf_dir, self.layout), self.layout).query(PREFIX + self.sparql)
        return df.select(*[(F.col(c) if c == "ask" else shown(F.col(c), self.kinds.get(c, "text"))).alias(c) for c in df.columns])


_C = "'customer:' || c_custkey"
_O = "'orders:' || o_orderkey"

#: Shapes that every layout answers.
SHAPES: dict[str, Case] = {
    "bgp_star": Case(
        "SELECT ?c ?n ?m WHERE { ?c tpch:c_name ?n ; tpch:c_mktsegment ?m ; tpch:c_nationkey nation:7 }",
        f"SELECT {_C} AS c, c_name AS n, c_mktsegment AS m FROM customer WHERE c_nationkey = 7",
    ),
    "bgp_star_const": Case(
        'SELECT ?n ?x WHERE { customer:17 tpch:c_name ?n ; tpch:c_nationkey ?x . }',
        "SELECT c_name AS n, 'nation:' || c_nationkey AS x FROM customer WHERE c_custkey = 17",
    ),
    "bgp_linear": Case(
        "SELECT ?c ?n ?r WHERE { ?c tpch:c_nationkey ?x . ?x tpch:n_name ?n . ?x tpch:n_regionkey ?y . ?y tpch:r_name ?r }",
        f"SELECT {_C} AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_snowflake": Case(
        'SELECT ?o ?t ?n ?p WHERE { ?o tpch:o_custkey ?c ; tpch:o_totalprice ?t ; tpch:o_orderstatus "F" ; tpch:hasPart ?p . '
        '?c tpch:c_nationkey ?x ; tpch:c_mktsegment "BUILDING" . ?x tpch:n_name ?n . ?p tpch:p_size "10" }',
        f"SELECT {_O} AS o, o_totalprice AS t, n_name AS n, 'part:' || p_partkey AS p "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
        "JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey "
        "WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND p_size = 10",
        {"t": "num"},
    ),
    "bgp_multivalued_var": Case(
        'SELECT ?o ?p WHERE { ?o tpch:o_orderstatus "O" ; tpch:hasPart ?p }',
        f"SELECT DISTINCT {_O} AS o, 'part:' || l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'",
    ),
    "bgp_multivalued_const": Case(
        "SELECT ?o ?t WHERE { ?o tpch:hasPart part:5 ; tpch:o_totalprice ?t }",
        f"SELECT {_O} AS o, o_totalprice AS t FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5)",
        {"t": "num"},
    ),
    "bgp_multivalued_two_const": Case(
        "SELECT ?p ?n WHERE { ?p tpch:suppliedBy supplier:1 , supplier:2 ; tpch:p_name ?n }",
        "SELECT 'part:' || p_partkey AS p, p_name AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1) "
        "AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 2)",
    ),
    "bgp_same_predicate_twice": Case(
        "SELECT ?o ?p ?q WHERE { ?o tpch:hasPart ?p , ?q ; tpch:o_custkey customer:3 }",
        f"WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) "
        f"SELECT {_O} AS o, 'part:' || a.l_partkey AS p, 'part:' || b.l_partkey AS q FROM orders JOIN e a ON a.l_orderkey = o_orderkey "
        "JOIN e b ON b.l_orderkey = o_orderkey WHERE o_custkey = 3",
    ),
    "bgp_var_predicate": Case(
        "SELECT ?x ?p ?n WHERE { ?x tpch:n_regionkey region:1 . ?x ?p ?n }",
        "SELECT 'nation:' || n_nationkey AS x, p, n FROM (SELECT n_nationkey, 'tpch:n_name' AS p, n_name AS n FROM nation WHERE n_regionkey = 1 "
        "UNION ALL SELECT n_nationkey, 'tpch:n_regionkey', 'region:' || n_regionkey FROM nation WHERE n_regionkey = 1)",
    ),
}

CASES: dict[str, Case] = {
    "bgp_single_triple": Case("SELECT ?c ?n WHERE { ?c tpch:c_name ?n }", f"SELECT {_C} AS c, c_name AS n FROM customer"),
    **SHAPES,
    "bgp_disconnected": Case(
        "SELECT ?a ?b WHERE { ?x tpch:r_name ?a . ?y tpch:r_name ?b }",
        "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    ),
    "filter_cmp": Case(
        "SELECT ?c ?b WHERE { ?c tpch:c_acctbal ?b FILTER(?b > 9000) }",
        f"SELECT {_C} AS c, c_acctbal AS b FROM customer WHERE c_acctbal > 9000",
        {"b": "num"},
    ),
    "filter_and_or_not": Case(
        'SELECT ?c ?b ?m WHERE { ?c tpch:c_acctbal ?b ; tpch:c_mktsegment ?m FILTER(!(?b < 8000) && (?m = "BUILDING" || ?m = "MACHINERY")) }',
        f"SELECT {_C} AS c, c_acctbal AS b, c_mktsegment AS m FROM customer WHERE NOT c_acctbal < 8000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')",
        {"b": "num"},
    ),
    "filter_arith": Case(
        "SELECT ?p ?z WHERE { ?p tpch:p_size ?z FILTER(?z + 5 - 1 <= 10 && ?z * 2 > 4) }",
        "SELECT 'part:' || p_partkey AS p, p_size AS z FROM part WHERE p_size + 4 <= 10 AND p_size * 2 > 4",
        {"z": "int"},
    ),
    "filter_bound": Case(
        "SELECT ?c ?o WHERE { ?c tpch:c_nationkey nation:3 OPTIONAL { ?o tpch:o_custkey ?c ; tpch:o_orderstatus \"P\" } FILTER(bound(?o)) }",
        f"SELECT {_C} AS c, {_O} AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderstatus = 'P'",
    ),
    "filter_not_bound": Case(
        "SELECT ?c WHERE { ?c tpch:c_nationkey nation:3 OPTIONAL { ?o tpch:o_custkey ?c ; tpch:o_orderstatus \"P\" } FILTER(!bound(?o)) }",
        f"SELECT {_C} AS c FROM customer WHERE c_nationkey = 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "filter_regex": Case(
        'SELECT ?c ?n WHERE { ?c tpch:c_name ?n FILTER regex(?n, "0[13]7$") }',
        f"SELECT {_C} AS c, c_name AS n FROM customer WHERE regexp_matches(c_name, '0[13]7$')",
    ),
    "filter_regex_i": Case(
        'SELECT ?c ?m WHERE { ?c tpch:c_mktsegment ?m FILTER regex(?m, "^build", "i") }',
        f"SELECT {_C} AS c, c_mktsegment AS m FROM customer WHERE regexp_matches(c_mktsegment, '^build', 'i')",
    ),
    "filter_lang": Case(
        'SELECT ?d ?s WHERE { ?d tpch:source_tagged ?s FILTER langMatches(lang(?s), "fr") }',
        "SELECT 'document:' || doc_id AS d, source AS s FROM documents WHERE lower(lang) = 'fr' OR starts_with(lower(lang), 'fr-')",
    ),
    "filter_str": Case(
        'SELECT ?x WHERE { ?x tpch:n_regionkey ?r FILTER(str(?r) = "http://example.org/region/2" && isIRI(?r) && !isLiteral(?r)) }',
        "SELECT 'nation:' || n_nationkey AS x FROM nation WHERE n_regionkey = 2",
    ),
    "filter_cast": Case(
        "SELECT ?c ?b WHERE { ?c tpch:c_acctbal ?b FILTER(xsd:integer(?b) = 100 || xsd:double(?b) >= 9900) }",
        f"SELECT {_C} AS c, c_acctbal AS b FROM customer WHERE trunc(c_acctbal) = 100 OR c_acctbal >= 9900",
        {"b": "num"},
    ),
    "filter_var_equality": Case(
        "SELECT ?c ?s WHERE { ?c tpch:c_nationkey ?x . ?s tpch:s_nationkey ?y FILTER(?x = ?y && ?x = nation:4) }",
        f"SELECT {_C} AS c, 'supplier:' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey = 4",
    ),
    "filter_in": Case(
        'SELECT ?o WHERE { ?o tpch:o_orderstatus ?s FILTER(?s NOT IN ("O", "F")) }',
        f"SELECT {_O} AS o FROM orders WHERE o_orderstatus NOT IN ('O', 'F')",
    ),
    "filter_exists": Case(
        "SELECT ?s WHERE { ?s tpch:s_nationkey nation:1 FILTER EXISTS { ?p tpch:suppliedBy ?s ; tpch:p_size \"1\" } }",
        "SELECT 'supplier:' || s_suppkey AS s FROM supplier WHERE s_nationkey = 1 AND s_suppkey IN "
        "(SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1)",
    ),
    "optional": Case(
        "SELECT ?x ?s WHERE { ?x tpch:n_name ?n OPTIONAL { ?s tpch:s_nationkey ?x } }",
        "SELECT 'nation:' || n_nationkey AS x, 'supplier:' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "optional_filter": Case(
        "SELECT ?x ?s ?b WHERE { ?x tpch:n_name ?n OPTIONAL { ?s tpch:s_nationkey ?x ; tpch:s_acctbal ?b FILTER(?b > 5000) } }",
        "SELECT 'nation:' || n_nationkey AS x, 'supplier:' || s_suppkey AS s, s_acctbal AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000",
        {"b": "num"},
    ),
    "optional_nested": Case(
        "SELECT ?r ?x ?s WHERE { ?r tpch:r_name ?a OPTIONAL { ?x tpch:n_regionkey ?r OPTIONAL { ?s tpch:s_nationkey ?x } } }",
        "SELECT 'region:' || r_regionkey AS r, 'nation:' || n_nationkey AS x, 'supplier:' || s_suppkey AS s "
        "FROM region LEFT JOIN (nation LEFT JOIN supplier ON s_nationkey = n_nationkey) ON n_regionkey = r_regionkey",
    ),
    "optional_no_shared": Case(
        "SELECT ?r ?p WHERE { ?r tpch:r_name ?a OPTIONAL { ?p tpch:p_size \"none\" } }",
        "SELECT 'region:' || r_regionkey AS r, NULL::VARCHAR AS p FROM region",
    ),
    "union": Case(
        "SELECT ?x ?n WHERE { { ?x tpch:r_name ?n } UNION { ?x tpch:n_name ?n } }",
        "SELECT 'region:' || r_regionkey AS x, r_name AS n FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name FROM nation",
    ),
    "union_disjoint_vars": Case(
        "SELECT ?a ?b WHERE { { ?x tpch:r_name ?a } UNION { ?y tpch:n_name ?b } }",
        "SELECT r_name AS a, NULL AS b FROM region UNION ALL SELECT NULL, n_name FROM nation",
    ),
    "minus": Case(
        "SELECT ?c WHERE { ?c tpch:c_nationkey nation:3 MINUS { ?o tpch:o_custkey ?c ; tpch:o_orderstatus \"P\" } }",
        f"SELECT {_C} AS c FROM customer WHERE c_nationkey = 3 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "values": Case(
        "SELECT ?x ?n WHERE { VALUES ?x { nation:1 nation:2 nation:99 } ?x tpch:n_name ?n }",
        "SELECT 'nation:' || n_nationkey AS x, n_name AS n FROM nation WHERE n_nationkey IN (1, 2)",
    ),
    "bind": Case(
        "SELECT ?p ?d WHERE { ?p tpch:p_size ?z BIND(?z * 2 + 1 AS ?d) FILTER(?d < 9) }",
        "SELECT 'part:' || p_partkey AS p, p_size * 2 + 1.0::DOUBLE AS d FROM part WHERE p_size * 2 + 1 < 9",
        {"d": "num"},
    ),
    "distinct": Case("SELECT DISTINCT ?m WHERE { ?c tpch:c_mktsegment ?m }", "SELECT DISTINCT c_mktsegment AS m FROM customer"),
    "reduced": Case("SELECT REDUCED ?m WHERE { ?c tpch:c_mktsegment ?m }", "SELECT c_mktsegment AS m FROM customer"),
    "order_limit": Case(
        "SELECT ?c ?b WHERE { ?c tpch:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 25",
        f"SELECT {_C} AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, 'http://example.org/customer/' || c_custkey LIMIT 25",
        {"b": "num"},
    ),
    "order_desc_offset": Case(
        "SELECT ?n WHERE { ?x tpch:n_name ?n } ORDER BY DESC(?n) LIMIT 10 OFFSET 5",
        "SELECT n_name AS n FROM nation ORDER BY n_name DESC LIMIT 10 OFFSET 5",
    ),
    "join_groups": Case(
        "SELECT ?c ?o WHERE { { ?c tpch:c_nationkey nation:2 } { ?o tpch:o_custkey ?c } { ?o tpch:o_orderstatus \"F\" } }",
        f"SELECT {_C} AS c, {_O} AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 2 AND o_orderstatus = 'F'",
    ),
    "subquery_limit": Case(
        "SELECT ?x ?n WHERE { { SELECT ?x WHERE { ?x tpch:n_name ?m } ORDER BY ?m LIMIT 5 } ?x tpch:n_name ?n }",
        "SELECT 'nation:' || n_nationkey AS x, n_name AS n FROM nation ORDER BY n_name LIMIT 5",
    ),
    "count_result": Case(
        "SELECT (COUNT(*) AS ?n) WHERE { ?o tpch:o_custkey ?c . ?c tpch:c_nationkey ?x }",
        "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey",
        {"n": "int"},
    ),
    "group_aggregates": Case(
        "SELECT ?m (COUNT(DISTINCT ?x) AS ?k) (SUM(?b) AS ?t) (AVG(?b) AS ?a) (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) "
        "WHERE { ?c tpch:c_mktsegment ?m ; tpch:c_nationkey ?x ; tpch:c_acctbal ?b } GROUP BY ?m HAVING(COUNT(*) > 10)",
        "SELECT c_mktsegment AS m, count(DISTINCT c_nationkey) AS k, round(sum(c_acctbal), 4) AS t, round(avg(c_acctbal), 6) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi "
        "FROM customer GROUP BY c_mktsegment HAVING count(*) > 10",
        {"k": "int", "t": "num4", "a": "num6", "lo": "num", "hi": "num"},
    ),
    "distinct_order_limit": Case(
        "SELECT DISTINCT ?m ?x WHERE { ?c tpch:c_mktsegment ?m ; tpch:c_nationkey ?x } ORDER BY DESC(?m) ?x LIMIT 12",
        "SELECT DISTINCT c_mktsegment AS m, 'nation:' || c_nationkey AS x FROM customer ORDER BY m DESC, x LIMIT 12",
    ),
    "distinct_order_hidden_key": Case(
        "SELECT DISTINCT ?m WHERE { ?c tpch:c_mktsegment ?m ; tpch:c_acctbal ?b } ORDER BY ?b LIMIT 3",
        "SELECT c_mktsegment AS m FROM customer GROUP BY c_mktsegment ORDER BY min(c_acctbal) LIMIT 3",
    ),
    "exists_correlated": Case(
        "SELECT ?c ?b WHERE { ?c tpch:c_acctbal ?b ; tpch:c_nationkey ?x FILTER EXISTS { ?s tpch:s_nationkey ?x ; tpch:s_acctbal ?a FILTER(?a > ?b && ?a < ?b + 50) } }",
        f"SELECT {_C} AS c, c_acctbal AS b FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal AND s_acctbal < c_acctbal + 50)",
        {"b": "num"},
    ),
    "not_exists_correlated": Case(
        "SELECT ?s ?a WHERE { ?s tpch:s_acctbal ?a ; tpch:s_nationkey ?x FILTER NOT EXISTS { ?t tpch:s_nationkey ?x ; tpch:s_acctbal ?b FILTER(?b > ?a) } }",
        "SELECT 'supplier:' || s_suppkey AS s, s_acctbal AS a FROM supplier o WHERE NOT EXISTS "
        "(SELECT 1 FROM supplier i WHERE i.s_nationkey = o.s_nationkey AND i.s_acctbal > o.s_acctbal)",
        {"a": "num"},
    ),
    "exists_equal_outer": Case(
        "SELECT ?x ?n WHERE { ?x tpch:n_name ?n ; tpch:n_regionkey ?r FILTER EXISTS { ?c tpch:c_mktsegment \"BUILDING\" ; tpch:c_nationkey ?y FILTER(?y = ?x) } }",
        "SELECT 'nation:' || n_nationkey AS x, n_name AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    ),
    "exists_or": Case(
        "SELECT ?c WHERE { ?c tpch:c_acctbal ?b FILTER(?b > 9500 || NOT EXISTS { ?o tpch:o_custkey ?c }) }",
        f"SELECT {_C} AS c FROM customer WHERE c_acctbal > 9500 OR c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "optional_exists": Case(
        "SELECT ?x ?s WHERE { ?x tpch:n_name ?n OPTIONAL { ?s tpch:s_nationkey ?x FILTER EXISTS { ?p tpch:suppliedBy ?s ; tpch:p_size \"1\" } } }",
        "SELECT 'nation:' || n_nationkey AS x, 'supplier:' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey "
        "AND s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1)",
    ),
    "optional_shared_unbound": Case(
        "SELECT ?n ?s ?b WHERE { ?x tpch:n_name ?n OPTIONAL { ?s tpch:s_nationkey ?x ; tpch:s_acctbal ?a FILTER(?a > 9000) } "
        "OPTIONAL { ?s tpch:s_acctbal ?b FILTER(?b > 9800) } }",
        "WITH l AS (SELECT n_name, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000) "
        "SELECT n_name AS n, 'supplier:' || coalesce(l.s_suppkey, r.s_suppkey) AS s, r.s_acctbal AS b FROM l LEFT JOIN supplier r "
        "ON (r.s_suppkey = l.s_suppkey OR l.s_suppkey IS NULL) AND r.s_acctbal > 9800",
        {"b": "num"},
    ),
    "var_equality_by_value": Case(
        "SELECT ?p ?q WHERE { ?p tpch:p_size ?a . ?q tpch:p_size ?b . ?p tpch:p_brand \"Brand#11\" . ?q tpch:p_brand \"Brand#12\" FILTER(?a = ?b) }",
        "SELECT 'part:' || a.p_partkey AS p, 'part:' || b.p_partkey AS q FROM part a JOIN part b ON a.p_size = b.p_size WHERE a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#12'",
    ),
    "max_optional": Case(
        "SELECT ?r (MAX(?b) AS ?hi) (MIN(?b) AS ?lo) WHERE { ?x tpch:n_regionkey ?r OPTIONAL { ?s tpch:s_nationkey ?x ; tpch:s_acctbal ?b FILTER(?b > 9000) } } GROUP BY ?r",
        "SELECT 'region:' || n_regionkey AS r, max(s_acctbal) AS hi, min(s_acctbal) AS lo FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_regionkey",
        {"hi": "num", "lo": "num"},
    ),
    "min_optional_text": Case(
        "SELECT ?r (MIN(?m) AS ?lo) (MAX(?m) AS ?hi) WHERE { ?x tpch:n_regionkey ?r OPTIONAL { ?s tpch:s_nationkey ?x ; tpch:s_name ?m FILTER regex(?m, \"[37]$\") } } GROUP BY ?r",
        "SELECT 'region:' || n_regionkey AS r, min(s_name) AS lo, max(s_name) AS hi FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND regexp_matches(s_name, '[37]$') GROUP BY n_regionkey",
    ),
    "avg_empty": Case(
        "SELECT (AVG(?b) AS ?a) (SUM(?b) AS ?s) (COUNT(?b) AS ?n) WHERE { ?c tpch:c_acctbal ?b FILTER(?b > 1000000) }",
        "SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS s, count(*) AS n FROM customer WHERE c_acctbal > 1000000",
        {"a": "num", "s": "num", "n": "int"},
    ),
    "sum_of_texts": Case(
        "SELECT ?m (SUM(?n) AS ?s) (COUNT(?n) AS ?k) WHERE { ?c tpch:c_mktsegment ?m ; tpch:c_name ?n } GROUP BY ?m",
        "SELECT c_mktsegment AS m, NULL::DOUBLE AS s, count(*) AS k FROM customer GROUP BY c_mktsegment",
        {"s": "num", "k": "int"},
    ),
    "vars_by_case": Case(
        "SELECT ?n ?N1 WHERE { ?x tpch:n_regionkey ?X ; tpch:n_name ?n . ?X tpch:r_name ?N . BIND(?N AS ?N1) }",
        "SELECT n_name AS n, r_name AS N1 FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "number_lexical": Case(
        'SELECT ?n ?t WHERE { ?x tpch:r_name ?n VALUES ?t { "5" "5d" "5f" "NaN" "Infinity" " 5" "0x5" "5.0e0" "+5." } FILTER(?t = 5) }',
        "SELECT r_name AS n, t FROM region CROSS JOIN (VALUES ('5'), ('5.0e0'), ('+5.')) v(t)",
    ),
    "ask": Case("ASK { ?c tpch:c_nationkey nation:3 ; tpch:c_mktsegment \"BUILDING\" }", "SELECT count(*) > 0 AS ask FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'"),
}
CASES |= {
    f"layout_{layout}_{name}": Case(c.sparql, c.sql, c.kinds, layout) for layout in ("pt", "cpt", "st", "xvp") for name, c in SHAPES.items()
}


def triples_sql() -> str:
    """The triples of the tables in SQL, for oracles of what the loader computes."""
    parts = []
    for m in MAPPINGS:
        s = f"'{m.subject}:' || {m.key}"
        parts += [f"SELECT {s} AS s, 'tpch:{c}' AS p, '\"' || {c} || '\"' AS o FROM {m.table} WHERE {c} IS NOT NULL" for c in m.literals]
        parts += [f"SELECT {s}, 'tpch:{c}', '{t}:' || {c} FROM {m.table} WHERE {c} IS NOT NULL" for c, t in m.links]
        parts += [f"SELECT {s}, 'tpch:{c}_tagged', '\"' || {c} || '\"@' || {tag} FROM {m.table} WHERE {c} IS NOT NULL AND {tag} IS NOT NULL" for c, tag in m.tagged]
    parts += [
        f"SELECT DISTINCT '{e.subject[0]}:' || {e.subject[1]}, 'tpch:{e.predicate}', '{e.object[0]}:' || {e.object[1]} FROM {e.table}" for e in EDGES
    ]
    return "WITH t AS (" + " UNION ALL ".join(parts) + ")"


#: How a test file of N-Triples writes a nation's name, and what is to be read: codes of characters, both quotes, a backslash.
_WRITTEN = "replace(replace(n_name, 'A', '\\\\u0041'), 'I', '\\\\U00000049')"


def _text_file(spark: SparkSession, sf_dir: str, line: Column) -> str:
    """A text file of a line for each nation, in the scratch of this application."""
    at = _folder(spark) + "-text"
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("value")).write.text(at)
    return at


def _ntriples(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """The nations' names, read from N-Triples with escapes, a comment, empty lines and a line twice."""
    iri = [F.lit(f"<{PREFIXES.by_prefix['nation']}"), F.col("n_nationkey").cast("string"), F.lit("> ")]
    name = F.replace(F.replace(F.col("n_name"), F.lit("A"), F.lit("\\u0041")), F.lit("I"), F.lit("\\U00000049"))
    triple = F.concat(*iri, F.lit(f'<{PREFIXES.by_prefix["tpch"]}n_name> "'), name, F.lit("\\u0022\\'\\\\\"@EN ."))
    lines = F.concat_ws("\n", triple, F.lit("# a comment"), F.lit(""), triple)
    return load_text(spark, _text_file(spark, sf_dir, lines), PREFIXES, **options)


def load_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """load_text() with escapes, prefixes and duplicates: terms as they are stored."""
    return _ntriples(spark, sf_dir)


def load_ntriples_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with duplicates left in."""
    return _ntriples(spark, sf_dir, unique=False)


def load_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text in the order o|s|p with a dot after the object of every second line."""
    dot = F.when(F.col("n_nationkey") % 2 == 0, F.lit(" .")).otherwise(F.lit(""))
    iri = F.concat(F.lit(f"<{PREFIXES.by_prefix['nation']}"), F.col("n_nationkey").cast("string"), F.lit(">"))
    link = F.concat(F.lit(f"<{PREFIXES.by_prefix['region']}"), F.col("n_regionkey").cast("string"), F.lit(">"), dot)
    line = F.concat(link, F.lit("|"), iri, F.lit("|"), F.lit(f"<{PREFIXES.by_prefix['tpch']}n_regionkey>"))
    return load_text(spark, _text_file(spark, sf_dir, line), PREFIXES, delimited=True, field="|", columns=("o", "s", "p"), dot=True)


def load_reduction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded statistics of all reductions that aren't empty."""
    stats = reduction_stats(store_for(spark, sf_dir, "xvp"))
    return stats.select("p1", "p2", "type", "n_tuples", "n_rows", F.col("build").isNotNull().alias("materialised"))


def resume_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all reductions that a build in two calls has written, the second of which finds a part done."""
    store = GraphStore.create(tables_as_triples(spark, sf_dir).where("p in ('tpch:c_name', 'tpch:c_nationkey', 'tpch:n_name', 'tpch:o_custkey')"), _folder(spark), PREFIXES)
    build_reductions(store, kinds=("so", "os"), span=(0, 2), keep_all=True)
    build_reductions(store, kinds=("so", "os"), keep_all=True)
    read = [store.read(f"reductions/{r['build']}/r={r['id']}").select(F.lit(r["p1"]).alias("p1"), F.lit(r["p2"]).alias("p2"), F.lit(r["type"]).alias("type"), "s", "o") for r in reduction_stats(store).where("build is not null").collect()]
    out = read[0]
    for r in read[1:]:
        out = out.unionByName(r)
    return out.groupBy("p1", "p2", "type").agg(F.count("*").alias("n_tuples"))


def prefixes_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result with full IRIs."""
    return Engine(store_for(spark, sf_dir)).expanded(PREFIX + "SELECT ?x ?r { ?x tpch:n_regionkey ?r }")


def _sizes(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: reduction_sizes(store_for(spark, sf_dir), (kind,)).select("p1", "p2", "n_tuples")


def _sizes_sql(kind: str) -> str:
    apart = "WHERE a.p <> b.p" if kind in ("ss", "oo") else ""
    return (
        f"{triples_sql()} SELECT a.p AS p1, b.p AS p2, count(*) AS n_tuples FROM t a "
        f"JOIN (SELECT DISTINCT p, {kind[1]} AS k FROM t) b ON a.{kind[0]} = b.k {apart} GROUP BY a.p, b.p"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: c.run for name, c in CASES.items()}
    out["load_triples"] = lambda spark, sf_dir: store_for(spark, sf_dir).triples().groupBy("p").agg(F.count("*").alias("n_rows"), F.count_distinct("s").alias("n_subjects"))
    out["load_vp_sizes"] = lambda spark, sf_dir: store_for(spark, sf_dir).triples().groupBy("p").agg(F.count("*").alias("n_rows"))
    out["load_properties"] = lambda spark, sf_dir: load_properties(store_for(spark, sf_dir))
    out |= {f"load_reduction_{kind}_sizes": _sizes(kind) for kind in ("ss", "so", "os", "oo")}
    own = (load_ntriples, load_ntriples_all, load_delimited, load_reduction_stats, resume_reductions, prefixes_expanded)
    out |= {f.__name__: f for f in own}
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: c.sql for name, c in CASES.items()}
    t = triples_sql()
    out["load_triples"] = f"{t} SELECT p, count(*) AS n_rows, count(DISTINCT s) AS n_subjects FROM t GROUP BY p"
    out["load_vp_sizes"] = f"{t} SELECT p, count(*) AS n_rows FROM t GROUP BY p"
    out["load_properties"] = f"{t} SELECT p, max((n > 1)::INTEGER) AS is_complex FROM (SELECT p, s, count(*) AS n FROM t GROUP BY p, s) GROUP BY p"
    out |= {f"load_reduction_{kind}_sizes": _sizes_sql(kind) for kind in ("ss", "so", "os", "oo")}
    name = """'"' || n_name || chr(92) || '"' || chr(39) || chr(92) || chr(92) || '"@en' AS o"""
    out["load_ntriples"] = f"SELECT 'nation:' || n_nationkey AS s, 'tpch:n_name' AS p, {name} FROM nation"
    out["load_ntriples_all"] = f"SELECT 'nation:' || n_nationkey AS s, 'tpch:n_name' AS p, {name} FROM nation, range(2)"
    out["load_delimited"] = "SELECT 'nation:' || n_nationkey AS s, 'tpch:n_regionkey' AS p, 'region:' || n_regionkey AS o FROM nation"
    sizes = " UNION ALL ".join(f"SELECT p1, p2, '{k}' AS type, n_tuples FROM ({_sizes_sql(k)})" for k in ("ss", "so", "os", "oo"))
    rows = f"SELECT p, count(*) AS n_rows FROM ({t} SELECT * FROM t) GROUP BY p"
    out["load_reduction_stats"] = (
        f"SELECT p1, p2, type, n_tuples, n_rows, n_tuples / n_rows < {_XVP_THRESHOLD} AS materialised FROM ({sizes}) JOIN ({rows}) ON p = p1"
    )
    few = "p1 IN ('tpch:c_name', 'tpch:c_nationkey', 'tpch:n_name', 'tpch:o_custkey') AND p2 IN ('tpch:c_name', 'tpch:c_nationkey', 'tpch:n_name', 'tpch:o_custkey')"
    out["resume_reductions"] = f"SELECT p1, p2, type, n_tuples FROM ({out['load_reduction_stats']}) WHERE type IN ('so', 'os') AND {few}"
    out["prefixes_expanded"] = "SELECT '<http://example.org/nation/' || n_nationkey || '>' AS x, '<http://example.org/region/' || n_regionkey || '>' AS r FROM nation"
    return out
