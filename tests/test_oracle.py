"""A selection of the registered queries against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from graphloom import workload

SF = "/root/testdata/sf0.001"
NAMES = ["bgp_snowflake", "bgp_same_predicate_twice", "filter_cast", "optional_filter", "group_aggregates", "order_limit",
         "layout_pt_bgp_snowflake", "layout_cpt_bgp_multivalued_var", "layout_st_bgp_linear", "layout_xvp_bgp_snowflake",
         "load_properties", "load_reduction_os_sizes", "distinct_order_limit", "distinct_order_hidden_key", "exists_correlated",
         "not_exists_correlated", "exists_equal_outer", "exists_or", "optional_exists", "optional_shared_unbound", "var_equality_by_value",
         "max_optional", "min_optional_text", "avg_empty", "sum_of_texts", "vars_by_case", "number_lexical", "load_ntriples",
         "load_ntriples_all", "load_delimited", "load_reduction_stats", "resume_reductions", "prefixes_expanded"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def rows(cursor, names):
    out = []
    for r in cursor:
        out.append(tuple(f"{v:.6f}" if isinstance(v, float) else v for v in (r[n] for n in names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    df = workload.queries()[name](spark, SF)
    names = sorted(df.columns)
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(workload.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert rows((r.asDict() for r in df.collect()), names) == rows((dict(zip(cols, r, strict=True)) for r in cur.fetchall()), names)


def test_every_query_has_an_oracle():
    assert set(workload.queries()) == set(workload.oracle_sql())
