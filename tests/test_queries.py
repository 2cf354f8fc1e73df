"""Every registered query of the library's own operators against its SQL twin."""

import math
import os

import duckdb
import pytest

from markfuse.plans import catalogue, rules
from markfuse.plans.views import TABLES


QUERIES, ORACLE = catalogue.QUERIES | rules.QUERIES, catalogue.ORACLE | rules.ORACLE


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) and math.isfinite(v) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"exists", "lines", "chars"} <= set(e.entry(spark).columns)


def test_profile_needs_no_shuffle(spark):
    from markfuse.operators.profile import profile

    p = profile(spark.createDataFrame([(1, "# Ab\n| x |")], "doc int, markdown string"))
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()


def test_normalize_shuffles_once(spark):
    from markfuse.operators.normalize import normalize, statistics

    lines = spark.range(100).selectExpr("id % 3 AS doc", "id AS pos", "'x' AS line")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = statistics(normalize(lines))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["cell_conflicts", "cell_majority", "row_sum_check"])
def test_cells_of_a_row_are_not_gathered_again(spark, sf, name):
    # F4 to F6: after the grouping that makes the rows nothing sorts, groups or deals the sixteen cells of each
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Aggregate(") == 2 and plan.count("Exchange") == 1 and "Sort" not in plan


def test_cells_views_agree(spark, sf):
    from markfuse.operators import cells
    from markfuse.plans import views

    keys, single = ["t", "r", "col_no"], views.of(spark, sf, views.cells)
    met = cells.meet(single, keys, catalogue.PARSERS).select(*keys, *catalogue.PARSERS)
    assert met.exceptAll(views.of(spark, sf, views.cells_met)).count() == 0
    sums = cells.row_sums(single, ["t", "r"], total_col=3, value=single["value"].try_cast("bigint"))
    assert sums.select("t", "r", "parser", "ok").exceptAll(QUERIES["row_sum_check"](spark, sf)).count() == 0


@pytest.mark.parametrize("name", ["flat_tables", "english_share"])
def test_a_small_file_keeps_all_cores_busy(spark, sf, name):
    # F7, F8: one row group is one task, and these queries are dear by row
    found = QUERIES[name](spark, sf).rdd
    assert sum(n > 0 for n in found.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["score_summary", "word_error_items", "char_error_summary", "best_label"])
def test_items_are_cut_and_compared_once(spark, sf, name):
    # one pass of the header pattern for ids and one for parts, one function for all edits of an item
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("ArrowEvalPython") == 1 and "levenshtein" not in plan
