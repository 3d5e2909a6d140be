"""What keeps the queries on large tables from one long task, and from sending tables to the driver."""

import pytest

from kinloom import queries as own
from kinloom.shared import sorted_joins


@pytest.fixture
def one_row_group(spark, tmp_path):
    """900 customers in one file of one row group, with little beside their keys."""
    customers = spark.range(900).selectExpr("id AS c_custkey", "CAST(id AS DOUBLE) AS c_acctbal")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["issue_log", "phone_normalize", "skills_normalize"])
def test_normalisers_share_one_row_group(spark, one_row_group, query):
    rows = own.queries()[query](spark, one_row_group)
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len([n for n in sizes if n]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_stagers_share_one_row_group(spark, one_row_group):
    for rows in own._source_rows(spark, one_row_group).values():
        sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert sum(sizes) == 300 and len([n for n in sizes if n]) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_merge_broadcasts_no_table(spark, one_row_group):
    told = spark._jsparkSession.sharedState().statusStore()
    before = told.executionsCount()
    own._merged.cache_clear()
    own.constraint_violations(spark, one_row_group).collect()
    own.components(spark, one_row_group).collect()
    own.bridge_guards(spark, one_row_group).collect()
    runs = told.executionsList(before, 10_000)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert len([p for p in plans if "SortMergeJoin" in p]) > 10
    # Only offsets of ranges, a row for each, which numbered() asks to broadcast.
    assert not [p for p in plans if "BroadcastHashJoin" in p and "_range" not in p]


def test_sorted_joins_puts_back_what_was_set(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(name)
    with pytest.raises(KeyError), sorted_joins(spark):
        assert spark.conf.get(name) == "-1" and spark.range(9).join(spark.range(9), "id")._jdf.queryExecution().toString().count("SortMergeJoin")
        raise KeyError
    assert spark.conf.get(name) == old


def test_queries_leave_no_views(spark, one_row_group):
    assert own.queries()["phone_normalize"](spark, one_row_group).count() == 900
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kinloom_")]
