"""Every registered query runs; those with SQL agree with DuckDB."""

import pytest
from oracle import connect, differences, duck_rows, spark_rows

from dataloom.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, folder, name):
    assert differences(spark_rows(QUERIES[name](spark, folder)), duck_rows(connect(folder), SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = QUERIES[name](spark, folder)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    of_conversations = name in ("op7_tool_calls", "op11_turn_repair")
    assert rows.count() > 0 if of_conversations else rows.count() == docs
