import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 40 and all(map(callable, q.values()))
    df = entry.entry(spark)
    assert df.columns[0] == "artifact_id" and 0 < df.count() <= 50


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["knn_topk"](spark, entry.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    plan = entry.queries()["content_addressed"](spark, entry.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text)" in plan and "lang" not in plan
