import importlib


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "label", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_every_core_query_runs(spark, sf):
    from quillspark.plans import catalog

    for name, f in catalog.QUERIES.items():
        df = f(spark, sf)
        assert len(set(df.columns)) == len(df.columns), name
        df.write.format("noop").mode("overwrite").save()


def test_plans_keep_their_promises(spark, sf):
    from quillspark.plans import catalog

    plan = lambda n: catalog.QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan("knn_cosine_topk")
    assert "WindowGroupLimit" in plan("knn_multi_corpus_merge")
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThanOrEqual" in plan("filter_range") or "PushedFilters" in plan("filter_range")
    assert "text" not in plan("filter_range").split("ReadSchema")[1]
