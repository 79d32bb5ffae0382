import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["ratio"] >= 0.99
    assert set(df.columns) >= {"method", "size", "ratio", "beta"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


def test_some_queries_run_on_smallest_tables(spark):
    q = E.queries()
    for name in ["design_l4", "leverage_l4", "uniform_sample_l4", "countsketch_l4", "loss_p2_l4"]:
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 1
