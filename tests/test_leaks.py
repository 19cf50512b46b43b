from sparkloom.plans import registry

from .compare import connect, difference


def test_leaks_of_whole_lines(spark, tmp_path):
    head = "x" * 60
    items = [(1, f"{head} first end\n  the second line \nshort"), (2, f"{head} other end"), (3, f"{head} other end")]
    texts = [("a the second line b",), (head,), (f"{head} other end",), ("short",), (None,)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["leak_audit_lines"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, "the second line", 1), (2, f"{head} other end", 1), (3, f"{head} other end", 1)]
    assert not difference(df, connect(str(tmp_path)), registry.oracle_sql()["leak_audit_lines"])
