from sparkloom.plans import registry


def test_span_queries_are_named_after_what_they_do():
    names = set(registry.queries())
    assert {"short_span_totals", "merged_line_ranges"} <= names & set(registry.oracle_sql())
    assert not {"node_cover_pool", "span_pack_files"} & names
