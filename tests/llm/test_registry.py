import __spark_entry__ as e


def test_every_operator_has_its_query():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in e.queries()) == 1
    assert "pipeline" in e.queries() and "pipeline" not in e.oracle_sql()
