import re

import __spark_entry__ as entry


def test_names_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert all(re.fullmatch("[a-z0-9_]+", name) for name in queries)
