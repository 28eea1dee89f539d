import re

import __spark_entry__ as entry
from bucketwise.llm import registry


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and set(registry.QUERIES) <= set(names)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE) <= set(names)
