import os
import re

import pytest

import __spark_entry__ as entry


def test_registry():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 90


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the supplied tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["segment", "n", "lines", "top"] and df.count() > 0


def test_nothing_else_imports_the_training_operators():
    root = os.path.join(os.path.dirname(entry.__file__), "lodeframe")
    for at, _, names in os.walk(root):
        if "llm" in os.path.relpath(at, root).split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(at, n)) as f:
                    assert not re.search(r"\bllm\b", f.read()), n


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    from lodeframe.plans.explain import plan_text
    from lodeframe.plans.relational import run

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the supplied tables")
    plan = plan_text(run(spark, "/root/testdata/sf0.001", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 5 AND 9"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,5), LessThanOrEqual(o_orderkey,9)]" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
    joined = plan_text(run(spark, "/root/testdata/sf0.001", "SELECT COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint>" in joined and "ReadSchema: struct<o_orderkey:bigint>" in joined
