"""Every registered relational query against DuckDB on the smallest tables, and seeded differential cases."""

import os
import random

import duckdb
import pytest

from lodeframe import Engine
from lodeframe.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda v: "NULL" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return [names[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


#: What random queries read: a FROM clause, its integer columns, and a column with few values. Labels are missing for many documents.
SOURCES = [
    ("documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", ["d.n_chars", "l.quality", "l.toxic"], "d.lang"),
    ("orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey", ["o.o_orderkey", "c.c_custkey", "c.c_nationkey"], "o.o_orderstatus"),
    ("nation n LEFT JOIN region r ON n.n_regionkey + 2 = r.r_regionkey", ["n.n_nationkey", "r.r_regionkey"], "r.r_name"),
]


class Writer:
    """Random queries that mean the same in the dialect and in DuckDB."""

    def __init__(self, seed):
        self.rng = random.Random(seed)
        self.source, self.numbers, self.key = self.rng.choice(SOURCES)

    def number(self, depth=2):
        pick = self.rng.random()
        if depth == 0 or pick < 0.4:
            return self.rng.choice(self.numbers)
        if pick < 0.6:
            return f"({self.number(depth - 1)} {self.rng.choice('+-')} {self.rng.randint(0, 9)})"
        if pick < 0.8:
            return f"CASE WHEN {self.truth(depth - 1)} THEN {self.number(depth - 1)} ELSE {self.number(depth - 1)} END"
        return f"COALESCE({self.number(depth - 1)}, {self.rng.randint(-3, 3)})"

    def truth(self, depth=2):
        pick = self.rng.random()
        if depth and pick < 0.35:
            return f"({self.truth(depth - 1)} {self.rng.choice(['AND', 'OR'])} {self.truth(depth - 1)})"
        if depth and pick < 0.45:
            return f"NOT {self.truth(depth - 1)}"
        if pick < 0.55:
            return f"{self.rng.choice([*self.numbers, self.key])} IS {self.rng.choice(['', 'NOT '])}NULL"
        if pick < 0.65:
            return f"{self.rng.choice(self.numbers)} {self.rng.choice(['', 'NOT '])}IN ({self.rng.randint(0, 3)}, {self.rng.randint(1, 30)}, NULL)"
        if pick < 0.75:
            inner = self.rng.choice(["SELECT quality FROM labels", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 1)"])
            return f"{self.rng.choice(self.numbers)} {self.rng.choice(['', 'NOT '])}IN ({inner})"
        low = self.rng.randint(0, 20)
        return self.rng.choice([f"{self.number(1)} {self.rng.choice(['<', '>=', '<>'])} {low}", f"{self.number(1)} BETWEEN {low} AND {low + self.rng.randint(-2, 900)}"])

    def query(self):
        tail = f"FROM {self.source} WHERE {self.truth()}"
        shape = self.rng.randrange(4)
        if shape == 0:
            return f"SELECT DISTINCT {self.number()} AS p, {self.key} AS q {tail}"
        if shape == 1:
            return f"SELECT {self.key} AS k, COUNT(*) AS n, MIN({self.number(1)}) AS lo, COUNT({self.number(1)}) AS m {tail} GROUP BY {self.key} HAVING COUNT(*) > {self.rng.randint(0, 4)}"
        if shape == 2:
            return f"SELECT {self.number(1)} AS p {tail} UNION {self.rng.choice(['', 'ALL '])}SELECT {self.number(1)} {tail}"
        return f"SELECT COUNT(DISTINCT {self.number(1)}) AS n, MAX({self.number()}) AS hi {tail}"


def test_random_queries(spark, duck):
    """Seeded queries over nulls, CASE, arithmetic, nested IN, DISTINCT, HAVING and unions."""
    engine = Engine(spark)
    for name in "region nation customer orders documents labels".split():
        engine.register(name, spark.read.parquet(f"{DATA}/{name}.parquet"))
    for seed in range(40):
        sql = Writer(seed).query()
        got, want = engine.sql(sql), duck.sql(sql)
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), sql
