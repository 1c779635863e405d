"""Statements that change tables, as queries: each works on a copy in a scratch warehouse and returns what it left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import Engine, statistics
from ..sources.files import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/lodeframe-warehouse-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def load(engine: Engine, name: str, df: DataFrame) -> None:
    """Append a DataFrame's rows to a new table's first snapshot."""
    from ..sources.catalog import Table

    state = engine.catalog.load()
    new = engine.catalog.load()
    t = Table(name, new["tables"][name])
    t.meta["parts"].append(engine.catalog.write(t, df))
    t.meta["version"] += 1
    engine.catalog.publish(state, new)


#: name: (script run on nation in a scratch warehouse, query after it, DuckDB over the unchanged nation)
NATION = "CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name VARCHAR(40), n_regionkey INT CHECK (n_regionkey >= 0))"
EFFECTS: dict[str, tuple[str, str, str]] = {
    "insert_effect": (
        "INSERT INTO nation VALUES (100, 'ATLANTIS', 1), (101, 'MU', 1+1); INSERT INTO nation (n_nationkey) VALUES (102)", "SELECT * FROM nation",
        "SELECT * FROM nation UNION ALL VALUES (100, 'ATLANTIS', 1), (101, 'MU', 2), (102, NULL, NULL)"),
    "update_effect": (
        "UPDATE nation SET n_regionkey = n_regionkey + 1, n_name = 'X' WHERE n_nationkey % 2 = 0", "SELECT * FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'X' ELSE n_name END AS n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "delete_effect": ("DELETE FROM nation WHERE n_regionkey = 2", "SELECT * FROM nation", "SELECT * FROM nation WHERE n_regionkey <> 2 OR n_regionkey IS NULL"),
    "delete_in_subquery": (
        "DELETE FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 2)", "SELECT * FROM nation",
        "SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 2)"),
    "update_subquery": (
        "UPDATE nation SET n_regionkey = (SELECT MAX(n_nationkey) FROM nation) WHERE n_nationkey = 3", "SELECT n_nationkey, n_regionkey FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN (SELECT MAX(n_nationkey) FROM nation) ELSE n_regionkey END AS n_regionkey FROM nation"),
    "unique_skip": (
        "INSERT INTO nation VALUES (1, 'DOUBLE', 0), (200, 'FIRST', 0), (200, 'SECOND', 0)", "SELECT * FROM nation", "SELECT * FROM nation UNION ALL VALUES (200, 'FIRST', 0)"),
    "update_unique_skip": (
        "UPDATE nation SET n_nationkey = 7 WHERE n_nationkey = 3; UPDATE nation SET n_nationkey = 300 WHERE n_nationkey > 20", "SELECT n_nationkey FROM nation",
        "SELECT CASE WHEN n_nationkey = 21 THEN 300 ELSE n_nationkey END AS n_nationkey FROM nation"),
    "check_default": (
        "CREATE TABLE t (a INT DEFAULT 5, b VARCHAR DEFAULT 'x', c INT CHECK (c > a)); INSERT INTO t (c) VALUES (6), (NULL); INSERT INTO t VALUES (1, NULL, 2)", "SELECT * FROM t",
        "SELECT * FROM (VALUES (5, 'x', 6), (5, 'x', NULL), (1, NULL, 2)) AS t(a, b, c)"),
    "add_drop_rename_column": (
        "ALTER TABLE nation ADD COLUMN pop INT DEFAULT 25 NOT NULL; ALTER TABLE nation RENAME COLUMN n_name TO label; ALTER TABLE nation DROP COLUMN n_regionkey; INSERT INTO nation (n_nationkey, label, pop) VALUES (500, 'NEW', 1)",
        "SELECT * FROM nation", "SELECT n_nationkey, n_name AS label, 25 AS pop FROM nation UNION ALL VALUES (500, 'NEW', 1)"),
    "unique_index": (
        "CREATE TABLE t (a INT, b INT); CREATE UNIQUE INDEX ab ON t (a, b); INSERT INTO t VALUES (1, 1), (1, 1), (1, 2), (NULL, 1), (NULL, 1)", "SELECT * FROM t",
        "SELECT * FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, 1)) AS t(a, b)"),
    "rollback_effect": (
        "BEGIN; DELETE FROM nation; ROLLBACK; BEGIN; DELETE FROM nation WHERE n_nationkey = 0; COMMIT", "SELECT COUNT(*) AS n FROM nation", "SELECT COUNT(*) - 1 AS n FROM nation"),
    "prepared": (
        "PREPARE p AS INSERT INTO nation VALUES (?, 'P', ?); EXECUTE p(900, 3); EXECUTE p(901, 4)", "SELECT n_nationkey FROM nation WHERE n_name = 'P'",
        "SELECT * FROM (VALUES (900), (901)) AS t(n_nationkey)"),
}


def effect(name: str):
    script, query, _ = EFFECTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, scratch(spark))
        session = engine.session()
        session.sql(NATION)
        load(engine, "nation", spark.read.parquet(f"{sf_dir}/nation.parquet"))
        session.script(script)
        return session.sql(query)

    return run


def analyze_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(spark.read.parquet(f"{sf_dir}/customer.parquet"))


ANALYZE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS num_rows, LEAST(COUNT(DISTINCT {c}), 100000) AS ndv, COUNT(*) - COUNT({c}) AS null_count, {lo} AS min_value, {hi} AS max_value FROM customer"
    for c, lo, hi in [(c, f"MIN({c})::DOUBLE", f"MAX({c})::DOUBLE") if n else (c, "NULL::DOUBLE", "NULL::DOUBLE") for c, n in [("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0)]])
