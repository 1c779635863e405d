"""Golden results of the dialect: three-valued logic, NULL order, casts, errors, constraints, transactions."""

import json

import pytest

from lodeframe import Engine
from lodeframe.errors import AnalysisError, ConstraintError, EngineError, ParseError, SerializationError, StatementTimeout
from lodeframe.streaming.cursor import lines


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "w"))


def got(engine, sql, args=()):
    return [tuple(r) for r in engine.sql(sql, args).collect()]


def test_three_valued_logic(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 30, None), (4, None, None), (5, 10, "a")], "id INT, v INT, s STRING"))
    e.register("r", spark.createDataFrame([(10, "ten"), (30, "thirty")], "k INT, label STRING"))
    ids = lambda where: [r[0] for r in got(e, f"SELECT id FROM t WHERE {where} ORDER BY id")]
    assert ids("v = NULL") == ids("v <> NULL") == ids("v NOT IN (10, NULL)") == []
    assert ids("v = 10 OR s IS NULL") == [1, 3, 4, 5]
    assert ids("v IN (10, NULL)") == [1, 5]
    assert got(e, "SELECT COUNT(*), COUNT(v), SUM(v), AVG(v) FROM t") == [(5, 3, 50, 50 / 3)]
    assert got(e, "SELECT DISTINCT v FROM t ORDER BY v") == [(10,), (30,), (None,)]
    assert [r[0] for r in got(e, "SELECT id FROM t ORDER BY v, id")] == [1, 5, 3, 2, 4]
    assert got(e, "SELECT t.id, r.label FROM t LEFT JOIN r ON t.v = r.k ORDER BY t.id") == [(1, "ten"), (2, None), (3, "thirty"), (4, None), (5, "ten")]


def test_null_order(spark):
    e = Engine(spark)
    e.register("n", spark.createDataFrame([(1, 30, "alice"), (2, None, "bob"), (3, 10, None), (4, None, "dave"), (5, 20, "eve"), (6, 10, "frank")], "id INT, val INT, name STRING"))
    for order, want in {"val, id": [3, 6, 5, 1, 2, 4], "val DESC, id": [2, 4, 1, 5, 3, 6], "val ASC NULLS FIRST, id": [2, 4, 3, 6, 5, 1], "val DESC NULLS LAST, id": [1, 5, 3, 6, 2, 4], "val ASC NULLS FIRST, name DESC": [4, 2, 3, 6, 5, 1], "val ASC, name ASC NULLS FIRST, id": [3, 6, 5, 1, 2, 4]}.items():
        assert [r[0] for r in got(e, f"SELECT id FROM n ORDER BY {order}")] == want


@pytest.mark.parametrize("sql, want", [
    ("CAST('123' AS INT)", 123), ("CAST(3.7 AS INT)", 3), ("CAST(TRUE AS INT)", 1), ("CAST(1 AS BOOL)", True), ("CAST(99 AS TEXT)", "99"),
    ("CAST(3.14 AS TEXT)", "3.140000"), ("CAST('2.718' AS DOUBLE)", 2.718), ("CAST('abc' AS INT)", None), ("CAST(5000000000 AS INT)", None),
    ("CAST(' 7' AS INT)", 7), ("CAST('7 ' AS INT)", None), ("CAST('2024-1-2' AS TIMESTAMP)", None), ("CAST(TRUE AS TEXT)", "1"),
    ("10/3", 3), ("-7/2", -3), ("7%0", None), ("1/0", None), ("2147483647+1", None), ("-(-2147483648)", None), ("NULLIF(1, NULL)", None), ("NULLIF(1, 2)", 1),
    ("COALESCE(NULL, NULL, 4)", 4), ("LENGTH('é')", 2), ("1.0/0", float("inf")), ("CASE WHEN NULL THEN 1 ELSE 2 END", 2), ("'a\\b' LIKE 'a\\b'", True), ("'it''s'", "it's"),
    ("1 = 'a'", False), ("TRUE = 1", True), ("1e2", 100.0), ("7.5 % 2", None), ("-9223372036854775808", -(2**63)),
])
def test_scalar(spark, sql, want):
    assert got(Engine(spark), f"SELECT {sql} AS v") == [(want,)]


def test_names_of_outputs(spark):
    e = Engine(spark)
    e.register("o", spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 2, 4)], "id INT, order_id INT, qty INT"))
    df = e.sql("SELECT order_id + 1, COUNT(*) FROM o GROUP BY order_id ORDER BY expr_0")
    assert df.columns == ["expr_0", "agg_0"] and [tuple(r) for r in df.collect()] == [(2, 2), (3, 1)]
    assert e.sql("SELECT id, qty q, id*2 FROM o").columns == ["id", "q", "expr_2"]


@pytest.mark.parametrize("sql", [
    "SELECT id FROM o WHERE id", "SELECT id FROM o WHERE id AND TRUE", "SELECT NOT id FROM o", "SELECT CASE WHEN id THEN 1 END FROM o", "SELECT COUNT(*) FROM o HAVING 1", "SELECT o.id FROM o JOIN i ON 1",
    "SELECT id, COUNT(*) FROM o", "SELECT x.id FROM o", "SELECT id FROM o JOIN i ON o.id = i.order_id", "SELECT COUNT(SUM(id)) FROM o", "SELECT id FROM o WHERE COUNT(*) > 1", "SELECT 'a' + 1", "SELECT LENGTH(5)", "SELECT ID FROM o", "SELECT a FROM nowhere", "SELECT id FROM o UNION SELECT id, qty FROM i",
])
def test_analysis_errors(spark, sql):
    e = Engine(spark)
    e.register("o", spark.createDataFrame([(1, 10)], "id INT, customer_id INT"))
    e.register("i", spark.createDataFrame([(1, 1, 2)], "id INT, order_id INT, qty INT"))
    with pytest.raises(AnalysisError):
        e.sql(sql)


@pytest.mark.parametrize("sql", ["SELECT", "SELEC 1", "SELECT 1 FROM a RIGHT JOIN b ON 1=1", "SELECT 1 FROM a, b", "SELECT 1 FROM a JOIN b", "SELECT 1 FROM a CROSS JOIN b ON TRUE", "SELECT 1 LIMIT 1 UNION SELECT 2", "SELECT x IS 5", "SELECT FOO(1)", "SELECT CAST(1 AS DECIMAL)", "SELECT 1 2 3"])
def test_parse_errors(spark, sql):
    with pytest.raises(ParseError):
        Engine(spark).sql(sql)


def test_ddl_and_dml(engine):
    s = engine.session()
    s.script("CREATE TABLE alt (id INT PRIMARY KEY, name TEXT, v INT); INSERT INTO alt VALUES (1, 'a', 1), (2, 'b', NULL), (1, 'again', 3)")
    assert got(engine, "SELECT * FROM alt ORDER BY id") == [(1, "a", 1), (2, "b", None)]
    s.script("ALTER TABLE alt ADD age INT DEFAULT 25 NOT NULL; ALTER TABLE alt RENAME name TO label; ALTER TABLE alt DROP v")
    assert got(engine, "SELECT * FROM alt ORDER BY id") == [(1, "a", 25), (2, "b", 25)]
    with pytest.raises(AnalysisError):
        s.sql("ALTER TABLE alt DROP id")
    assert got(engine, "UPDATE alt SET age = age + id WHERE label = 'b'") == [(1,)]
    assert got(engine, "DELETE FROM alt WHERE age = 25") == [(1,)]
    assert got(engine, "SELECT id, age FROM alt") == [(2, 27)]
    assert got(engine, "DESC alt")[0] == (0, "id", "INT", True, True, True)
    assert ("alt",) in got(engine, "SHOW TABLES")
    assert got(engine, "VACUUM")[0][0] > 0
    assert got(engine, "SELECT id, age FROM alt") == [(2, 27)]
    s.sql("DROP TABLE alt")
    with pytest.raises(AnalysisError):
        s.sql("SELECT * FROM alt")


def test_constraints(engine):
    s = engine.session()
    s.sql("CREATE TABLE c (id INT NOT NULL, age INT CHECK (age >= 0), name VARCHAR(3), at TIMESTAMP)")
    for bad in ("(NULL, 1, 'a', NULL)", "(1, -1, 'a', NULL)", "(1, 1, 'éé', NULL)", "(1, 1, 'a', 'soon')"):
        with pytest.raises(ConstraintError):
            s.sql(f"INSERT INTO c VALUES {bad}")
    s.sql("INSERT INTO c VALUES (1, NULL, 'abc', '2024-05-06 07:08:09.5')")
    assert list(lines(s.sql("SELECT * FROM c"))) == ["id|age|name|at", "1|NULL|abc|2024-05-06 07:08:09.5"]
    with pytest.raises(ConstraintError):
        s.sql("UPDATE c SET age = -5")
    with pytest.raises(AnalysisError):
        s.sql("INSERT INTO c (id) VALUES (1, 2)")
    s.script("CREATE TABLE n (x INT CHECK (x - 3)); INSERT INTO n VALUES (1), (NULL)")
    with pytest.raises(ConstraintError):
        s.sql("INSERT INTO n VALUES (3)")
    with pytest.raises(ConstraintError):
        s.sql("UPDATE n SET x = 3")
    s.script("CREATE TABLE d (x INT); INSERT INTO d VALUES (1), (1)")
    with pytest.raises(ConstraintError):
        s.sql("CREATE UNIQUE INDEX dx ON d (x)")


def test_transactions(engine):
    a, b = engine.session(), engine.session()
    a.script("CREATE TABLE stock (id INT PRIMARY KEY, crates INT); CREATE TABLE log (x INT); INSERT INTO stock VALUES (1, 1), (2, 1)")
    a.sql("BEGIN")
    a.sql("UPDATE stock SET crates = 0 WHERE id = 1")
    assert got(engine, "SELECT SUM(crates) FROM stock") == [(2,)]
    assert a.sql("SELECT SUM(crates) FROM stock").first()[0] == 1
    b.sql("UPDATE stock SET crates = 5 WHERE id = 2")
    with pytest.raises(SerializationError):
        a.sql("COMMIT")
    with pytest.raises(EngineError):
        a.sql("COMMIT")
    # write skew: both read stock, each writes another table
    a.script("SET ISOLATION_LEVEL = SERIALIZABLE; BEGIN; SELECT * FROM stock; INSERT INTO log VALUES (1)")
    b.sql("DELETE FROM stock WHERE id = 1")
    with pytest.raises(SerializationError):
        a.sql("COMMIT")
    a.script("BEGIN; INSERT INTO log VALUES (7)")
    with pytest.raises(AnalysisError):
        a.sql("INSERT INTO log VALUES (1, 2)")
    a.sql("COMMIT")
    assert got(engine, "SELECT x FROM log") == [(7,)]


def test_session_verbs(engine):
    s = engine.session()
    s.script("CREATE TABLE k (id INT, v INT); INSERT INTO k VALUES (1, 10), (2, 20), (3, NULL)")
    s.sql("PREPARE q AS SELECT id FROM k WHERE v > ? ORDER BY id")
    assert [r[0] for r in s.sql("EXECUTE q(15)").collect()] == [2]
    assert [r[0] for r in s.sql("EXECUTE q", [5]).collect()] == [1, 2]
    s.sql("DEALLOCATE q")
    with pytest.raises(AnalysisError):
        s.sql("EXECUTE q(1)")
    s.sql("DECLARE c CURSOR FOR SELECT id FROM k ORDER BY id")
    assert [len(s.sql(f"FETCH {n} FROM c").collect()) for n in (2, 2, 2)] == [2, 1, 0]
    s.sql("CLOSE c")
    assert [tuple(r)[:4] for r in s.sql("ANALYZE k").collect()] == [("id", 3, 3, 0), ("v", 3, 2, 1)]
    assert any("Filter" in r[0] for r in s.sql("EXPLAIN SELECT id FROM k WHERE v = 10").collect())
    assert s.sql("EXPLAIN ANALYZE SELECT id FROM k").first()[0].startswith("actual rows: 3")
    report = json.loads(s.sql("EXPLAIN TRACE LEVEL VERBOSE SELECT COUNT(*) FROM k GROUP BY v").first()[0])
    assert report["pipeline"]["actual_rows"] == 3 and report["plan"]["type"] and report["operators"]
    with pytest.raises(AnalysisError):
        s.sql("EXPLAIN TRACE DELETE FROM k")
    s.sql("SET STATEMENT_TIMEOUT = 1")
    with pytest.raises(StatementTimeout):
        s.collect("SELECT COUNT(*) FROM k a CROSS JOIN k b CROSS JOIN k c CROSS JOIN k d CROSS JOIN k e CROSS JOIN k f CROSS JOIN k g CROSS JOIN k h CROSS JOIN k i CROSS JOIN k j CROSS JOIN k l CROSS JOIN k m")


def test_config_and_text_rows(spark):
    from lodeframe.config import Config

    c = Config.parse("# limits\nwork_mem = 16 MB\nstatement_timeout_ms = 2s\nmax_result_rows = 2\nisolation_level = serializable\n")
    assert (c.work_mem, c.statement_timeout_ms, c.max_result_rows, c.isolation_level) == (16 << 20, 2000, 2, "SERIALIZABLE")
    for bad in ("nothing = 1", "work_mem = 5 parsecs", "isolation_level = none", "work_mem"):
        with pytest.raises(EngineError):
            Config.parse(bad)
    s = Engine(spark, config=c).session()
    assert s.isolation == "SERIALIZABLE"
    assert list(s.text_rows("SELECT 1.5 AS a, TRUE AS b, NULL AS c")) == ["a|b|c", "1.500000|1|NULL"]
    with pytest.raises(ValueError):
        list(s.text_rows("SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3"))


def test_many_parts(engine):
    """Parts written before and after a change of columns read as one table."""
    s = engine.session()
    s.script("CREATE TABLE p (a INT); INSERT INTO p VALUES (1); INSERT INTO p VALUES (2); ALTER TABLE p ADD b INT DEFAULT 9; INSERT INTO p VALUES (3, 3); INSERT INTO p (a) VALUES (4); INSERT INTO p VALUES (5, NULL)")
    assert got(engine, "SELECT a, b FROM p ORDER BY a") == [(1, 9), (2, 9), (3, 3), (4, 9), (5, None)]


def test_only_touched_files_are_rewritten(engine):
    """UPDATE and DELETE leave files without hits alone; VACUUM takes files that no version uses."""
    s = engine.session()
    s.script("CREATE TABLE f (id INT PRIMARY KEY, v INT); INSERT INTO f VALUES (1, 1), (2, 2); INSERT INTO f VALUES (3, 3); INSERT INTO f VALUES (4, 4)")
    s.sql("UPDATE f SET v = v * 10 WHERE id = 3")
    parts = engine.catalog.load()["tables"]["f"]["parts"]
    assert [bool(p["removed"]) for p in parts] == [False, True, False, False]
    s.sql("DELETE FROM f WHERE id IN (2, 4)")
    s.sql("UPDATE f SET id = id + 1 WHERE id = 1")
    assert got(engine, "SELECT * FROM f ORDER BY id") == [(2, 1), (3, 30)]
    assert got(engine, "UPDATE f SET id = 3 WHERE id = 2") == [(0,)]
    assert got(engine, "VACUUM")[0][0] >= 4
    assert got(engine, "SELECT * FROM f ORDER BY id") == [(2, 1), (3, 30)]
    assert got(engine, "DELETE FROM f") == [(2,)] and got(engine, "SELECT COUNT(*) FROM f") == [(0,)]


def test_vacuum_spares_open_transactions(engine):
    a = engine.session()
    a.script("CREATE TABLE v (x INT); INSERT INTO v VALUES (1); BEGIN; INSERT INTO v VALUES (2); DELETE FROM v WHERE x = 1")
    engine.sql("VACUUM")
    assert [r[0] for r in a.sql("SELECT x FROM v").collect()] == [2]
    a.sql("COMMIT")
    assert got(engine, "SELECT x FROM v") == [(2,)]
    a.script("BEGIN; INSERT INTO v VALUES (3)")
    engine.catalog.vacuum()  # as another process would
    with pytest.raises(SerializationError):
        a.sql("COMMIT")
    assert got(engine, "SELECT x FROM v") == [(2,)]


def test_parts_are_sorted_by_index(engine):
    s = engine.session()
    s.script("CREATE TABLE z (a INT, b INT); CREATE INDEX zb ON z (b, a); INSERT INTO z VALUES (1, 9), (2, 3), (3, 5), (1, 3)")
    part = engine.catalog.load()["tables"]["z"]["parts"][0]["path"]
    assert [tuple(r) for r in engine.spark.read.parquet(f"{engine.catalog.root}/{part}").collect()] == [(1, 3), (2, 3), (3, 5), (1, 9)]


def test_repl(spark, monkeypatch, capsys):
    import io

    from lodeframe.__main__ import main

    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT 1 AS a,\n'x;y' AS b; SELECT 2 AS c;\nSELECT nope;\nexit\nSELECT 3 AS d;\n"))
    assert main([]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:4] == ["a|b", "1|x;y", "c", "2"] and out[4].startswith("ERROR: column 'nope' not found") and len(out) == 5
