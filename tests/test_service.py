"""What stands around queries: plans that ran, timeouts, admission, the command line, exclusive files, shared folders."""

import json
import threading
from types import SimpleNamespace

import pytest

from lodeframe import Engine
from lodeframe.__main__ import Repl
from lodeframe.config import Config
from lodeframe.errors import AdmissionError, EngineError, StatementTimeout
from lodeframe.plans.warehouse import scratch
from lodeframe.sources import files


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.register("t", spark.range(1000).selectExpr("id", "id % 7 AS k", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'x''y' END AS s"))
    # slow in every row, so that a timeout finds it running
    e.register("slow", spark.range(0, 8, 1, 8).selectExpr("id", "java_method('java.lang.Thread', 'getAllStackTraces') IS NULL AS z").selectExpr("id", "reduce(sequence(1, 40000000), 0L, (a, b) -> (a * 31 + b) % 1000003) + id AS v"))
    return e


def test_analyze_shows_the_plan_that_ran(engine):
    text = [r[0] for r in engine.sql("EXPLAIN ANALYZE SELECT k, COUNT(*) AS n FROM t WHERE id < 500 GROUP BY k").collect()]
    assert text[0].startswith("actual rows: 7,")
    assert any("HashAggregate rows=7 " in x for x in text) and any("Range rows=1000" in x for x in text) and any("Filter rows=500" in x for x in text)


def test_trace_channels_and_levels(engine):
    tell = lambda options: json.loads(engine.sql(f"EXPLAIN TRACE {options} SELECT COUNT(*) AS n FROM t").first()[0])
    full, short = tell("LEVEL DEBUG"), tell("LEVEL SUMMARY")
    assert full["pipeline"]["actual_rows"] == 1 and any(n.get("metrics") for n in full["operators"]) and "plan" in full
    assert not any("metrics" in n for n in short["operators"]) and "plan" not in short


def test_timeouts_hold_for_every_path(engine):
    s = engine.session()
    s.sql("SET STATEMENT_TIMEOUT = 300")
    with pytest.raises(StatementTimeout):
        s.collect("SELECT SUM(v) AS v FROM slow")
    with pytest.raises(StatementTimeout):
        list(s.text_rows("SELECT SUM(v) AS v FROM slow"))
    s.sql("DECLARE c CURSOR FOR SELECT SUM(v) AS v FROM slow")
    with pytest.raises(StatementTimeout):
        s.sql("FETCH 1 FROM c")
    assert s.collect("SELECT COUNT(*) AS n FROM t WHERE id < 3")[0][0] == 3


def test_admission(spark):
    e = Engine(spark, config=Config.parse("max_concurrent_statements = 1\nadmission_timeout_ms = 200ms"))
    e.register("t", spark.range(5))
    inside, leave = threading.Event(), threading.Event()

    def hold():
        with e.admitted():
            inside.set()
            leave.wait(30)

    other = threading.Thread(target=hold)
    other.start()
    inside.wait(30)
    with pytest.raises(AdmissionError):
        e.session().collect("SELECT COUNT(*) AS n FROM t")
    leave.set()
    other.join()
    assert e.session().collect("SELECT COUNT(*) AS n FROM t")[0][0] == 5
    with e.admitted(), e.admitted():
        pass  # nested uses take one place


def test_repl(engine):
    out = []
    r = Repl(engine.session(), out.append)
    assert r.feed("help\n") and "semicolon" in out.pop()
    r.feed("SELECT 'a;\n")
    assert not out and r.held
    r.feed("b' AS x -- done;\n")
    assert not out  # the comment's semicolon ends nothing
    r.feed(";\n")
    assert out == ["x", "a;\nb"] and not r.held
    out.clear()
    r.feed("SELECT nothing FROM nowhere;\n")
    r.feed("SELECT @;\n")
    assert len(out) == 2 and all(x.startswith("ERROR") for x in out)
    out.clear()
    r.feed("\\aligned\n")
    r.feed("SELECT id, s FROM t WHERE id IN (5, 100) ORDER BY id;\n")
    assert [x.rstrip() for x in out] == [" id | s", "----+----", "  5 | x'y", "100 | x'y"]
    assert not r.feed("exit\n")


def test_creation_is_exclusive(spark, tmp_path):
    f, won = files.Files(spark), []
    for k in range(20):
        gate = threading.Barrier(6)

        def race(n, k=k, gate=gate):
            gate.wait()
            if f.create(f"{tmp_path}/{k:03d}.json", f"writer {n}"):
                won.append((k, n))

        threads = [threading.Thread(target=race, args=(n,)) for n in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert [k for k, _ in sorted(won)] == list(range(20))
    assert all(f.read(f"{tmp_path}/{k:03d}.json") == f"writer {n}" for k, n in won)
    assert not [n for n in f.names(str(tmp_path)) if not n.endswith(".json")]


def test_local_folders_are_refused_on_clusters(spark):
    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda *a: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)

    assert scratch(spark)
    assert files.shared_folder(session("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert all(files.shared_folder(session(m)) for m in ("local", "local[4]", "local[*]", "local[4,2]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(EngineError):
            files.shared_folder(session(master))


def test_tables_are_read_again_when_they_change(spark, tmp_path):
    from lodeframe.plans.relational import table

    spark.range(3).write.parquet(f"{tmp_path}/nation.parquet")
    assert table(spark, str(tmp_path), "nation").count() == 3
    spark.range(9).write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
    assert table(spark, str(tmp_path), "nation").count() == 9
