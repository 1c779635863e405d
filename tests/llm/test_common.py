from pyspark.sql import functions as F

from lodeframe.llm.common import materialize, release, salted_rank, shielded, tagged
from lodeframe.llm.components import connected_components


def test_salted_rank(spark):
    """Ranks of a key are 0..n-1, whatever the number of salts."""
    df = materialize(spark.range(500).select((F.col("id") % 7 % 3).alias("k"), "id"), "t")
    for per_salt in (1_000_000, 20):
        rows = salted_rank(df, ["k"], [F.col("id")], F.xxhash64("id"), "r", per_salt).collect()
        by = {}
        for r in rows:
            by.setdefault(r.k, []).append(r.r)
        assert {k: sorted(v) for k, v in by.items()} == {k: list(range(len(v))) for k, v in by.items()} and len(rows) == 500


def test_components(spark):
    """Paths, stars, cycles and lone loops, against a walk."""
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(200, 201), (201, 202), (202, 200), (300, 300), (39, 210), (210, 205)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + edges[:9], "a LONG, b LONG")).collect()}
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert got == {n: c for n, c in low.items() if n != c}
    assert connected_components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_release(spark):
    """Tables of a tag go, unless something still reads them."""
    with tagged("t1"):
        a, b = materialize(spark.range(3).toDF("x"), "a"), materialize(spark.range(4).toDF("x"), "b")
    release(spark, "t1", b.where("x > 1"))
    assert b.count() == 4
    try:
        n = spark.read.parquet(a.inputFiles()[0]).count()
    except Exception:
        n = None
    assert n is None
    release(spark, "t1")


def test_shielded(spark):
    df = spark.createDataFrame([(1, "t", "x", 2)], "doc_id LONG, text STRING, `odd name` STRING, __x0 INT")
    inside, restored = shielded(df, ["text"])
    assert "odd name" not in inside.columns and restored(inside).columns == df.columns and restored(inside).first() == df.first()
