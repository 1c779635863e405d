"""Helpers shared by the training-data operators: shared-folder tables, salted ranks, group streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


#: Tables in the shared folder that can be dropped before the session ends, by tag.
_TAGGED: dict[str, list[str]] = {}
_TAG: list[str] = []


@contextmanager
def tagged(tag: str) -> Iterator[None]:
    """Tables materialized inside belong to ``tag``."""
    _TAG.append(tag)
    try:
        yield
    finally:
        _TAG.pop()


def release(spark: SparkSession, tag: str, *needed: DataFrame) -> None:
    """Delete the tables of ``tag``, but for those that ``needed`` still reads."""
    if not _TAGGED.get(tag):
        return
    read = [f for df in needed for f in df.inputFiles()]
    kept = []
    for path in _TAGGED[tag]:
        if any(path.rpartition("/")[2] in f for f in read):
            kept.append(path)
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _TAGGED[tag] = kept


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that later jobs neither recompute nor depend on one executor's disk. The table
    goes when its tag is released, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _TAG:
        _TAGGED.setdefault(_TAG[-1], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to every core where a scan would leave most of them idle: tables of fewer row groups than cores."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    # an adaptive plan has its own partitions, which are known only once it runs
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def shielded(docs: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all but the ``needed`` columns under names that clash with nothing, and what gives back the old columns."""
    needed = [c for c in needed if c in docs.columns]
    extra = {c: f"__x{k}" for k, c in enumerate(docs.columns) if c not in needed}
    inside = docs.select(*needed, *[F.col(f"`{c}`").alias(x) for c, x in extra.items()])
    return inside, lambda out, *more: out.select(*[F.col(extra[c]).alias(c) if c in extra else F.col(c) for c in docs.columns], *more)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, out: str, per_salt: int = 1_000_000) -> DataFrame:
    """0-based rank of each row within ``keys`` (never null) without ever sorting one key in one task.

    Rows are dealt by (keys, salt); the rank inside a salt comes from a window and the start of
    each salt from a running sum over the counts of a key's salts. There are 16 salts, or as many as leave ``per_salt``
    rows to each if one key had them all. ``df`` must give the same rows when read twice (a table, not a random expression).
    """
    salts = max(16, -(-df.count() // per_salt))
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = salted.withColumn("_within", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_salt") == F.col("_s")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = within.join(starts, cond, "left")
    return joined.withColumn(out, F.col("_start") + F.col("_within")).drop("_salt", "_within", "_start", "_s", *[f"_k_{k}" for k in keys])


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never split a run of equal ``key``; the input is sorted by it and runs are bounded."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1])
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def split_hot(rows: DataFrame, key: str, salt: Column, most: int, known: int = 100_000) -> DataFrame:
    """Deal each key's rows into a grid of tiles of about ``most`` rows, so that no task gets an unbounded key.

    Adds ``_p``, ``_q`` (the tile pair that a copy of the row takes part in) and ``_side`` (the row's own
    tile). Keys of up to ``most`` rows have the one pair (0, 0). Inside a pair with p = q all rows are to be
    compared with each other, otherwise only rows of different sides: each pair of rows then meets once.
    The table of hot keys is broadcast only when its counted size is at most ``known``.
    """
    hot = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / most).cast("int").alias("_g")), "hot")
    n = hot.count()
    if not n:
        return rows.withColumns({"_p": F.lit(0), "_q": F.lit(0), "_side": F.lit(0)})
    joined = rows.join(F.broadcast(hot) if n <= known else hot, F.col(key) == F.col("_hot"), "left")
    g = F.coalesce("_g", F.lit(1))
    dealt = joined.withColumn("_side", F.pmod(salt, g).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), g - 1)))
    return dealt.withColumns({"_p": F.least("_side", "_other"), "_q": F.greatest("_side", "_other")}).drop("_hot", "_g", "_other")
