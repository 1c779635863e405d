"""Mixing sources to target weights by subset-sum budget fitting.

Each source's target is met by counting its documents by exact length, giving every length its proportional
share with the rounding error carried on, and fitting the remaining budget with a bounded-knapsack dynamic programme over
the lengths left. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, salted_rank, shielded

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words of each source's budget that are left to the dynamic programme.
WINDOW = 16384


def targets(sizes: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source's size and the excess is shared again by weight until none is above:
    with sources by rising cap per weight, the level is the largest of the budget left per weight left. The windows
    without a key only see one row a source.
    """
    weights = list(weights)
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    own = own.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    own = own.withColumn("cap", F.col("source_size") * float(most))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * share - before) / left
    own = own.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return own.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum is the largest that the budget allows.

    Bounded knapsack: counts are split into powers of two; each reachable sum remembers the piece that first
    reached it, which leaves only earlier pieces below it.
    """
    take = np.zeros(len(lengths), np.int64)
    by, piece_of, piece_n = np.full(budget + 1, -1, np.int32), [], []
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    for k, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if reach[budget]:
            break
        left, n = (min(count, budget // length) if length > 0 else 0), 1
        while left:
            n = min(n, left)
            left -= n
            step = n * length
            if step <= budget:
                new = np.flatnonzero(reach[: budget + 1 - step] & ~reach[step:]) + step
                by[new] = len(piece_n)
                reach[new] = True
                piece_of.append(k)
                piece_n.append(n)
            n *= 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k = piece_of[by[at]]
        take[k] += piece_n[by[at]]
        at -= piece_n[by[at]] * int(lengths[k])
    return take


def fit_source(lengths: np.ndarray, counts: np.ndarray, target: float, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """(whole copies of every document, extra documents by length) whose words come nearest below or at the target."""
    total = int((lengths * counts).sum())
    if total == 0:
        return 0, np.zeros(len(lengths), np.int64)
    copies = int(target // total)
    budget = int(round(target)) - copies * total
    extra = np.zeros(len(lengths), np.int64)
    share, due, got = max(0, budget - window) / total, 0.0, 0
    for k in np.argsort(-lengths, kind="stable"):
        if lengths[k] <= 0:
            continue
        due += share * float(lengths[k] * counts[k])
        extra[k] = max(0, min(int(counts[k]), int((due - got) // lengths[k])))
        got += int(extra[k] * lengths[k])
    rest = budget - got
    # long lengths first: the short ones then fill what is left exactly
    usable = np.flatnonzero((counts > extra) & (lengths > 0) & (lengths <= rest))
    usable = usable[np.argsort(-lengths[usable], kind="stable")]
    extra[usable] += subset_sum(lengths[usable], (counts - extra)[usable], rest)
    return copies, extra


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("_size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def mixed(sized: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """A materialised table with (doc_id, source, _size) and the columns _source_size, _target, _copies of each row.

    The histogram of a source holds a row a distinct length, however many documents it has; ranks within a
    length are dealt over salts, so a hot source or length is never sorted in one task.
    """
    goal = materialize(targets(sized.select("source", F.col("_size").alias("size")), weights, share, most), "targets")
    # a key without nulls, so that ranks and plan meet in one partitioning
    named = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    sized = sized.withColumn("_key", named)
    goals = goal.select(named.alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    known = sized.groupBy("_key", "_size").agg(F.count("*").alias("n")).join(goals, "_key")

    def fit(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("_size", ignore_index=True)
        copies, extra = fit_source(one["_size"].to_numpy(), one["n"].to_numpy(), float(one["_target"].iloc[0]))
        return one.drop(columns="n").assign(_whole=copies, _extra=extra)

    plan = materialize(known.groupBy("_key").applyInPandas(fit, "_key string, _size long, _source_size long, _target double, _whole long, _extra long"), "plan")
    tie = F.xxhash64(F.lit(seed), F.col("doc_id"))
    ranked = salted_rank(sized, ["_key", "_size"], [tie, F.col("doc_id")], tie, "_rank")
    out = ranked.join(plan, ["_key", "_size"], "left")
    return out.withColumn("_copies", F.col("_whole") + (F.col("_rank") < F.col("_extra")).cast("long")).drop("_key", "_whole", "_extra", "_rank")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of (doc_id, text, source).

    Null and word-less texts have size 0 and take nothing. Null sources are one source, the last. Repeated rows are
    documents of their own; null ids rank first among equal hashes. Other columns are not read.
    """
    sized = materialize(with_sizes(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    out = mixed(sized)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: a row for each copy taken, none where none is."""
    docs, restored = shielded(docs, ["doc_id", "text", "source"])
    out = mixed(materialize(with_sizes(docs), "sized"))
    return restored(out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
