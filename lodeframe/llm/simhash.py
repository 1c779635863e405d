"""SimHash near-dedup: tiled exact comparison with numpy exclusive-or and bit counts.

Fingerprints that differ in at most ``radius`` bits are linked. Of G bit groups, radius differing bits spoil as many at most, so two such
fingerprints agree in G - radius groups: they are dealt into blocks by every choice of that many groups. The rows of all blocks of a
task are ordered by block and population count and compared exactly, tile against tile; a tile pair without a common block, or
whose counts differ by more than the radius, is skipped. No link is lost. G grows with the number of fingerprints, so that blocks
stay small: six groups give 15 blocks a row of 2**21 kinds, seven 35 of 2**27, eight 70 of 2**32.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, min_labels, shielded, split_hot, spread, whole_groups
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: What it costs to move a row into one more block, in comparisons.
MOVE = 100
#: Rows of one part of a hot block; rows of a side of the in-memory comparison.
BLOCK, TILE = 4096, 256
#: Links held before they are merged into labels.
HELD = 1 << 20


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles: A-Z lower-cased, repeats counted, XXH64 seed 42; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def add_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", out: str = "fp") -> DataFrame:
    """The ``keep`` columns and ``out``, the fingerprint as a signed long. Only these and the text are read."""
    schema = docs.select(*keep).schema.add(out, "long")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*keep, out])

    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes")).mapInArrow(work, schema)


def group_widths(groups: int) -> list[int]:
    """Widths of the bit groups, from the low end: as equal as can be."""
    return [64 * (k + 1) // groups - 64 * k // groups for k in range(groups)]


def layout(n: int, radius: int = RADIUS) -> int:
    """The number of bit groups for which n fingerprints cost least: rows moved, and comparisons inside blocks."""
    cost = lambda g: math.comb(g, radius) * (MOVE + n / 2 ** sum(sorted(group_widths(g))[: g - radius]))
    return min(range(radius + 2, radius + 7), key=cost)


def block_keys(fp: Column, groups: int, radius: int = RADIUS) -> Column:
    """The block keys of a fingerprint: the number of a choice of groups, then their bits."""
    width = group_widths(groups)
    low = [sum(width[:k]) for k in range(groups)]
    out = []
    for k, chosen in enumerate(combinations(range(groups), groups - radius)):
        key = F.lit(k).cast("long")
        for g in chosen:
            key = F.shiftleft(key, width[g]) + F.shiftrightunsigned(fp, low[g]).bitwiseAND(F.lit((1 << width[g]) - 1))
        out.append(key)
    return F.array(*out)


def tile_links(block: np.ndarray, fp: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one block within the radius, tile pair by tile pair; where rows are marked ``cross``, only pairs of different sides."""
    count = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((count, block))
    block, fp, count, side, cross = block[order], fp[order], count[order], side[order], cross[order]
    for a in range(0, len(fp), tile):
        x = slice(a, a + tile)
        for b in range(a, len(fp), tile):
            y = slice(b, b + tile)
            # a later tile can share the last block of this one only, and counts only rise within a block
            if a != b and (block[y][0] != block[x][-1] or count[y][0] - count[x][-1] > radius):
                break
            near = np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= radius
            near &= block[x][:, None] == block[y][None, :]
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            ok = ~cross[i + a] | (side[i + a] != side[j + b])
            yield order[i[ok] + a], order[j[ok] + b]


def block_labels(block: np.ndarray, fp: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """For each row the smallest row reachable over links; links are merged before too many are held."""
    label, held, n = np.arange(len(fp)), [], 0

    def merged(label: np.ndarray) -> np.ndarray:
        if not held:
            return label
        a, b = np.unique(np.concatenate(held, axis=1), axis=1)
        return min_labels(len(fp), a, b)[label]

    for i, j in tile_links(block, fp, side, cross, radius, tile):
        i, j = label[i], label[j]
        new = i != j
        held.append(np.stack([i[new], j[new]]))
        n += int(new.sum())
        if n > HELD:
            label, held, n = merged(label), [], 0
    return merged(label)


def _forest(radius: int):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            g, fp, rep, side, cross = (t.column(c).to_numpy() for c in ("g", "fp", "rep", "_side", "cross"))
            label = block_labels(g, fp.view(np.uint64), side, cross, radius)
            hung = np.flatnonzero(label != np.arange(len(label)))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(rep[hung]), pa.array(rep[label[hung]])], names=["a", "b"])

    return work


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A forest (a, b) that links the ``rep`` of distinct fingerprints (fp, rep) within the radius. ``distinct`` is a table, read twice."""
    keys = block_keys(F.col("fp"), layout(distinct.count(), radius), radius)
    dealt = split_hot(distinct.select("fp", "rep", F.explode(keys).alias("key")), "key", F.xxhash64("fp"), BLOCK)
    # two blocks that meet in one hash are compared with each other too, which can find true links only
    rows = dealt.select(F.xxhash64("key", "_p", "_q").alias("g"), "fp", "rep", "_side", (F.col("_p") != F.col("_q")).alias("cross"))
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_forest(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id reachable over links.

    Null and word-less texts have fingerprint 0, linked like any other. Equal fingerprints form one class
    before any comparison, so copies cost one row. A null id takes no part in linking: its component_id is
    null. Repeated rows each get their row. Other columns of ``docs`` are not read.
    """
    docs = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    fps = materialize(add_fingerprints(docs, ["doc_id"]), "fingerprints")
    return fps.select("doc_id", "fp").join(components_of(fps, radius), ["fp"], "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def components_of(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of a table (doc_id, fp)."""
    distinct = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(fingerprint_links(distinct, radius))
    return distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id.

    Rows without an id stay; of the rows of one id one stays, chosen by a hash of the text. Texts don't pass through
    Python a second time: ids of groups are joined back to the documents.
    """
    docs, restored = shielded(docs, ["doc_id", "text"])
    cols = docs.columns
    fps = materialize(add_fingerprints(spread(docs.select("doc_id", "text")), ["doc_id"]), "fingerprints")
    roots = components_of(fps, radius).select(F.col("component_id").alias("__root")).distinct()
    kept = docs.join(roots, F.col("doc_id") == F.col("__root"), "left_semi")
    again = materialize(fps.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__again")), "repeated")
    if not again.isEmpty():
        # each task brings a repeated id down to one row before it moves
        first = F.min_by(F.struct(*cols), F.struct(F.xxhash64("text"), F.xxhash64(*cols))).alias("__r")
        one = kept.join(again, F.col("doc_id") == F.col("__again"), "left_semi").groupBy("doc_id").agg(first).select("__r.*")
        kept = kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(one)
    return restored(kept.unionByName(docs.where("doc_id is null")))
