"""Embedding near-dedup: iterative quantisation codes, multi-index Hamming tables, rerank with the vectors.

ITQ (Gong & Lazebnik, CVPR 2011) learns a rotation under which sign bits lose least; cutting each axis at
its median balances the bits. Codes are indexed in several tables, each on its own choice of bits (after Norouzi et al.,
CVPR 2012; the choices overlap where disjoint ones would be too few). Rows that meet in a table and whose codes lie within the Hamming
radius are reranked by exact cosine in double precision. Only codes are dealt into the tables; vectors follow for
the rows that have found a partner there. The rotation is fitted on a bounded sample, every row is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import materialize, min_labels, split_hot, whole_groups
from .components import connected_components

THRESHOLD = 0.93
BITS = 128
#: Full-code Hamming radius beyond which no pair is reranked: over six deviations above the mean at the threshold, four below that of unlike vectors.
RADIUS = 40
#: Vectors that the rotation is fitted on at most, chosen by a hash of their content.
SAMPLE = 8192
#: Rows of one part of a hot bucket; rows of a side of the comparison in memory.
BLOCK, TILE = 2048, 256
#: Tables at most: rows that a vector becomes.
TABLES = 64


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest part first, so squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_itq(x: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, projection, cut) learnt from unit rows; bit k of a row is (row - mean) @ projection[:, k] > cut[k].

    Where bits exceed the dimension, the data are laid into more axes by a seeded orthonormal frame first.
    """
    rng, d = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(axis=0)
    v = x - mean
    axes = np.linalg.svd(v.T @ v)[0][:, :bits] if bits <= d else np.linalg.qr(rng.normal(size=(bits, d)))[0].T
    v = v @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = right.T @ left.T
    return mean, axes @ turn, np.median(v @ turn, axis=0)


def itq_codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The bits of unit rows, a byte 0 or 1 each."""
    mean, projection, cut = model
    return ((x - mean) @ projection > cut).astype(np.uint8)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def choices(width: int, number: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """``number`` choices of ``width`` bits each, dealt from shuffled rounds of all bits: disjoint while they last."""
    rng, deck, out = np.random.default_rng(seed), [], []
    for _ in range(number):
        if len(deck) < width:
            deck += rng.permutation([b for b in range(bits) if b not in deck]).tolist()
        out.append(deck[:width])
        deck = deck[width:]
    return np.array(out)


def table_layout(n: int, threshold: float = THRESHOLD, bits: int = BITS, recall: float = 0.96, most: int = TABLES) -> np.ndarray:
    """The bits of each table, for groups of n rows.

    The width follows log2(n), so that a bucket keeps about 2**5 rows; there are as many tables as let a pair exactly at the threshold,
    each bit differing with probability angle/pi, meet in one with probability ``recall``. Where that takes more than ``most`` tables the
    width shrinks instead, and buckets hold more codes.
    """
    apart = np.random.default_rng(3).random((20_000, bits)) < math.acos(threshold) / math.pi
    for width in range(min(28, max(8, math.ceil(math.log2(max(n, 2))) - 5)), 0, -1):
        tables = choices(width, most, bits)
        met = np.zeros(len(apart), bool)
        for k, own in enumerate(tables):
            met |= ~apart[:, own].any(axis=1)
            if met.mean() >= recall:
                return tables[: k + 1]
    raise ValueError(f"no layout of {most} tables gives recall {recall}")


def _masks(tables: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The words of each table's bits."""
    return packed(np.stack([np.isin(np.arange(bits), own) for own in tables]).astype(np.uint8))


def _matrices(column: pa.Array, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length of a list column without nulls."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(length)])
    for d in np.unique(length):
        rows = np.flatnonzero(length == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


def bucket_pairs(t: pa.Table, masks: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (i, j) of one bucket within the radius that meet in no earlier table, tile by tile over rows sorted by ``g``.

    Where a bucket is dealt into parts, rows of different sides only. Buckets that share a ``g`` by chance are told apart.
    """
    g, table, p, q, side = (t.column(c).to_numpy() for c in ("g", "t", "_p", "_q", "_side"))
    code = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("code0", "code1")])
    label, dim = t.column("label").to_numpy(), t.column("dim").to_numpy()
    for a in range(0, len(g), tile):
        x = slice(a, a + tile)
        for b in range(a, len(g), tile):
            y = slice(b, b + tile)
            if a != b and g[y][0] != g[x][-1]:
                break
            near = sum(np.bitwise_count(w[x][:, None] ^ w[y][None, :]) for w in code) <= radius
            near &= g[x][:, None] == g[y][None, :]
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            ok = (table[i] == table[j]) & (p[i] == p[j]) & (q[i] == q[j]) & (dim[i] == dim[j]) & (label[i] == label[j]) & ((p[i] == q[i]) | (side[i] != side[j]))
            i, j = i[ok], j[ok]
            apart, first = code[:, i] ^ code[:, j], np.ones(len(i), bool)
            for k, mask in enumerate(masks):
                same = ((apart[0] & mask[0]) | (apart[1] & mask[1])) == 0
                first &= np.where(k < table[i], ~same, (k > table[i]) | same)
            yield i[first], j[first]


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, sample: int = SAMPLE, recall: float = 0.96,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    Vectors are compared within a label and a length only. Null labels and vectors that are null, empty, zero or
    hold null or non-finite parts link with nothing; so do null ids, whose component_id is null and which are
    kept. Equal vectors of a label form one class before the comparison, counted and linked in full. Repeated rows
    count as vectors of their own. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    classes = materialize(
        rows.where(valid).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt")).withColumn("dim", F.size("embedding")), "vectors")
    group = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables = table_layout(group, threshold, BITS, recall)
    masks = _masks(tables)
    models: dict[int, tuple] = {}
    drawn = classes.select("embedding", "dim", F.xxhash64("embedding").alias("h")).orderBy("h").limit(sample).collect()
    for d in sorted({r["dim"] for r in drawn}):
        models[d] = fit_itq(unit_rows(np.array([r["embedding"] for r in drawn if r["dim"] == d])))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (1 << np.arange(tables.shape[1])).astype(np.int64)
        for b in batches:
            bits, length = np.zeros((b.num_rows, BITS), np.uint8), b.column("dim").to_numpy()
            for at, x in _matrices(b.column("embedding"), length) if b.num_rows else ():
                d = x.shape[1]
                # a length that the sample missed has its own seeded frame
                model = models.get(d) or (np.zeros(d), np.linalg.qr(np.random.default_rng(d).normal(size=(max(d, BITS), max(d, BITS))))[0][:d, :BITS], np.zeros(BITS))
                bits[at] = itq_codes(unit_rows(x), model)
            code = packed(bits).view(np.int64)
            keys = np.stack([bits[:, own].astype(np.int64) @ place for own in tables], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code[:, 0]), pa.array(code[:, 1]), lists], names=[*b.schema.names, "code0", "code1", "keys"])

    fields = [StructField("code0", LongType()), StructField("code1", LongType()), StructField("keys", ArrayType(IntegerType()))]
    coded = materialize(classes.mapInArrow(encode, StructType([*classes.schema.fields, *fields])), "codes")
    slim = coded.select("label", "dim", "rep", "code0", "code1", F.posexplode("keys").alias("t", "k"))
    dealt = split_hot(slim.withColumn("key", F.xxhash64("label", "dim", "t", "k")).drop("k"), "key", F.xxhash64("rep"), BLOCK)
    met = dealt.withColumn("g", F.xxhash64("key", "_p", "_q")).select("g", "label", "dim", "rep", "code0", "code1", "t", "_p", "_q", "_side")

    def partners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a partner in their bucket."""
        for t in whole_groups(batches, "g"):
            hit = np.zeros(t.num_rows, bool)
            for i, j in bucket_pairs(t, masks, radius):
                hit[i] = hit[j] = True
            if hit.any():
                yield from t.filter(pa.array(hit)).combine_chunks().to_batches()

    some = materialize(met.repartition("g").sortWithinPartitions("g").mapInArrow(partners, met.schema), "met")
    full = some.join(coded.select("rep", "cnt", "embedding"), "rep")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "g"):
            t = t.combine_chunks()
            rep, cnt = t.column("rep").to_numpy(), t.column("cnt").to_numpy()
            x = {d: (np.searchsorted(at, np.arange(t.num_rows)), unit_rows(m)) for at, m in _matrices(t.column("embedding").combine_chunks(), t.column("dim").to_numpy()) for d in [m.shape[1]]}
            add, label, dim = np.zeros(t.num_rows, np.int64), np.arange(t.num_rows), t.column("dim").to_numpy()
            for i, j in bucket_pairs(t, masks, radius):
                ok = np.zeros(len(i), bool)
                for d, (at, m) in x.items():
                    own = np.flatnonzero(dim[i] == d)
                    for k in range(0, len(own), 65536):
                        part = own[k : k + 65536]
                        ok[part] = np.einsum("ij,ij->i", m[at[i[part]]], m[at[j[part]]]) >= threshold
                i, j = i[ok], j[ok]
                np.add.at(add, i, cnt[j])
                np.add.at(add, j, cnt[i])
                # links of one tile pair are merged before the next is compared
                a, b = label[i], label[j]
                if (a != b).any():
                    label = min_labels(t.num_rows, a[a != b], b[a != b])[label]
            hit = np.flatnonzero(add)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(add[hit]), pa.array(rep[label[hit]])], names=["rep", "add", "root"])

    found = materialize(full.repartition("g").sortWithinPartitions("g").mapInArrow(link, "rep long, add long, root long"), "vector-links")
    nodes = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    others = found.groupBy("rep").agg(F.sum("add").alias("others"))
    done = coded.select("label", "embedding", "rep", "cnt").join(others, "rep", "left").join(nodes, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.col("cnt") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.withColumn("_ok", valid).join(done, F.col("_ok") & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
