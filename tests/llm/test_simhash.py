import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodeframe.llm import simhash

from .data import DOCS, corpus, frame, odd, words


def brute_fp(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def test_against_brute_force(spark):
    rows = corpus()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    known = [r for r in rows if r[0] is not None]
    comp = brute_components([r[0] for r in known], [brute_fp(r[1]) for r in known])
    want = sorted([(False, r[0], brute_fp(r[1]), int(c)) for r, c in zip(known, comp)] + [(True, 0, brute_fp(r[1]), None) for r in rows if r[0] is None])
    assert got == want


def test_keep_one(spark):
    rows = corpus()
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    known = [r for r in rows if r[0] is not None]
    comp = brute_components([r[0] for r in known], [brute_fp(r[1]) for r in known])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in set(map(int, comp))] + [(True, 0)])


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0
    assert simhash.near_duplicates(frame(spark, odd())).count() == len(odd())


@pytest.mark.parametrize("seed", range(4))
def test_tiles(seed):
    """Tile by tile equals all pairs of a block, with skipped tile pairs, many small and some long blocks, and sides."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(7), base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)), rng.integers(0, 2**20, 300, dtype=np.uint64)])
    block = np.sort(rng.choice(np.arange(-60, 60), len(fp), p=np.r_[[0.6 / 2] * 2, [0.4 / 118] * 118]))
    side, cross = rng.integers(0, 3, len(fp)), np.isin(block, [-60, 5, 7])
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (block[:, None] == block[None, :])
    near &= ~cross[:, None] | (side[:, None] != side[None, :])
    np.fill_diagonal(near, False)
    got = [(int(a), int(b)) for i, j in simhash.tile_links(block, fp, side, cross, 4, tile=16) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near)))))
    want = np.arange(len(fp))
    while True:
        new = np.array([min(want[r].min(initial=w), w) for r, w in zip(near, want)])
        if (new == want).all():
            break
        want = new
    assert (simhash.block_labels(block, fp, side, cross, 4, tile=16) == want).all()


def test_links_are_merged_when_many_are_held(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 50)
    fp, z = np.arange(300, dtype=np.uint64), np.zeros(300, int)
    assert (simhash.block_labels(z, fp, z, z.astype(bool), 1, tile=16) == 0).all()


@pytest.mark.parametrize("groups", [6, 7, 8, 9])
def test_every_layout_meets(spark, groups):
    """Two fingerprints within four bits share a block key under any number of groups, and most others don't."""
    rng = np.random.default_rng(groups)
    rows = []
    for k in range(200):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        rows.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a LONG, b LONG")
    met = df.select(F.arrays_overlap(simhash.block_keys(F.col("a"), groups), simhash.block_keys(F.col("b"), groups)).alias("m")).collect()
    assert all(r.m for r in met) and sum(simhash.group_widths(groups)) == 64


def test_layout_grows():
    assert [simhash.layout(10**k) for k in (0, 5, 8, 10, 12)] == sorted(simhash.layout(10**k) for k in (0, 5, 8, 10, 12))
    assert simhash.layout(1000) == 6 and simhash.layout(10**11) > 7


def test_hot_id_and_equal_rows(spark):
    """Of an id that many rows have one stays, whichever texts they have; rows equal in all columns too."""
    rows = [(7, f"one text {k % 3} of words that differ in most places {k % 3 * 991}", "en", "s", 1) for k in range(60)] + [(8, "another one entirely", "en", "s", 1)] * 3
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [7, 8]


def test_hot_block_is_dealt_over_tiles(spark, monkeypatch):
    """A block of more rows than a tile takes loses no link."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    fps = [int(x) for x in {int(b) ^ (1 << k) for b in rng.integers(0, 2**62, 6) for k in range(0, 60, 3)}]
    comp = brute_components(list(range(len(fps))), fps)
    df = spark.createDataFrame([(i, f if f < 2**63 else f - 2**64) for i, f in enumerate(fps)], "doc_id LONG, fp LONG")
    got = {r.fp & (2**64 - 1): r.component_id for r in simhash.components_of(df).collect()}
    assert got == dict(zip(fps, map(int, comp)))
