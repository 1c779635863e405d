import numpy as np
import pytest

from lodeframe.llm import itq

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def brute(rows):
    use = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {k: set() for k in range(len(use))}
    for a in range(len(use)):
        for b in range(a):
            x, y = use[a], use[b]
            if x[2] == y[2] and len(x[1]) == len(y[1]) and x[1] @ y[1] / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.93:
                links[a].add(b)
                links[b].add(a)
    low = [u[0] for u in use]
    for _ in use:
        low = [min([low[a], *(low[b] for b in links[a])]) for a in links]
    out, ids = [(use[a][0], len(links[a]), low[a], use[a][0] == low[a]) for a in links], [u[0] for u in use]
    for r in rows:
        if r[0] in ids:
            ids.remove(r[0])
        else:
            out.append((r[0], 0, r[0], True))
    return sorted(out, key=str)


def make(n=500, d=32, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(60, d))
    rows = []
    for i in range(n):
        c = centre[i % 60]
        v = c + rng.normal(size=d) * rng.choice([0.05, 0.15, 0.25]) if i % 2 else rng.normal(size=d)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    hot = centre[0]
    rows += [(n + k, [float(np.float32(x)) for x in hot + rng.normal(size=d) * 0.02], 0) for k in range(80)]
    rows += [(n + 100 + k, rows[7][1], rows[7][2]) for k in range(4)] + [rows[9], rows[9]]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 0), (2001, [0.0] * d, 0), (2002, [nan] + [1.0] * (d - 1), 0), (2003, [inf] + [1.0] * (d - 1), 0), (2004, [None] + [1.0] * (d - 1), 0), (2005, [1.0] * d, None), (2006, [], 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0), (None, [1.0, 2.0], 0)]
    return rows


@pytest.mark.parametrize("block", [2048, 24])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(itq, "BLOCK", block)
    rows = make()
    got = [tuple(r) for r in itq.near_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS rep", "1 AS code0", "2 AS g", "3 AS t")).collect()]
    want = brute(rows)
    total = sum(r[1] for r in want)
    assert len(got) == len(want) and {r[0] for r in got} == {r[0] for r in want}
    pairs = sum(r[1] for r in got)
    assert 0.9 * total <= pairs <= total
    by = {}
    for r in want:
        by.setdefault(r[0], r)
    assert all(r[1] <= by[r[0]][1] for r in got)


@pytest.mark.parametrize("rows", [1_000, 1_000_000, 10**9])
def test_recall_of_layouts(rows):
    """Layouts for small and large groups find at least nine tenths of pairs just above the threshold, with at most 64 rows a vector."""
    rng = np.random.default_rng(0)
    d, n = 64, 1500
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=(n, d))
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.94 * a + np.sqrt(1 - 0.94**2) * o
    model = itq.fit_itq(np.concatenate([a, b]))
    x, y = itq.itq_codes(a, model), itq.itq_codes(b, model)
    tables = itq.table_layout(rows)
    met = np.stack([(x[:, own] == y[:, own]).all(axis=1) for own in tables]).any(axis=0)
    assert len(tables) <= 64 and all(len(set(own)) == tables.shape[1] for own in tables.tolist())
    assert (met & ((x != y).sum(axis=1) <= itq.RADIUS)).mean() >= 0.9
    assert abs(x.mean() - 0.5) < 0.05


def test_layout_widens():
    assert [itq.table_layout(10**k).shape[1] for k in (2, 5, 7)] == sorted(itq.table_layout(10**k).shape[1] for k in (2, 5, 7))
    assert itq.table_layout(10**7).shape[1] > itq.table_layout(10**2).shape[1]


def test_overlapping_tables_count_each_pair_once(spark, monkeypatch):
    """Pairs that meet in many tables are still counted once."""
    monkeypatch.setattr(itq, "table_layout", lambda *a: itq.choices(10, 40))
    rows = make(200)
    got = {r.vec_id: r.n_links for r in itq.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.9 * sum(want.values())


def test_text_labels(spark):
    """Labels of any type: the same links as with numbers."""
    rows = make(150)
    numbers, texts = (itq.near_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding", f"{x} AS label")).collect() for x in ("label", "concat('kind', label)"))
    assert sorted(map(str, numbers)) == sorted(map(str, texts)) and sum(r.n_links for r in texts) > 100


def test_empty(spark):
    assert itq.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in itq.near_vectors(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()] == [(1, 0, 1, True)]
