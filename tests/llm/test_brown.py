import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lodeframe.llm import brown

from .data import DOCS, corpus, frame


def tokens(t):
    return (t or "").encode().lower().split()


def test_base_and_counts(spark, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", 900)
    rows = corpus(150)
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    c = Counter(w for r in rows if train(r[0]) for w in [*tokens(r[1]), None])
    total, types = sum(c.values()), len(c)
    got = sorted(((str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in brown.score(frame(spark, rows)).collect()))
    want = []
    for r in rows:
        w = [*tokens(r[1]), None]
        want.append((str(r[0]), len(w), not train(r[0]), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + types + 1)) for x in w)))
    for g, x in zip(got, sorted(want)):
        assert g[:5] == x[:5] and g[5] == pytest.approx(x[5]) and g[6] < 0


def test_held_out_accuracy(spark):
    """Two languages with words of their own: the model is closer to held-out texts than the base."""
    rng = np.random.default_rng(0)
    vocab = [[f"{a}{k}" for k in range(300)] for a in ("al", "be")]
    p = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(vocab[i % 2], 60, p=p / p.sum())), "en", "s", 0) for i in range(300)]
    out = [r for r in brown.score(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert len(out) > 10 and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def learnt_from(rows):
    return [tokens(r[1]) for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]


def brute_scores(rows, head, classes):
    """log10 probability of each text, by dictionaries over the training texts; ``classes`` has the class of each head word, each shape and of the end (None)."""
    texts = learnt_from(rows)
    count = Counter(w for t in texts for w in t)
    of = lambda w: w if w is None or w in head else brown.shape(w)
    use = Counter(of(w) for t in texts for w in [*t, None])
    units = [None, *head, *range(brown.SHAPES)]
    grid, into = Counter(), Counter()
    for t in texts:
        c = [classes[of(w)] for w in [None, *t, None]]
        grid.update(zip(c, c[1:]))
    for (a, _), n in grid.items():
        into[a] += n
    held, seen = Counter(), Counter()
    for u in units:
        held[classes[u]] += use[u] + 0.1
        seen[classes[u]] += use[u]
    total = sum(use.values())
    share = {c: (seen[c] + 0.5) / (total + 0.5 * brown.CLASSES) for c in held}
    norm = sum(share.values())

    def within(w):
        if w is None or w in head:
            return 1.0
        own = [n for x, n in count.items() if x not in head and brown.shape(x) == brown.shape(w)]
        if not own:
            return 1.0
        once, twice = own.count(1), own.count(2)
        cut = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        return (count[w] - cut) / sum(own) if count[w] else cut * len(own) / sum(own)

    out = []
    for r in rows:
        w, value = [None, *tokens(r[1]), None], 0.0
        for a, b in zip(w, w[1:]):
            x, y = classes[of(a)], classes[of(b)]
            step = (grid[x, y] + brown.KAPPA * share[y] / norm) / (into[x] + brown.KAPPA)
            value += math.log10(step) + math.log10((use[of(b)] + 0.1) / held[y]) + math.log10(within(b))
        out.append(value)
    return out


def test_score_against_brute_force(spark, monkeypatch):
    """Scores of all texts, nulls, repeats, long and unseen words included, from the classes that the model learnt."""
    monkeypatch.setattr(brown, "HEAD", 300)
    monkeypatch.setattr(brown, "SEEDS", 100)
    kept = {}
    real_words, real_cluster = brown.frequent_words, brown.cluster
    monkeypatch.setattr(brown, "frequent_words", lambda *a: kept.setdefault("words", real_words(*a)))
    monkeypatch.setattr(brown, "cluster", lambda *a: kept.setdefault("classes", real_cluster(*a)))
    rows = corpus(150) + [(5_000 + k, f"unseen{k} never met", "en", "s", 1) for k in range(20)]
    got = sorted(((str(r.doc_id), r.n_tokens, r.score) for r in brown.score(frame(spark, rows)).collect()))
    words, of = kept["words"][0], kept["classes"][0]
    assert 100 < len(words) <= 300 and len(of) == 1 + len(words) + brown.SHAPES
    classes = {u: int(c) for u, c in zip([None, *words, *range(brown.SHAPES)], of)}
    want = sorted((str(r[0]), len(tokens(r[1])) + 1, x) for r, x in zip(rows, brute_scores(rows, set(words), classes)))
    for g, x in zip(got, want):
        assert g[:2] == x[:2] and g[2] == pytest.approx(x[2], rel=1e-9)


def stream(spark, texts, words):
    shared = spark.sparkContext.broadcast(words)
    rows = spark.createDataFrame([(k, bytearray(b" ".join(t))) for k, t in enumerate(texts)], "doc_id LONG, bytes BINARY").repartition(3)
    return brown.encoded(rows, shared)


def test_sweeps_sort_words_by_use(spark, monkeypatch):
    """Words beyond the seeds whose shape says nothing find classes of words used alike, and every counted class pair is right."""
    monkeypatch.setattr(brown, "SEEDS", 30)
    monkeypatch.setattr(brown, "CLASSES", 8)
    rng = np.random.default_rng(4)
    kinds = [[(f"w{k}{a}{k % 10}" if k % 2 else f"{a}{k}zz").encode() for k in range(60)] for a in "xyz"]
    p = 1 / np.arange(1, 61)
    texts = [[kinds[j % 3][k] for j, k in enumerate(rng.choice(60, 40, p=p / p.sum()))] for _ in range(400)]
    count = Counter(w for t in texts for w in t)
    words = sorted(count, key=lambda w: (-count[w], w))
    enc = stream(spark, texts, words)
    before, g0 = brown.cluster(enc, words, sweeps=0)
    of, grid = brown.cluster(enc, words, sweeps=4)
    assert brown.likelihood(grid) > brown.likelihood(g0)
    classes = {u: int(c) for u, c in zip([None, *words], of)}
    pairs = Counter((classes[a], classes[b]) for t in texts for a, b in zip([None, *t], [*t, None]))
    assert {(a, b): int(grid[a, b]) for a, b in zip(*np.nonzero(grid))} == dict(pairs)
    kind = {w: k for k, ws in enumerate(kinds) for w in ws}
    mixed = sum(Counter(kind[w] for w in words if classes[w] == c).most_common(1)[0][1] for c in {classes[w] for w in words})
    assert mixed > 0.9 * len(words) and of[0] == 0 and (of[1:] > 0).all()


def test_best_class_is_best():
    """The class found is the one of highest likelihood when all are tried, for units without themselves as neighbours."""
    rng = np.random.default_rng(7)
    n, c = 40, 6
    pairs = rng.poisson(2.0, (n, n)).astype(float)
    np.fill_diagonal(pairs, 0)
    of = np.concatenate([[0], rng.integers(1, c, n - 1)])

    def value(of):
        one = np.eye(c)[of]
        return brown.likelihood(one.T @ pairs @ one)

    one = np.eye(c)[of]
    for w in range(1, n):
        right, left = pairs[w] @ one, one.T @ pairs[:, w]
        new = int(brown.best_classes(np.concatenate([right, left])[None, :], of[w : w + 1], one.T @ pairs @ one)[0])
        tried = [value(np.where(np.arange(n) == w, k, of)) for k in range(1, c)]
        assert tried[new - 1] >= tried[of[w] - 1] - 1e-6 and sum(x > tried[new - 1] + 2.0 for x in tried) == 0


def test_distribution_sums_to_one(spark):
    """After any class, all seen words, and each shape's unseen word, share probability one."""
    rng = np.random.default_rng(1)
    words = [f"w{k}".encode() for k in range(2000)]
    counts = np.sort(rng.integers(1, 400, 2000))[::-1]
    head = 500
    unit = np.array([k + 1 if k < head else 1 + head + brown.shape(w) for k, w in enumerate(words)])
    n_units = 1 + head + brown.SHAPES
    row = np.concatenate([[0], rng.permutation(np.repeat(unit, counts)), [0]])
    of = np.concatenate([[0], rng.integers(1, brown.CLASSES, n_units - 1)])
    grid = np.zeros((brown.CLASSES, brown.CLASSES))
    np.add.at(grid, (of[row[:-1]], of[row[1:]]), 1)
    stats = {}
    for s in range(brown.SHAPES):
        own = counts[unit == 1 + head + s]
        if len(own):
            stats[s] = int(own.sum()), len(own), int((own == 1).sum()), int((own == 2).sum())
    model = brown.make_model(of, grid, np.bincount(row[1:], minlength=n_units).astype(float), stats)
    s = np.maximum(unit - 1 - head, 0)
    within = np.where(unit > head, np.log10(np.maximum(counts - model.cut[s], 1e-9) / model.size[s]), 0.0)
    for c in (0, 5):
        p = 10 ** (model.step[c, of[unit]] + model.unit[unit] + within)
        shapes = 1 + head + np.arange(brown.SHAPES)
        rest = 10 ** (model.step[c, of[shapes]] + model.unit[shapes] + model.unseen)
        assert p.sum() + rest.sum() + 10 ** (model.step[c, 0] + model.unit[0]) == pytest.approx(1, abs=1e-6)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 3, 60)
    pairs = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 20, 1)).astype(float)

    def value(of):
        one = np.eye(8)[of]
        g = one.T @ pairs @ one
        return brown._f(g).sum() - brown._f(g.sum(0)).sum() - brown._f(g.sum(1)).sum()

    start = np.concatenate([[0], 1 + np.arange(59) % 7])
    of = brown.exchange(pairs, classes=8)
    assert of[0] == 0 and (of[1:] > 0).all() and value(of) > value(start)
    for c in range(1, 8):
        assert len(set(kind[1:][of[1:] == c])) <= 1


def test_empty(spark):
    assert brown.score(spark.createDataFrame([], DOCS)).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    out = brown.score(spark.createDataFrame([(i, "never seen", None, None, None) for i in held], DOCS)).collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in out] == [(0, 0, 0.0)] * 2
