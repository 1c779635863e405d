"""Language-model scoring with Brown class-based bigrams.

A token's probability is P(class | class before) * P(unit | class) * P(word | unit) (Brown et al., CL 1992). Units are the
words of the vocabulary, the end of a text, and shape units that hold all rarer words by their last two bytes. Exchange
clustering (Martin, Liermann & Ney 1998) assigns units to classes by the likelihood of the corpus's class bigrams: exactly, one after the other,
for the most frequent words and the shapes, which seeds the classes; then for all units at once by distributed sweeps (Uszkoreit &
Brants, ACL 2008) over sparse counts of each unit beside each class. Class transitions are smoothed towards class frequencies; words of a shape
unit are discounted absolutely, and what that frees is the unit's probability of unseen words.

The vocabulary grows with the corpus, up to HEAD words; counts cover all training texts. What a task or the driver holds is bounded by HEAD
and CLASSES; counts of all rarer words are met by a shuffle join. Texts are split into words twice, to count them and to write
them as unit numbers; all else reads the numbers.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, runs, spread, whole_groups

CLASSES = 64
SHAPES = 256
#: Words that seed the classes, with the shapes, by exact exchange on the driver.
SEEDS = 767
#: Words with a unit of their own at most, the memory that every task has for them; all rarer ones share shape units.
HEAD = 200_000
#: Sweeps of the exact exchange and of the distributed one.
SWEEPS, WIDE_SWEEPS = 10, 2
#: Turns of a distributed sweep; of the units, each turn moves one in so many.
PARTS = 2
#: Weight of the class frequencies in a class's transitions, in tokens.
KAPPA = 20.0
#: Pairs that a task sorts at a time.
_PAIRS = 1_000_000
#: Texts encoded at a time.
_ROWS = 512


def shape(word: bytes) -> int:
    """Shape of a word from its last two bytes: 0..SHAPES-1."""
    return zlib.crc32(word[-2:]) % SHAPES


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, isn't 2. A null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the words of a binary column ``bytes``, A-Z lower-cased; counted in each task first."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column(0):
                seen.update((t.as_py() or b"").lower().split())
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return texts.select("bytes").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int | None = None) -> tuple[list[bytes], np.ndarray, int]:
    """The most frequent words by falling count, at most ``most`` (HEAD), their counts, and the least count that all of them have and no other word.

    A histogram over a few hundred bands of counts tells the least count for which all its words still fit, so no task
    gathers more than the words returned.
    """
    most = HEAD if most is None else most
    bands = counts.groupBy(F.floor(F.log2("n") * 8).alias("band")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, total = 2**62, 0
    for band in sorted(bands, key=lambda r: -r["band"]):
        total += band["words"]
        if total > most:
            break
        least = band["least"]
    found = counts.where(F.col("n") >= least).toArrow()
    pairs = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    return [w for w, _ in pairs], np.array([n for _, n in pairs], np.int64), least


#: Worker-local lookups, by the name of what they were made from.
_READY: dict[str, object] = {}


def _ready(name: str, make):
    if name not in _READY:
        _READY.clear()
        _READY[name] = make()
    return _READY[name]


def encoded(rows: DataFrame, words) -> DataFrame:
    """(uid, doc_id, held_out, units, tails) of (doc_id, bytes): the unit of each word, and the rarer words with their shapes.

    Unit 0 is the end of a text, which is not written; then come the broadcast ``words``, then the shapes.
    """
    name = uuid.uuid4().hex

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _ready(name, lambda: {x: k + 1 for k, x in enumerate(words.value)})
        first, kind = len(at) + 1, pa.struct([("word", pa.binary()), ("s", pa.int32())])
        for whole in batches:
            for begin in range(0, whole.num_rows, _ROWS):
                b = whole.slice(begin, _ROWS)
                flat, lengths, rare, shapes, tails = [], [], [], [], []
                for t in b.column("bytes"):
                    w = (t.as_py() or b"").lower().split()
                    u = np.fromiter((at.get(x, 0) for x in w), np.int32, len(w))
                    places = np.flatnonzero(u == 0)
                    if len(places):
                        own = [w[i] for i in places.tolist()]
                        s = [zlib.crc32(x[-2:]) % SHAPES for x in own]
                        u[places] = np.array(s, np.int32) + first
                        rare += own
                        shapes += s
                    flat.append(u)
                    lengths.append(len(w))
                    tails.append(len(places))
                units = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(np.concatenate(flat)))
                words_of = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(shapes, pa.int32())], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *tails]), pa.int32()), words_of)
                yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names[:3]), units, lists], names=names)

    names = ["uid", "doc_id", "held_out", "units", "tails"]
    marked = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "bytes")
    kind = dict(rows.dtypes)["doc_id"]
    return materialize(marked.mapInArrow(work, f"uid long, doc_id {kind}, held_out boolean, units array<int>, tails array<struct<word: binary, s: int>>"), "encoded")


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of a batch of texts, each with an end, after a first end: neighbours are pairs. And where each text stops."""
    lengths = np.diff(column.offsets.to_numpy())
    stops = np.cumsum(lengths + 1)
    out = np.zeros(int(stops[-1]) + 1 if len(stops) else 1, np.int32)
    inside = np.ones(len(out), bool)
    inside[0] = False
    inside[stops] = False
    out[inside] = column.flatten().to_numpy()
    return out, stops


def bigrams(texts: DataFrame, of: np.ndarray) -> np.ndarray:
    """Counts of neighbouring groups over all texts, each between two ends; ``of`` has the group of each unit, and is broadcast."""
    size, shared = int(of.max()) + 1, texts.sparkSession.sparkContext.broadcast(of.astype(np.int32))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = shared.value, np.zeros(size * size, np.int64)
        for b in batches:
            g = of[_texts(b.column(0))[0]].astype(np.int64)
            pairs, n = np.unique(g[:-1] * size + g[1:], return_counts=True)
            counts[pairs] += n
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["pair", "n"])

    rows = texts.select("units").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    shared.unpersist()
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: each in turn moves to the class that raises the likelihood most, until none moves.

    Unit 0 keeps class 0 to itself.
    """
    n = len(pairs)
    of = np.concatenate([[0], 1 + np.arange(n - 1) % (classes - 1)])
    one = np.eye(classes)[of]
    grid = one.T @ pairs @ one
    by_use = 1 + np.argsort(-pairs.sum(axis=1)[1:], kind="stable")
    for _ in range(sweeps):
        moved = 0
        to, back = pairs @ one, one.T @ pairs  # units to classes, classes to units
        for w in by_use.tolist():
            total = pairs[w].sum()
            if not total:
                continue
            old, self_ = of[w], pairs[w, w]
            right, left = to[w].copy(), back[:, w].copy()
            right[old] -= self_
            left[old] -= self_
            grid[old, :] -= right
            grid[:, old] -= left
            grid[old, old] -= self_
            row, col, diag, base = grid.sum(axis=1), grid.sum(axis=0), np.diag(grid), _f(grid)
            gain_r, gain_l = _f(grid + right[None, :]) - base, _f(grid + left[:, None]) - base
            gain = gain_r.sum(axis=1) - np.diag(gain_r) + gain_l.sum(axis=0) - np.diag(gain_l)
            gain += _f(diag + right + left + self_) - _f(diag)
            gain -= _f(row + right.sum() + self_) - _f(row) + _f(col + left.sum() + self_) - _f(col)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new, :] += right
            grid[:, new] += left
            grid[new, new] += self_
            if new != old:
                moved += 1
                of[w] = new
                one[w, old], one[w, new] = 0, 1
                to[:, old] -= pairs[:, w]
                to[:, new] += pairs[:, w]
                back[old, :] -= pairs[w, :]
                back[new, :] += pairs[w, :]
        if not moved:
            break
    return of


def likelihood(grid: np.ndarray) -> float:
    """What the classes add to the corpus's log likelihood."""
    return float(_f(grid).sum() - _f(grid.sum(axis=0)).sum() - _f(grid.sum(axis=1)).sum())


def best_classes(beside: np.ndarray, old: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For each unit the class in which it raises the likelihood most, all others staying.

    A row of ``beside`` has a unit's counts before each class, then after each class. Its own counts are taken off the cells of its ``old`` class.
    """
    classes = len(grid)
    both = np.concatenate([grid.T, grid])  # for the class beside, the cells of each class that the unit could have
    f_both, sums = _f(both), np.stack([grid.sum(axis=1), grid.sum(axis=0)])
    gain = np.zeros((len(beside), classes))
    unit, slot = np.nonzero(beside)
    for at in range(0, len(unit), 16_384):
        u, d = unit[at : at + 16_384], slot[at : at + 16_384]
        n, cells, mine = beside[u, d], both[d], np.arange(len(u))
        more = _f(cells + n[:, None]) - f_both[d]
        own = cells[mine, old[u]]
        more[mine, old[u]] = _f(own) - _f(np.maximum(own - n, 0))
        start, _ = runs(u)
        np.add.at(gain, u[start], np.add.reduceat(more, start))
    every = np.arange(len(beside))
    for side, total in enumerate((beside[:, :classes].sum(axis=1), beside[:, classes:].sum(axis=1))):
        less = _f(sums[side] + total[:, None]) - _f(sums[side])
        own = sums[side][old]
        less[every, old] = _f(own) - _f(np.maximum(own - total, 0))
        gain -= less
    gain[:, 0] = -np.inf  # the end's own
    new = np.argmax(gain, axis=1)
    return np.where(gain[every, new] > gain[every, old] + 1e-9, new, old)


def sweep(texts: DataFrame, of: np.ndarray, grid: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Each unit of one part moves to the class that is best for it, all others staying as they are.

    A task counts its units beside classes, sorted a few million pairs at a time; a unit's counts move as one row a task and meet in one task,
    at most 2 * CLASSES numbers each.
    """
    classes, shared = len(grid), texts.sparkSession.sparkContext.broadcast((of.astype(np.int32), grid))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = shared.value[0], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            unit, slot = keys // (2 * classes), (keys % (2 * classes)).astype(np.int16)
            start, _ = runs(unit)
            for a in range(0, len(start), 20_000):
                s = np.append(start[a : a + 20_001], len(keys))[: min(20_000, len(start) - a) + 1]
                at = pa.array(s - s[0], pa.int32())
                lists = (pa.ListArray.from_arrays(at, pa.array(x[s[0] : s[-1]])) for x in (slot, n.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(unit[s[:-1]].astype(np.int32)), *lists], names=["unit", "slots", "counts"])

        for b in batches:
            u = _texts(b.column(0))[0].astype(np.int64)
            c = of[u]
            for own, other, side in ((u[:-1], c[1:], 0), (u[1:], c[:-1], classes)):
                mine = (own > 0) & (own % parts == part)
                held.append(own[mine] * (2 * classes) + side + other[mine])
                size += len(held[-1])
            if size > _PAIRS:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def move(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, grid = shared.value
        for t in whole_groups(batches, "unit"):
            t = t.combine_chunks()
            unit = t.column("unit").to_numpy()
            each, number = np.unique(unit, return_inverse=True)
            table = np.zeros((len(each), 2 * classes))
            slots, counts = (t.column(c).combine_chunks() for c in ("slots", "counts"))
            np.add.at(table, (np.repeat(number, np.diff(slots.offsets.to_numpy())), slots.flatten().to_numpy()), counts.flatten().to_numpy())
            new = best_classes(table, of[each], grid)
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(new.astype(np.int32))], names=["unit", "class"])

    found = texts.select("units").mapInArrow(count, "unit int, slots array<short>, counts array<int>")
    moved = found.repartition("unit").sortWithinPartitions("unit").mapInArrow(move, "unit int, class int").toArrow()
    shared.unpersist()
    new = of.copy()
    new[moved.column("unit").to_numpy()] = moved.column("class").to_numpy()
    return new


def cluster(texts: DataFrame, words: list[bytes], sweeps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the counts of neighbouring classes, of the encoded training ``texts``."""
    shapes = np.array([shape(w) for w in words], np.int64)
    top = min(SEEDS, len(words))
    seed = np.concatenate([[0], np.where(np.arange(len(words)) < top, 1 + np.arange(len(words)), 1 + top + shapes), 1 + top + np.arange(SHAPES)])
    of = exchange(bigrams(texts, seed), CLASSES)[seed]
    grid = _grid(texts, of)
    # units that would follow each other to and fro move by turns, fewer at once where a turn made things worse
    parts = PARTS
    for k in range(PARTS * (WIDE_SWEEPS if sweeps is None else sweeps)):
        new = sweep(texts, of, grid, k % parts, parts)
        now = _grid(texts, new)
        if likelihood(now) > likelihood(grid):
            of, grid = new, now
        else:
            parts *= 2
    return of, grid


def _grid(texts: DataFrame, of: np.ndarray) -> np.ndarray:
    out = np.zeros((CLASSES, CLASSES))
    found = bigrams(texts, of)
    out[: len(found), : len(found)] = found
    return out


@dataclass
class Model:
    """A trained model. By unit: class, and log10 of its share of the class. Between classes: log10 transitions. By shape: words, discount, log10 of an unseen word's share."""

    of: np.ndarray
    unit: np.ndarray
    step: np.ndarray
    size: np.ndarray
    cut: np.ndarray
    unseen: np.ndarray


def make_model(of: np.ndarray, grid: np.ndarray, use: np.ndarray, stats: dict[int, tuple[int, int, int, int]]) -> Model:
    """From classes, counts of neighbouring classes, occurrences of units, and per shape its (words, types, once, twice) in training."""
    classes = len(grid)
    held = np.bincount(of, use + 0.1, classes)
    share = np.where(held > 0, (np.bincount(of, use, classes) + 0.5) / (use.sum() + 0.5 * classes), 0)  # classes without units take no probability
    share /= share.sum()
    step = (grid + KAPPA * share[None, :]) / (grid.sum(axis=1, keepdims=True) + KAPPA)
    size, cut, unseen = np.ones(SHAPES), np.zeros(SHAPES), np.zeros(SHAPES)
    for s, (n, types, once, twice) in stats.items():
        cut[s] = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        size[s], unseen[s] = n, np.log10(cut[s] * types / n)
    return Model(of, np.log10((use + 0.1) / held[of]), np.log10(np.maximum(step, 1e-300)), size, cut, unseen)


def shape_stats(counts: DataFrame, least: int) -> dict[int, tuple[int, int, int, int]]:
    """(words, types, once, twice) of the words rarer than ``least``, by shape."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = np.array([shape(w) for w in b.column("word").to_pylist()], np.int64), b.column("n").to_numpy()
            table = np.zeros((4, SHAPES), np.int64)
            for k, v in enumerate((n, 1, n == 1, n == 2)):
                np.add.at(table[k], s, v)
            hit = np.flatnonzero(table[1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hit, *table[:, hit])], names=["s", "n", "types", "once", "twice"])

    sums = [F.sum(c).alias(c) for c in ("n", "types", "once", "twice")]
    rows = counts.where(F.col("n") < least).mapInArrow(work, "s long, n long, types long, once long, twice long").groupBy("s").agg(*sums).collect()
    return {r["s"]: (r["n"], r["types"], r["once"], r["twice"]) for r in rows}


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of (doc_id, text).

    Null texts are empty and have the end alone. A null id counts as the empty text (in training). Repeated rows are
    documents of their own. Without any training text all base probabilities are 1/1. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = spread(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes")))
    train = rows.where(in_training(F.col("doc_id")))
    counts = materialize(word_counts(train), "counts")
    words, n_head, least = frequent_words(counts)
    vocabulary = spark.sparkContext.broadcast(words)  # at most HEAD
    texts = encoded(rows, vocabulary)
    learnt = texts.where("not held_out")
    ends = learnt.count()
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    total, types = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    stats = shape_stats(counts, least)
    of, grid = cluster(learnt, words)
    use = np.concatenate([[ends], n_head, [stats[s][0] if s in stats else 0 for s in range(SHAPES)]]).astype(float)
    model = make_model(of, grid, use, stats)
    known = np.concatenate([[ends > 0], np.ones(len(words), bool), np.zeros(SHAPES, bool)])
    # rarer words are met below
    base = np.concatenate([np.log10((np.concatenate([[ends], n_head]) + 1) / (total + types + 1)), np.zeros(SHAPES)])
    shared = spark.sparkContext.broadcast((model.of.astype(np.int32), model.unit, model.step, known, base))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, unit, step, known, base = shared.value
        for b in batches:
            u, stops = _texts(b.column("units"))
            if not len(stops):
                continue
            c, first = of[u], np.append(0, stops[:-1])
            each = lambda x: np.add.reduceat(x, first)
            value = step[c[:-1], c[1:]] + unit[u[1:]]
            out = [pa.array(np.diff(np.append(0, stops))), pa.array(each(known[u[1:]].astype(np.int64))), pa.array(each(base[u[1:]])), pa.array(each(value))]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names[:3]), *out], names=names)

    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "value"]
    kind = dict(docs.dtypes)["doc_id"]
    parts = texts.select("uid", "doc_id", "held_out", "units").mapInArrow(work, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, value double")
    rare = texts.select("uid", F.explode("tails").alias("t")).select("uid", "t.word", "t.s").join(counts, "word", "left")
    by_shape = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("s") + 1)
    c = F.coalesce("n", F.lit(0))
    seen = F.log10(c - by_shape(model.cut)) - F.log10(by_shape(model.size))
    sums = rare.groupBy("uid").agg(
        F.count(F.when(c > 0, 1)).alias("r_known"),
        F.sum(F.log10((c + 1) / F.lit(float(total + types + 1)))).alias("r_base"),
        F.sum(F.when(c > 0, seen).otherwise(by_shape(model.unseen))).alias("r_value"))
    none = lambda x: F.coalesce(x, F.lit(0))
    return parts.join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + none("r_known")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + none("r_base")).alias("base_score"), (F.col("value") + none("r_value")).alias("score"))
