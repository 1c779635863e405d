import re
from collections import Counter

from lodeframe.llm import quality

from .data import DOCS, corpus, frame, words


def base(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def bucket(v):
    e = max(v.bit_length() - 6, 0)
    return v >> e << e


def failed(b):
    return b[0] < 50 or 100 * b[4] > 50 * b[0]


MEASURES = {"symbol_rate": (2, 1000, 3), "dup_line_rate": (3, 100_000, 3), "repeat_rate": (4, 1000, 30), "word_length": (1, 1000, 0)}


def brute_kept(rows):
    """The verdict on each row, from all values of its group, its language and the corpus."""
    bases = [(r, base(r[1])) for r in rows]
    good = [(r, b) for r, b in bases if not failed(b)]

    def spread(own, m, above=None):
        at, scale, _ = MEASURES[m]
        c = sorted(bucket(b[at] * scale // b[0]) for _, b in own)
        low, mid, high = (c[-(-len(c) * q // 10) - 1] for q in (1, 5, 9))
        up, down = max(high - mid, mid // 32), max(mid - low, mid // 32)
        if above:
            up, down = min(up, 2 * above[1] + mid // 8), min(down, 2 * above[2] + mid // 8)
        return mid, up, down, len(own)

    out = []
    for r, b in bases:
        ok = not failed(b)
        for m, (at, scale, least) in MEASURES.items():
            if failed(b):
                break
            corpus = spread(good, m)
            lang = spread([x for x in good if x[0][2] == r[2]], m, corpus)
            own = spread([x for x in good if x[0][2:4] == r[2:4]], m, lang)
            mid, up, down, _ = own if own[3] >= quality.LEAST else lang if lang[3] >= quality.LEAST else corpus
            ok &= b[at] * scale <= (mid + 8 * up) * b[0] + least * scale
            ok &= m != "word_length" or b[at] * scale >= (mid - 8 * down) * b[0]
        out.append((r, b, ok))
    return out


def test_against_brute_force(spark):
    rows = corpus(400)
    rows += [(1000 + k, " ".join(f"junk{j}*** $$$%%%" for j in range(60 + k)), "en", "hot", 1) for k in range(20)]
    got = {(r.doc_id, r.n_words): tuple(r) for r in quality.quality_report(frame(spark, rows)).collect()}
    for r, b, ok in brute_kept(rows):
        assert got[r[0], b[0]] == (r[0], *b, failed(b), ok), r
    assert sum(1 for (i, _), r in got.items() if i is not None and i >= 1000 and r[-1]) == 0


def test_sources_have_their_own_cut_offs(spark):
    """A source of tables keeps them, one in five junk documents loosen nothing, and single symbols say nothing."""
    pool = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{k}" for k in range(5_000)]
    text = lambda k, sep: sep.join(pool[(k * 389 + j * 7) % 5_000] for j in range(60 + k % 40))
    rows = [(k, text(k, " "), "en", f"s{k % 4}", 1) for k in range(2_400)]
    rows += [(5_000 + k, text(k, " | "), "en", "tables", 1) for k in range(150)]
    rows += [(6_000 + k, text(k, " "), "en", "mixed", 1) if k % 5 else (6_000 + k, text(k, "*** #$%"), "en", "mixed", 1) for k in range(200)]
    rows += [(7_000 + k, text(k, " ") + " a & b", "en", f"s{k % 4}", 1) for k in range(30)]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert not [r[0] for r in rows if r[3] != "mixed" and not got[r[0]]]
    assert all(got[r[0]] == bool((r[0] - 6_000) % 5) for r in rows if r[3] == "mixed")


def test_keep_good(spark):
    rows = corpus(200)
    df = frame(spark, rows)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in quality.quality_report(df).where("kept").collect())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want


def test_empty(spark):
    assert quality.quality_report(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_merge(spark):
    """Quantiles of merged parts are those of the whole, at most 1/32 below the exact ones."""
    values = [(k * k) % 9973 for k in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v LONG").select(quality.bucket(__import__("pyspark").sql.functions.col("v")).alias("b"), "v").collect()
    assert all(r.b == bucket(r.v) and r.v * 31 / 32 <= r.b <= r.v for r in got)
