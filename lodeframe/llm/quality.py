"""Quality rules with adaptive thresholds from mergeable quantile sketches (native DataFrame operations).

Each document gets base measures; for every (language, source) a sketch of each measure is built, merged and
turned into cut-offs, and the documents are filtered by a join with them. The sketch is a histogram over
relative-precision buckets (the scheme of DDSketch and HDR histograms): integer values below 64 have their own
bucket, larger ones share one per 1/32 of a power of two. Counts of equal buckets add up, so sketches
merge exactly, in any order, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shielded, spread, words_of

#: Measures judged from above: the count, its scale, and how many of it say nothing yet in a document of any length.
UPPER = {"symbol_rate": ("n_symbols", 1000, 3), "dup_line_rate": ("n_dup_lines", 100_000, 3), "repeat_rate": ("n_repeat_words", 1000, 30), "word_length": ("word_chars", 1000, 0)}
#: Measure judged from below too.
LOWER = ("word_length",)
#: A cut-off is the median plus (or minus) so many times the distance from the median to the outer decile.
SPREAD = 8
#: A group's distance is at most so many times that of the sketch above it, plus one in so many parts of its median. So a source that differs
#: as a whole has its own cut-offs, and one whose outer decile is junk amid the usual does not loosen them.
LOOSER, PART = 2, 8
#: A sketch's values are exact to one in so many parts, and no distance is finer.
PRECISION = 32
#: Groups of fewer documents borrow the cut-offs of their language; languages of fewer those of the corpus.
LEAST = 64
MIN_WORDS = 50


def base_measures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (null: none), all long.

    A word counts as repeated when a 3-word window that covers it is found twice or more in the text. Windows
    are compared by 64-bit hash. The window positions are only worked out where some hash repeats.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def once(value: Column, use) -> Column:
        """``use(value)`` with ``value`` worked out once a row, however often it occurs."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def covered(h: Column) -> Column:
        at = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        n = F.size(h)

        def twins(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k)["h"] == x["h"])
            hit = F.filter(s, lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(F.lit(False)) | F.when(k < n - 1, same(x, k + 1)).otherwise(F.lit(False)))
            zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last"))
            step = lambda a, p: F.struct((a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum"), p.alias("last"))
            return F.aggregate(F.sort_array(F.transform(hit, lambda x: x["i"])), zero, step, lambda a: a["sum"])

        return once(at, twins)

    def repeats(words: Column) -> Column:
        windows = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        repeated = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(words) > 3, once(windows, repeated)).otherwise(F.lit(0).cast("long"))

    def measures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.concat_ws("", words)).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            once(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeats(words).alias("n_repeat_words"))

    return once(words_of(text), measures)


def with_measures(docs: DataFrame, text: str = "text", out: str = "_m") -> DataFrame:
    """``docs`` with the base measures as a struct column."""
    return docs.withColumn(out, base_measures(F.col(text)))


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * 50)


def rates(m: str) -> Column:
    """The judged measures as counts a word, each times its scale."""
    per = F.greatest(F.col(f"{m}.n_words"), F.lit(1))
    return F.struct(*[F.floor(F.col(f"{m}.{c}") * scale / per).cast("long").alias(k) for k, (c, scale, _) in UPPER.items()])


def bucket(v: Column) -> Column:
    """Lowest value of the sketch bucket of a non-negative long: at most 1/32 below it."""
    return v - v % F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")


def sketches(measured: DataFrame, lang: str, source: str, rate: str) -> DataFrame:
    """(lang, source, measure, bucket, n): one mergeable sketch per language, source and measure."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(F.col(f"{rate}.{k}")).alias("bucket")) for k in UPPER])
    long = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("e"))
    return long.groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, lowest decile, median and highest decile of each merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumns({"total": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda q: F.min(F.when(F.col("upto") * 10 >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), at(1).alias("low"), at(5).alias("mid"), at(9).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with the cut-offs of each measure: k_top and, for some, k_bottom."""

    def cut(df: DataFrame, above: str | None = None) -> DataFrame:
        """Distances up and down, bounded by those of the sketch ``above``, and the cut-offs."""
        fine = F.floor(F.col("mid") / PRECISION).cast("long")
        up, down = F.greatest(F.col("high") - F.col("mid"), fine), F.greatest(F.col("mid") - F.col("low"), fine)
        if above:
            part = F.floor(F.col("mid") / PART).cast("long")
            up, down = F.least(up, LOOSER * F.col(f"{above}_up") + part), F.least(down, LOOSER * F.col(f"{above}_down") + part)
        return df.withColumns({"up": up, "down": down}).withColumns({"top": F.col("mid") + SPREAD * F.col("up"), "bottom": F.col("mid") - SPREAD * F.col("down")})

    def named(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{p}_{k}") for k in (*keys, "measure", "docs", "up", "down", "top", "bottom")])

    corpus = named(cut(quantiles(sketch, [])), "a", [])
    by_lang = cut(quantiles(sketch, ["lang"]).join(corpus, F.col("measure") == F.col("a_measure")), "a")
    above = by_lang.select(*[F.col(k).alias(f"l_{k}") for k in ("lang", "measure", "docs", "up", "down", "top", "bottom")], "a_top", "a_bottom")
    joined = cut(quantiles(sketch, ["lang", "source"]).join(above, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))), "l")
    pick = lambda c: F.when(F.col("docs") >= LEAST, F.col(c)).when(F.col("l_docs") >= LEAST, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    aggs = [F.max(F.when(F.col("measure") == k, pick("top"))).alias(f"{k}_top") for k in UPPER]
    aggs += [F.max(F.when(F.col("measure") == k, pick("bottom"))).alias(f"{k}_bottom") for k in LOWER]
    return joined.groupBy("lang", "source").agg(*aggs)


def judged(measured: DataFrame, lang: str = "lang", source: str = "source", m: str = "_m", out: str = "_kept") -> DataFrame:
    """A measured table (read twice, so materialised) with the verdict column, joined with its groups' thresholds.

    A document is over a cut-off when its count exceeds what the cut-off gives for its words and the few that say nothing.
    Null languages and sources are groups of their own. A group's key never gathers documents in a task: the
    sketches are pre-aggregated, and the join can be split.
    """
    rated = measured.where(~base_failed(m)).withColumn("_rate", rates(m))
    cuts = materialize(thresholds(sketches(rated, lang, source, "_rate")).withColumnsRenamed({"lang": "_t_lang", "source": "_t_source"}), "thresholds")
    words, over = F.col(f"{m}.n_words"), F.lit(False)
    for k, (c, scale, least) in UPPER.items():
        over = over | (F.col(f"{m}.{c}") * scale > F.col(f"{k}_top") * words + least * scale)
    for k in LOWER:
        c, scale, _ = UPPER[k]
        over = over | (F.col(f"{m}.{c}") * scale < F.col(f"{k}_bottom") * words)
    joined = measured.join(cuts, F.col(lang).eqNullSafe(F.col("_t_lang")) & F.col(source).eqNullSafe(F.col("_t_source")), "left")
    verdict = ~base_failed(m) & ~F.coalesce(over, F.lit(False))
    return joined.withColumn(out, verdict).drop("_t_lang", "_t_source", *[f"{k}_top" for k in UPPER], *[f"{k}_bottom" for k in LOWER])


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row of (doc_id, text, lang, source).

    Null and word-less texts have no words and fail. Null ids, languages and sources are carried through;
    repeated rows each get their row. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang", "source")
    measured = materialize(with_measures(spread(docs)).drop("text"), "measures")
    out = judged(measured)
    return out.select("doc_id", "_m.*", base_failed("_m").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    docs, restored = shielded(docs, ["doc_id", "text", "lang", "source"])
    return restored(judged(materialize(with_measures(spread(docs)), "measured")).where("_kept"))
