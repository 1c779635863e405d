"""Small documents with the awkward cases: nulls in every column, empty and long texts, ties, repeats, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def words(text):
    return WORD.findall(text or "")


def corpus(n=120, seed=3):
    """Prose with copies, near copies, hot sources and one very long text."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    rows = []
    for i in range(n):
        t = text(rng.randint(55, 160))
        if i % 10 == 3:
            t = rows[rng.randrange(len(rows))][1]
        elif i % 10 == 4:
            w = rows[rng.randrange(len(rows))][1].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 10 == 5:
            t = "\n".join([text(12), "same line of words", "same line of words", text(60)])
        rows.append((i, t, rng.choice(["en", "fr"]), "hot" if i % 3 == 0 else f"s{i % 5}", len(t)))
    rows.append((n, text(30_000), "en", "hot", None))
    return rows + odd(n + 1)


def odd(at=0):
    return [
        (at, None, "en", "hot", None), (at + 1, "", None, None, 0), (at + 2, " \t\r\n\x0b\x0c ", "en", "s1", 7), (at + 3, "one", "fr", None, 3), (at + 4, "ÀB c d   e 漢字 😀 x", "fr", "s2", 20),
        (None, "no id here at all but some words", None, "s3", 5), (at + 5, "twice the same row " * 5, "en", "s1", 9), (at + 5, "twice the same row " * 5, "en", "s1", 9),
    ]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for name in ("fp", "key", "rep", "size", "_size", "n", "kept", "_m", "_c", "_rank", "uid", "tails", "target", "length", "piece", "hash", "_key", "bytes", "node", "component", "_e"):
            df = df.withColumn(name, F.lit(f"extra {name}"))
    return df
