"""Secret scans with corpus-wide ownership frequency (native DataFrame operations).

Patterns find candidates in every whole text. Each candidate's value is hashed, and the hashes are counted over
the corpus by distinct repositories and owners. A value that many repositories of several owners carry is a copied example
(`example` spans); one that belongs to few owners, or to few repositories, looks live (`live` spans). Where the documents name no
repository, copies and near copies of one text count as one, whoever has them: copying a document makes a secret in it no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shielded, spread, words_of

#: Kinds in listed order: pattern, group that holds the value, least length of the value. Java syntax; in (?i) only ASCII folds.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # greedy maximal runs: those under 16 would be dropped anyway
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Kinds that the method adds, after the base kinds in the order of spans.
ADDED = ("live", "example")
#: A value is a copied example when more owners and more repositories than these carry it.
MAX_OWNERS, MAX_REPOS = 2, 4
#: Words of the shingles that tell copies of a text.
SHINGLE = 5


def _found(text: Column, kind: str, rank: int) -> Column:
    """Array of struct(start, rank, kind, end, from, value) of the matches that pass, in code points, end exclusive.

    The text is split at the matches only where there are some; starts are running sums of part and match lengths.
    """
    pattern, group, least = PATTERNS[kind]
    entry = "array<struct<start:bigint,rank:int,kind:string,end:bigint,from:bigint,value:string>>"
    whole, value = F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)
    both = F.arrays_zip(F.split(text, pattern, -1).alias("part"), whole.alias("whole"), value.alias("value"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(entry).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["part"])
        end = start + F.length(x["whole"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), (end - F.length(x["value"])).alias("from"), x["value"].alias("value"))
        passed = F.when(F.length(x["value"]) >= least, F.concat(a["out"], F.array(one))).otherwise(a["out"])
        # the last part has no match after it
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["whole"].isNull(), a["out"]).otherwise(passed).cast(entry).alias("out"))

    hit = text.rlike(pattern)
    return F.when(hit, F.aggregate(both, zero, step, lambda a: a["out"])).otherwise(F.array().cast(entry))


def candidates(text: Column) -> Column:
    """All base matches of a text, by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_found(text, k, i) for i, k in enumerate(PATTERNS)]))


def value_hash(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def repository(text: Column) -> Column:
    """The least MD5 of the five-word shingles of a text: equal for copies and, nine times out of ten, for copies with a tenth changed."""
    def least(words: Column) -> Column:
        n = F.greatest(F.size(words) - SHINGLE, F.lit(0))
        return F.array_min(F.transform(F.sequence(F.lit(1), n + 1), lambda k: F.md5(F.array_join(F.slice(words, k, SHINGLE), " "))))

    return F.element_at(F.transform(F.array(words_of(text)), least), 1)


def ownership(found: DataFrame, cands: str = "_c") -> DataFrame:
    """(hash, repos, owners) of every candidate value of rows with `_owner` and `_repo`; equal rows are merged before they move."""
    each = found.where(F.size(cands) > 0).select("_owner", "_repo", F.explode(F.array_distinct(F.transform(cands, lambda c: value_hash(c["value"])))).alias("hash"))
    kept = lambda k, c: F.struct(F.lit(k).alias("side"), F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")).alias("value"))
    sides = each.select("hash", F.explode(F.array(kept("o", "_owner"), kept("r", "_repo"))).alias("x")).select("hash", "x.*").distinct()
    return sides.groupBy("hash").agg(F.count(F.when(F.col("side") == "r", 1)).alias("repos"), F.count(F.when(F.col("side") == "o", 1)).alias("owners"))


def verdict(repos: Column, owners: Column) -> Column:
    return F.when((owners > MAX_OWNERS) & (repos > MAX_REPOS), F.lit("example")).otherwise(F.lit("live"))


def scan(docs: DataFrame, keep: list[str], owner: str = "source", repo: str | None = None, text: str = "text", name: str = "_c") -> DataFrame:
    """The ``keep`` columns with array columns ``name`` (base matches), ``name``_added (live and example spans) and ``name``_counts (repositories and owners of each base match).

    Every row stays, with or without matches. Null owners count as one owner, null texts are empty. ``repo`` names the column that tells
    repositories; without it copies of a text are one. A document's verdicts are looked up by a hash of its candidate values, so copies share
    one lookup row and no document moves unless it has candidates.
    """
    marked = spread(docs).withColumn(name, candidates(F.col(text)))
    own = F.col(repo) if repo else F.when(F.size(name) > 0, repository(F.col(text)))
    marked = materialize(marked.select(*keep, name, F.col(owner).alias("_owner"), own.alias("_repo")), "scanned")
    hashes = F.array_distinct(F.transform(name, lambda c: value_hash(c["value"])))
    some = marked.where(F.size(name) > 0).withColumn("_key", F.sha2(F.array_join(F.transform(name, lambda c: value_hash(c["value"])), ",").cast("binary"), 256))
    freq = ownership(marked, name)
    values = some.select("_key", F.explode(hashes).alias("hash")).distinct()
    entry = F.struct("hash", F.struct(verdict(F.col("repos"), F.col("owners")).alias("kind"), "repos", "owners"))
    verdicts = values.join(freq, "hash").groupBy("_key").agg(F.map_from_entries(F.collect_set(entry)).alias("_v"))
    of = lambda c: F.element_at("_v", value_hash(c["value"]))
    rank = lambda kind: F.when(kind == "live", F.lit(len(PATTERNS))).otherwise(F.lit(len(PATTERNS) + 1))
    span = lambda c: F.struct(c["from"].alias("start"), rank(of(c)["kind"]).alias("rank"), of(c)["kind"].alias("kind"), c["end"].alias("end"))
    count = lambda c: F.struct(of(c)["repos"].alias("repos"), of(c)["owners"].alias("owners"))
    added, counts = f"{name}_added", f"{name}_counts"
    hit = some.join(verdicts, "_key", "left").withColumns({added: F.array_distinct(F.transform(name, span)), counts: F.transform(name, count)})
    miss = marked.where(F.size(name) == 0).withColumns({added: F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"), counts: F.array().cast("array<struct<repos:bigint,owners:bigint>>")})
    return hit.select(*keep, name, added, counts).unionByName(miss.select(*keep, name, added, counts))


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, ownership of every row of (doc_id, text, source).

    `ownership` has repositories/owners of each base span's value, in order. Null and empty texts have no spans. Repeated rows each get their row. Other columns are not read.
    """
    found = scan(docs, ["doc_id"])
    n = lambda k: F.size(F.filter("_c", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}")
    slim = F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select(
        "doc_id", *[n(k) for k in PATTERNS], F.sha2(_join(F.col("_c")).cast("binary"), 256).alias("base_sha256"), _join(F.sort_array(F.concat(slim, "_c_added"))).alias("spans"),
        F.array_join(F.transform("_c_counts", lambda c: F.concat_ws("/", c["repos"].cast("string"), c["owners"].cast("string"))), ",").alias("ownership"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every live-looking value replaced by `[SECRET]` and n_chars set to the new length; examples stay."""
    docs, restored = shielded(docs, ["doc_id", "text", "source", "n_chars"])
    cols = docs.columns
    found = scan(docs, cols, name="__c")
    live = F.filter("__c_added", lambda c: c["kind"] == "live")
    text = F.col("text")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        part = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(c["start"] - a["at"], F.lit(0)).cast("int"))
        done = F.struct(F.greatest(a["at"], c["end"]).alias("at"), F.concat(a["out"], part, F.when(c["start"] >= a["at"], F.lit("[SECRET]")).otherwise(F.lit(""))).alias("out"))
        return done

    new = F.aggregate(F.sort_array(live), zero, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    hit = F.size(live) > 0
    out = found.withColumn("__new", F.when(hit, new).otherwise(text))
    return restored(out.select(*[F.col("__new").alias(c) if c == "text" else F.when(hit, F.length("__new").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in cols]))
