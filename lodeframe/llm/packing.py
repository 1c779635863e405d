"""Best-fit decreasing packing with a segment tree over remaining capacities.

Pieces go by falling length into the open sequence with the tightest room. The tree's leaves are the
capacities 0..limit and hold the open sequences of that much room, so finding the tightest one that fits takes
log2(limit) steps. Equal sequences are kept as one cohort (first id, number), and equal pieces are placed into a
cohort at once: the plan depends on the histogram of lengths only, and every piece finds its place from its rank among the
pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import materialize, runs, spread

LIMIT = 1024
END = 2


class CapacityTree:
    """Segment tree over room 0..limit; a leaf holds a stack of cohorts (first sequence id, number of sequences)."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.open = np.zeros(2 * self.width, np.int64)
        self.cohorts: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def _add(self, room: int, number: int) -> None:
        node = room + self.width
        while node:
            self.open[node] += number
            node >>= 1

    def push(self, room: int, first: int, number: int) -> None:
        if number:
            self.cohorts[room].append((first, number))
            self._add(room, number)

    def pop(self, room: int) -> tuple[int, int]:
        first, number = self.cohorts[room].pop()
        self._add(room, -number)
        return first, number

    def tightest(self, need: int) -> int:
        """Least room >= need with an open sequence, or -1."""
        node = need + self.width
        while not self.open[node]:
            # climb to the next subtree on the right
            while node & 1:
                node >>= 1
                if node <= 1:
                    return -1
            if node <= 1:
                return -1
            node += 1
        while node < self.width:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(counts: dict[int, int], limit: int = LIMIT) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each length the runs (first rank, pieces per sequence, sequences, first sequence id, first offset) in rank order.

    The rank r of a length in a run of p pieces per sequence goes to sequence first id + (r - first rank) // p,
    at first offset + length * ((r - first rank) % p).
    """
    tree, fresh, plan = CapacityTree(limit), 0, {}
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank, out = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first = limit, fresh
                number = -(-left // (limit // length))
                fresh += number
            else:
                first, number = tree.pop(room)
            fit = room // length  # the tightest sequence stays the tightest until it is full
            full = min(number, left // fit)
            if full:
                out.append((rank, fit, full, first, limit - room))
                tree.push(room - fit * length, first, full)
                rank, left, first, number = rank + fit * full, left - fit * full, first + full, number - full
            if left and number:
                out.append((rank, left, 1, first, limit - room))
                tree.push(room - left * length, first, 1)
                rank, left, first, number = rank + left, 0, first + 1, number - 1
            tree.push(room, first, number)
        plan[length] = out
    return plan


#: Worker-local tokenizers by path and mode.
_LOADED: dict[tuple[str, bool], tuple] = {}
#: Texts encoded at a time.
_CHUNK = 256
#: Texts of printable Latin-1, for which all libraries agree on letters, numbers and spaces.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*").fullmatch
#: The byte-level pre-tokenizer's pattern; fixed values.
_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of each id of a byte-level BPE whose ids follow its merges; None for any other tokenizer, which needs its own library."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocab.get(x + y) for x, y in merges] != list(range(256, 256 + len(merges))) or {vocab.get(c) for c in byte_of} != set(range(256)):
        return None
    out = {bytes([byte_of[c]]): vocab[c] for c in byte_of}
    return out | {bytes(byte_of[c] for c in x + y): 256 + k for k, (x, y) in enumerate(merges)}


def _encoder(path: str, as_text: bool = True):
    """Ids of texts, by the tokenizer of ``path``. ``as_text`` has special tokens encoded as the text they are written in, and not as their own id.

    Where the file is a byte-level BPE, printable Latin-1 texts without added tokens go through the faster of two
    implementations of the same merges; all others go to the tokenizer's own library whole.
    """
    if (path, as_text) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = as_text
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (as_text and t.special)]
        with open(path, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        quick = ranks and tiktoken.Encoding("byte-level", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})
        _LOADED[path, as_text] = tokenizer, added, quick
    tokenizer, added, quick = _LOADED[path, as_text]

    def one(text: str) -> np.ndarray:
        if quick and _PLAIN(text) and not any(a in text for a in added):
            return quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    return lambda texts: [one(t) for t in texts]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Starts of a task's pieces among those of a length: broadcast up to so many rows, joined in a shuffle beyond.
STARTS = 1_000_000


def _pieces(docs: DataFrame, tokenizer: str | None, limit: int, end: int) -> DataFrame:
    """``token_pieces`` with the task that made a piece and the piece's rank among the task's pieces of its length."""
    # the path is looked up by each worker where none is given: installations may differ
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = _encoder(tokenizer or default_tokenizer(), as_text=False), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, _CHUNK):
                texts = b.column("text").slice(at, _CHUNK)
                found = encode([t or "" for t in texts.to_pylist()])
                ids = np.concatenate([x for own in found for x in (own, np.array([end], "<u4"))])
                whole = np.array([len(x) + 1 for x in found])
                first = (whole - 1) % limit + 1
                number = (whole - first) // limit + 1
                row = np.repeat(np.arange(len(whole)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = np.where(piece > 0, first[row] + (piece - 1) * limit, 0)
                length = np.where(piece > 0, limit, first[row])
                order = np.argsort(length, kind="stable")
                rank, (begin, size) = np.empty(len(length), np.int64), runs(length[order])
                rank[order] = np.arange(len(length)) - np.repeat(begin, size) + seen[length[order]]
                seen += np.bincount(length, minlength=limit + 1)
                stops = np.cumsum([0, *length])  # pieces lie end to end
                body = memoryview(ids.tobytes())
                crc = [zlib.crc32(body[4 * x : 4 * y]) for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids.view(np.int32)))
                numbers = (pa.array(x, pa.int64()) for x in (start, length, crc))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, _CHUNK).take(pa.array(row)), pa.array(piece.astype(np.int32)), *numbers, lists, pa.array(np.full(len(row), task, np.int32)), pa.array(rank)], names=names)

    fields = [docs.schema["doc_id"], StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in ("start", "length", "ids_crc32")), StructField("ids", ArrayType(IntegerType()))]
    fields += [StructField("_task", IntegerType()), StructField("_rank", LongType())]
    names = [f.name for f in fields]
    return docs.select("doc_id", "text").mapInArrow(work, StructType(fields))


def token_pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids of every piece of at most ``limit`` tokens.

    Only documents longer than ``limit`` are cut; the first piece takes the odd length. A null text is empty and has
    the one id ``end``.
    """
    return _pieces(docs, tokenizer, limit, end).drop("_task", "_rank")


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end: int = END) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with sequence_id and offset, packed best-fit decreasing.

    Sequences hold at most ``limit`` tokens without gaps. Every row of ``docs`` is packed, repeated rows and null ids
    too; other columns are not read. Tokens are written once and don't move: a piece's rank among those of its length is its rank in the task
    that made it and the number of such pieces in earlier tasks. The driver sees the histogram of lengths only, at most ``limit`` rows.
    """
    spark = docs.sparkSession
    pieces = materialize(_pieces(spread(docs.select("doc_id", "text")), tokenizer, limit, end), "pieces")
    counts = materialize(pieces.groupBy("length", "_task").agg(F.count("*").alias("n")), "lengths")
    plan = best_fit_decreasing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("_l"), F.col("_task").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    runs_of = "_length long, _runs array<struct<first: long, fit: long, sequence: long, offset: long>>"
    steps = spark.createDataFrame([(length, [(rank, fit, sequence, offset) for rank, fit, _, sequence, offset in out]) for length, out in plan.items()], runs_of)
    placed = pieces.join(F.broadcast(starts) if counts.count() <= STARTS else starts, (F.col("length") == F.col("_l")) & (F.col("_task") == F.col("_t")))
    placed = placed.withColumn("_r", F.col("_start") + F.col("_rank")).join(F.broadcast(steps), F.col("length") == F.col("_length"))  # at most ``limit`` rows
    own = placed.withColumn("_run", F.element_at(F.filter("_runs", lambda x: x["first"] <= F.col("_r")), -1)).withColumn("_k", F.col("_r") - F.col("_run.first"))
    sequence = F.col("_run.sequence") + F.floor(F.col("_k") / F.col("_run.fit")).cast("long")
    return own.select(*[c for c in pieces.columns if c[0] != "_"], sequence.alias("sequence_id"), (F.col("_run.offset") + F.col("length") * (F.col("_k") % F.col("_run.fit"))).alias("offset"))
